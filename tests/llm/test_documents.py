"""Fingerprints, mixing, media, packing, near duplicates and quality."""

import collections
import functools
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagework.llm import fingerprints, jaccard, matroska, mixing, packing, quality, words

from .conftest import SF, TEXTS


@given(st.lists(st.text("ab é\n\t", max_size=30), max_size=8))
@settings(max_examples=200, deadline=None)
def test_word_hashes(texts):
    raw = [t.encode() for t in texts]
    h, bounds = words.word_hashes(raw)
    seen = {}
    for i, t in enumerate(raw):
        own = t.split()
        assert len(own) == bounds[i + 1] - bounds[i]
        for w, x in zip(own, h[bounds[i] : bounds[i + 1]].tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("n", range(7))
def test_shingles_of_few_words(n):
    long = b"a b c d e f g h i j"
    for texts in ([b" ".join([b"w%d" % i for i in range(n)])], [b"w%d" % i for i in range(n)], [b"", b"w0 " * n, b""]):
        alone = words.shingle_sets(texts, 5)
        beside = words.shingle_sets([*texts, long], 5)
        assert [x.tolist() for x in alone] == [x.tolist() for x in beside[:-1]]
        assert [len(x) for x in alone] == [len(set(zip(*(t.split()[j:] for j in range(5))))) if len(t.split()) >= 5 else bool(t.split()) for t in texts]


def test_long_texts_hash_alike():
    part = b"some words and more words "
    h, bounds = words.word_hashes([part * 120_000, part])
    assert bounds.tolist() == [0, 600_000, 600_005] and (h[:5] == h[-5:]).all()


def test_fingerprints_are_homomorphic():
    a, b, both, turned = fingerprints.fingerprints([b"one two three\nfour", b"five six seven eight", b"one two three\nfour\nfive six seven eight", b"five six seven eight\nfour\none two three"])
    assert a + b == both == turned and both - b == a and a != b
    assert fingerprints.Fingerprint.parse(a.text()) == a


def test_likeness_follows_jaccard():
    random.seed(1)
    base = [f"w{random.randrange(10**6)}" for _ in range(3000)]
    for keep in (0.95, 0.7, 0.3):
        n = int(3000 * keep)
        other = base[:n] + [f"v{random.randrange(10**6)}" for _ in range(3000 - n)]
        x, y = fingerprints.fingerprints([" ".join(base).encode(), " ".join(other).encode()])
        assert abs(x.likeness(y) - keep / (2 - keep)) < 0.12


def test_fingerprint_query(docs, edge, empty):
    for rows in (docs, edge):
        source = sorted(((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest(), r["text"] or "") for r in rows.collect()), reverse=True)
        want = collections.Counter()
        for k, (i, _, t) in enumerate(source):
            n, after = len(t) // 2, source[(k + 1) % len(source)][2]
            want[i, len(t), hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest()] += 1
        got = fingerprints.scan(rows, 3).collect()
        assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    near = fingerprints.scan(docs).agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert near[0] > near[1] + 0.2
    assert fingerprints.scan(empty).count() == 0
    one = fingerprints.scan(edge.where("doc_id = 6")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"shosh").hexdigest()


def test_targets_and_flow():
    assert mixing.targets({"a": 10, "b": 1000, "c": 1000}, {"a": 1, "b": 2, "c": 3}) == {"a": 30.0, "b": 792.0, "c": 1188.0}
    assert mixing.targets({}, {}) == {}
    flow = mixing.route([(10, frozenset("a")), (20, frozenset("ab")), (5, frozenset("b"))], {"a": 50, "b": 30})
    assert sum(f.get("a", 0) for f in flow) == 50 and sum(f.get("b", 0) for f in flow) == 30
    # Convex costs: no pattern is used a third time while another has a second use left.
    assert [sum(f.values()) for f in flow] == [20 + 10 * (sum(flow[0].values()) > 20), *(sum(f.values()) for f in flow[1:])]
    assert mixing.route([], {}) == []


def test_flow_is_cheapest():
    random.seed(5)
    for _ in range(15):
        pats = [(random.randrange(1, 4), frozenset(random.sample("abc", random.randrange(1, 4)))) for _ in range(3)]
        quotas = {s: random.randrange(0, 6) for s in "abc"}
        flow = mixing.route(pats, quotas)
        cost = lambda amounts: sum(sum(c * min(w, max(0, x - w * k)) for k, c in enumerate(mixing.REPEAT_COST)) for (w, _), x in zip(pats, amounts))
        best = {}

        def walk(i, rest, used):
            if i == len(pats):
                k = sum(used)
                best[k] = min(best.get(k, 10**9), cost(used))
                return
            w, own = pats[i]
            own = sorted(own)

            def share(j, rest, left, x):
                if j == len(own):
                    walk(i + 1, rest, [*used, x])
                    return
                for take in range(min(left, rest[own[j]]) + 1):
                    share(j + 1, rest | {own[j]: rest[own[j]] - take}, left - take, x + take)

            share(0, rest, 3 * w, 0)

        walk(0, quotas, [])
        amounts = [sum(f.values()) for f in flow]
        assert sum(amounts) == max(best) and cost(amounts) == best[max(best)]


def test_mix_query(docs, edge, empty):
    rows = mixing.digest(docs).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert r["size"] == len(r["text"].encode().split()) and 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]][0] += r["size"]
        by[r["source"]][1] += r["taken"]
        by[r["source"]][2] = r["target"]
    want = mixing.targets({s: by[s][0] for s in sorted(by)}, {s: 1 + i % 3 for i, s in enumerate(sorted(by))})
    for s, (_, taken, target) in by.items():
        assert target == pytest.approx(want[s]) and abs(taken - target) <= 0.05 * target
    again = {r["doc_id"]: r["taken"] for r in mixing.digest(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    odd = mixing.digest(edge).collect()
    assert len(odd) == len(TEXTS) and all(r["taken"] <= 3 * r["size"] for r in odd)
    taken = mixing.selected(edge)
    assert taken.columns == edge.columns and taken.where("text is null").count() == 0
    assert mixing.digest(empty).count() == 0 and mixing.selected(empty).count() == 0


def test_selected_rows_match_the_mix(docs):
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.digest(docs).where("taken > 0").collect()}
    assert {r["doc_id"]: r["count"] for r in mixing.selected(docs).groupBy("doc_id").count().collect()} == want


@given(st.binary(max_size=6000))
@settings(max_examples=150, deadline=None)
def test_media_round_trip(raw):
    payload = matroska.padded(raw)
    data = matroska.mux(payload)
    m = matroska.demux(data)
    assert m.problem is None and b"".join(data[s : s + n] for _, _, s, n, *_ in m.packets) == payload
    assert [c for _, _, c in m.cues] == m.clusters and m.tracks[0]["codec"] == "A_PCM/INT/LIT"
    assert len(payload) % 64 == 0 and len(payload) >= 64


@given(st.lists(st.integers(0, 700), min_size=2, max_size=9))
@settings(max_examples=150, deadline=None)
def test_lacing_round_trip(sizes):
    frames = [bytes([i % 256]) * n for i, n in enumerate(sizes)]
    flag, head = matroska._lacing(frames)
    m = matroska.Media()
    block = b"\x81\x00\x00" + bytes([flag]) + head + b"".join(frames)
    matroska._block(block, 0, len(block), 0, m, 0, None)
    assert [p[3] for p in m.packets] == sizes


def test_media_faults_keep_whole_packets():
    data = matroska.mux(bytes(range(256)) * 40)
    for cut in (0, 1, 30, len(data) // 2, len(data) - 3):
        m = matroska.demux(data[:cut])
        assert m.problem and all(s + n <= cut for _, _, s, n, *_ in m.packets)
    assert matroska.demux(b"RIFFxxxx").problem == "no EBML head"


def test_media_query(edge, empty, docs):
    rows = matroska.digest(matroska.store(edge)).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(TEXTS) and all(r["problem"] is None for r in rows)
    for i, t, _ in TEXTS:
        payload = matroska.padded((t or "").encode())
        assert by[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and by[i]["tail_crc32"] == zlib.crc32(payload[-64:])
        assert by[i]["n_bytes"] == len((t or "").encode()) and by[i]["payload_bytes"] == len(payload)
    p = matroska.packets(matroska.store(docs))
    assert p.where("not cued").count() == 0 and p.agg(F.sum("size")).first()[0] == matroska.digest(matroska.store(docs)).agg(F.sum("payload_bytes")).first()[0]
    assert matroska.packets(matroska.store(empty)).count() == 0


def held(rows, length):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= length
    return len(bins)


def test_packing_query(docs, edge, empty):
    from tokenizers import Tokenizer

    import public_tokenizers

    tk = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    tk.encode_special_tokens = True
    for rows in (docs, edge):
        want = collections.Counter()
        total = 0
        for r in rows.collect():
            ids = np.array([*tk.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
            total += len(ids)
            for j, a in enumerate(range(0, len(ids), 2048)):
                want[r["doc_id"], j, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())] += 1
        got = packing.digest(rows).collect()
        assert collections.Counter(tuple(r)[:5] for r in got) == want
        assert held(got, 2048) <= -(-total // 2048) * 1.02 + 1
    assert packing.digest(empty).count() == 0


def test_tokens_of_odd_words():
    from tokenizers import Tokenizer

    import public_tokenizers

    path = public_tokenizers.path(packing.TOKENIZER)
    tk = Tokenizer.from_file(path)
    tk.encode_special_tokens = True
    texts = ["don't WON'T it's 'tis", "a.b,c!! x### 12,34 3rd", "é. É, naïve; ΑΣ. İx", "<|endoftext|> ok", "日本語。  wide\x1cgap", "é café.", "", " "]
    got = packing.encoder(path)([t.encode() for t in texts])
    assert [x.tolist() for x in got] == [tk.encode(t, add_special_tokens=False).ids for t in texts]


def test_special_tokens_as_by_default(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    path = public_tokenizers.path(packing.TOKENIZER)
    tk = Tokenizer.from_file(path)  # untouched
    rng = random.Random(4)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "<|", "a", "don", "'t", " ", "\n", "é", "e\u0301", ".", "Word", "7"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "", *("".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(400))]
    want = [tk.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [320, 49407, 321]
    assert [x.tolist() for x in packing.text_encoder(path)([t.encode() for t in texts])] == want
    got = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in got} == {i: (len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())) for i, x in enumerate(want)}


@given(st.lists(st.integers(1, 99), min_size=1, max_size=60), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_evolution_keeps_every_piece(items, seed):
    first = packing.best_fit(sorted(items, reverse=True), [], 100)
    last = packing.evolve([], sorted(items), 100, 6, seed)
    for p in last:
        assert sorted(x for b in p for x in b) == sorted(items) and all(sum(b) <= 100 for b in p)
    assert len(last[0]) <= len(first)
    child = packing.crossover(first, last[-1], 100, random.Random(seed))
    assert sorted(x for b in child for x in b) == sorted(items)


def linked(rows):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    group = collections.defaultdict(list)
    for k in range(len(sets)):
        group[find(k)].append(sets[k][0])
    return collections.Counter((sets[k][0], len(sets[k][1]), min(group[find(k)])) for k in range(len(sets)))


def near_texts(seed, n):
    """Groups of near copies at all distances about the threshold, copies, and shared passages."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage, out = [word() for _ in range(40)], []
    for _ in range(n):
        base = [word() for _ in range(rng.choice((3, 5, 6, 9, 20, 60, 150)))]
        if rng.random() < 0.3:
            base += passage
        for _ in range(rng.choice((1, 1, 2, 6))):
            copy = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 4))):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy = copy + [word() for _ in range(rng.randrange(1, 1 + max(1, len(copy) // 4)))]
            out.append(" ".join(copy))
    return list(enumerate(out))


def test_join_loses_no_link(spark, edge, empty):
    rows = near_texts(11, 150)
    got = jaccard.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert collections.Counter(tuple(r) for r in got.collect()) == linked(rows)
    assert collections.Counter(tuple(r) for r in jaccard.digest(edge).collect()) == linked([(i, t) for i, t, _ in TEXTS])
    kept = jaccard.distinct_documents(edge)
    assert kept.columns == edge.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 8, 9, 10]
    assert jaccard.digest(empty).count() == 0 and jaccard.distinct_documents(empty).count() == 0


def test_null_ids(spark):
    text = "one two three four five six seven eight nine ten"
    rows = spark.createDataFrame([(None, text, "a"), (None, text + " more", None), (5, text, "a"), (5, "other words", "a")], "doc_id long, text string, source string")
    got = collections.Counter(tuple(r) for r in jaccard.digest(rows).collect())
    assert got == {(None, 6, 5): 1, (None, 7, 5): 1, (5, 6, 5): 1, (5, 1, 5): 1}
    assert jaccard.distinct_documents(rows).count() >= 1
    lost = jaccard.digest(rows.where("doc_id is null")).collect()
    assert [tuple(r) for r in sorted(lost, key=lambda r: r["n_shingles"])] == [(None, 6, None), (None, 7, None)]
    assert fingerprints.scan(rows).count() == mixing.digest(rows).count() == matroska.digest(matroska.store(rows)).count() == 4
    assert sum(r["length"] > 0 for r in packing.digest(rows).collect()) == 4
    scored = quality.scored(rows, spark.createDataFrame([(5, 1), (None, 0)], "doc_id long, quality int")).collect()
    assert len(scored) == 4 and all(not r["held_out"] for r in scored if r["doc_id"] is None)


def test_one_row_of_each_component_survives(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [
        (None, text, "a"), (None, text + " more", "b"), (5, text, "c"), (5, "other words", "d"), (None, "unlinked one", "e"), (None, "unlinked two", "f"),
        (7, "said twice", "g"), (7, "said twice", "g"), (None, "lost twice", "h"), (None, "lost twice", "h"), (8, None, "i"), (8, None, "i"), (None, " \t\x0b\n", "j"), (None, "", "k"),
    ]
    docs = lambda own: spark.createDataFrame(own, "doc_id long, text string, source string")
    kept = jaccard.distinct_documents(docs(rows)).collect()
    assert collections.Counter(tuple(r)[2] for r in kept) == {"c": 1, "d": 1, "e": 1, "f": 1, "g": 1, "h": 1, "i": 2, "j": 1, "k": 1}
    clash = docs(rows).withColumns({"__id": F.lit(1), "__key": F.lit("x"), "__Text_Key": F.lit("y"), "___copies": F.lit(2)})
    assert jaccard.distinct_documents(clash).columns == clash.columns and jaccard.distinct_documents(clash).count() == len(kept)
    # One null id that stands for itself lets no linked copy of another component back in.
    few = [(None, "alone here", "a"), (1, text, "b"), (None, text, "c")]
    assert sorted(r["source"] for r in jaccard.distinct_documents(docs(few)).collect()) == ["a", "b"]


def test_many_holders_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW_HOLDERS", 2)
    monkeypatch.setattr(jaccard, "BLOCK_HOLDERS", 8)
    rows = near_texts(12, 60)
    got = jaccard.digest(spark.createDataFrame(rows, "doc_id long, text string"))
    assert collections.Counter(tuple(r) for r in got.collect()) == linked(rows)


@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.integers(0, 2**32))
@settings(max_examples=150, deadline=None)
def test_linked_sets_share_a_segment(n, gone, new, seed):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 1 << 63, n + new, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    a, b = np.unique(pool[:n]), np.unique(pool[min(gone, n - 1) :])
    common = len(np.intersect1d(a, b))
    apart = len(a) + len(b) - 2 * common
    assert jaccard.apart_at_least(jaccard.sketch(a), jaccard.sketch(b)) <= apart
    if 4 * common >= 3 * (len(a) + len(b) - common):
        ranks = rng.integers(0, 9, jaccard.SLOTS, dtype=np.uint8) if seed % 2 else np.zeros(jaccard.SLOTS, np.uint8)
        assert np.intersect1d(jaccard.segments(a, ranks), jaccard.segments(b, ranks)).size


def test_quality(spark, docs, edge, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.scored(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.7)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held_out = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held_out) >= 0.97 * len(held_out)
    # Held-out labels are not read: turning them over changes nothing.
    turned = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id")) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.scored(docs, turned).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in rows)
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in rows if r["predicted"]}


def test_quality_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (6, 1), (7, 0), (8, 1), (9, 0)], "doc_id long, quality int")
    rows = quality.scored(edge, labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.scored(empty, labels).count() == 0
    none = quality.scored(edge, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and quality.keep(edge, labels.limit(0)).count() == 0


def test_ids_of_every_code_point():
    """Alone, in words, before closing marks and in the other case, by the untouched tokenizer."""
    from tokenizers import Tokenizer

    import public_tokenizers

    path = public_tokenizers.path(packing.TOKENIZER)
    tk, encode = Tokenizer.from_file(path), packing.text_encoder(path)
    points = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 20_000):
        texts = [f"{c} a{c}, {c}b. x{c}y! {c.upper()}; {c.lower()}" for c in points[i : i + 20_000]]
        assert [x.tolist() for x in encode([t.encode() for t in texts])] == [e.ids for e in tk.encode_batch(texts, add_special_tokens=False)]


@given(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "<|ENDOFTEXT|>", "İ", "Σ", "J̌", "'s", ",", ". ", "\x1c", " ", "word"]), st.text(max_size=6)), max_size=12).map("".join))
@settings(max_examples=300, deadline=None)
def test_ids_of_any_text(text):
    from tokenizers import Tokenizer

    import public_tokenizers

    path = public_tokenizers.path(packing.TOKENIZER)
    assert packing.text_encoder(path)([text.encode("utf8", "replace")])[0].tolist() == _tokenizer(path).encode(text.encode("utf8", "replace").decode(), add_special_tokens=False).ids


@functools.cache
def _tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_slices_by_bytes():
    from passagework.llm.common import slices

    b = pa.record_batch([pa.array([1, 2, 3, 4, 5]), pa.array(["x" * 50, None, "y" * 500, "z" * 40, ""])], names=["doc_id", "text"])
    assert [p.num_rows for p in slices(iter([b]), 10, 100)] == [2, 1, 2]
    assert [p.num_rows for p in slices(iter([b]), 2, 10_000)] == [2, 2, 1]


def test_flow_leaves_shared_texts_to_those_that_need_them(spark):
    """A has enough words of its own, B has only the text that A holds too: one source at a time would
    take the shared text for A as well."""
    shared = " ".join(f"s{i}" for i in range(100))
    rows = [(i, " ".join(f"a{i}w{k}" for k in range(10)), "A") for i in range(10)] + [(100, shared, "A"), (200, shared, "B")]
    got = {r["doc_id"]: r for r in mixing.digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert (got[0]["target"], got[200]["target"]) == (100.0, 200.0)
    assert got[200]["taken"] == 200 and got[100]["taken"] == 0 and all(got[i]["taken"] == 10 for i in range(10))
    members = {r["doc_id"]: r["members"] for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))[0].collect()}
    assert members[0] == ["A"] and members[100] == members[200] == ["A", "B"]


def test_shared_texts_by_shuffle_and_beyond_the_patterns(spark, docs, monkeypatch):
    want = {r["doc_id"]: tuple(r) for r in mixing.digest(docs).collect()}
    monkeypatch.setattr(mixing, "SMALL_TEXTS", 0)
    assert {r["doc_id"]: tuple(r) for r in mixing.digest(docs).collect()} == want
    monkeypatch.setattr(mixing, "MAX_PATTERNS", docs.select("source").distinct().count())
    rows = mixing.digest(docs).collect()  # each text its own source's alone
    assert len(rows) == len(want) and all(r["taken"] <= 3 * r["size"] for r in rows)


def test_a_tree_of_flows_meets_what_one_flow_meets(spark, monkeypatch):
    """Forty sources and texts shared by random sets of them: each source's words are the same by one
    flow and by flows of a few pairs each, and so are near their targets."""
    rng, rows = random.Random(11), []
    for i in range(600):
        text = " ".join(f"t{i}w{k}" for k in range(rng.randrange(1, 60)))
        for s in rng.sample(range(40), rng.choice([1, 1, 2, 3])):
            rows.append((len(rows), text, f"s{s}" if s else None))
    docs = spark.createDataFrame([*rows, (None, "no id here", "s1"), (None, None, "s2")], "doc_id long, text string, source string")

    def sums():
        found = mixing.digest(docs).collect()
        assert len(found) == len(rows) + 2 and all(r["taken"] <= 3 * r["size"] for r in found)
        by = collections.Counter()
        for r in found:
            by[r["target"], r["source_size"]] += r["taken"]
        assert all(abs(t - target) <= 0.02 * target + 30 for (target, _), t in by.items())
        return by, {r["doc_id"]: r["taken"] // r["size"] for r in found if r["taken"]}

    sized = mixing._sized(docs, "source")
    sized = mixing.with_members(sized, mixing.shared_texts(sized))
    pairs = sized.groupBy("members", "source").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    once = sized.where("size > 0").select("members", "key", "size").distinct().groupBy("members").agg(F.sum("size").alias("words"))
    own = {r["source"]: r["s"] for r in pairs.groupBy("source").agg(F.sum("words").alias("s")).collect()}
    goal = {s: round(t) for s, t in mixing.targets(own, {s: 1 + i % 3 for i, s in enumerate(own)}).items()}
    one, _ = sums()
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 120)  # three groups a node, several levels
    assert pairs.count() > 120
    routed = mixing._routed(pairs, once, goal).collect()
    got = collections.Counter()
    for r in routed:
        assert 0 <= r["amount"] <= 3 * r["words"]
        got[r["source"]] += r["amount"]
    assert len(routed) == pairs.count() and got == collections.Counter(goal)
    many, copies = sums()
    assert many.keys() == one.keys()
    kept = mixing.selected(docs).groupBy("doc_id").count().collect()  # a run of its own
    assert {r["doc_id"]: r["count"] for r in kept} == copies


def test_discriminant_by_its_formula():
    """The margin against densities from explicit covariances, inverses and determinants."""
    rng = np.random.default_rng(7)
    w = quality.WIDTH
    own = [rng.normal(size=(300, w)) @ rng.normal(size=(w, w)) + k for k in (0, 1)]
    sums = {k: np.concatenate([[len(v)], v.sum(axis=0), (v.T @ v).reshape(-1)]) for k, v in enumerate(own)}
    model = quality._gaussians(sums, 0.2, 0.1)
    x = rng.normal(size=(50, w))
    spread = [np.cov(v.T, bias=True) for v in own]
    density = []
    for k in (0, 1):
        c = 0.8 * spread[k] + 0.2 * (spread[0] + spread[1]) / 2
        c = 0.9 * c + 0.1 * np.trace(c) / w * np.eye(w)
        d = x - own[k].mean(axis=0)
        density.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.linalg.slogdet(c)[1]))
    assert np.allclose(model.margin(x), np.clip(density[1] - density[0], -quality._REACH, quality._REACH), atol=1e-6)


def test_counts_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FAN", 2)
    rows = spark.createDataFrame([(i, f"w{i % 5} a b c d e") for i in range(60)], "doc_id long, text string")
    one = jaccard._counts(jaccard._measured(rows.coalesce(1)))
    assert one.sum() == 120 and (jaccard._counts(jaccard._measured(rows.repartition(17))) == one).all()


@given(st.integers(0, 60), st.lists(st.integers(0, 15), max_size=6), st.integers(1, 3))
def test_nearest_sum(amount, sizes, room):
    got = mixing._nearest(amount, sizes, room)
    assert all(0 <= n <= room for n in got)
    sums = {0}
    for s in sizes:
        sums = {x + s * k for x in sums for k in range(room + 1)}
    assert abs(sum(n * s for n, s in zip(got, sizes, strict=True)) - amount) == min(abs(x - amount) for x in sums)


def test_ids_that_many_texts_share_bring_each_text_once(spark, monkeypatch):
    """Near copies under one null id, one repeated id, and rows alike in both."""
    base = [f"w{i}" for i in range(80)]
    rows = [(None if i % 2 else 7, " ".join([*base, f"end{i}"])) for i in range(60)] + [(None, " ".join([*base, "end1"]))] * 5
    moved = []
    plain = jaccard._shingled
    monkeypatch.setattr(jaccard, "_shingled", lambda texts: moved.append(texts.count()) or plain(texts))
    found = jaccard.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert moved == [60] and len(found) == 65 and {r["component_id"] for r in found} == {7}


def test_segments_are_the_best_by_rarity_content_and_place():
    """Content is what a place's shingles add up to; half the places are kept, the rarest shingle's first, empty ones last."""
    rng = np.random.default_rng(3)
    ranks = rng.integers(0, 9, jaccard.SLOTS, dtype=np.uint8)
    for n in (1, 2, 40, 900):
        s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        want = []
        for k, d in jaccard.bands_of(len(s)):
            m = 2 * (d + 1)
            low = (m - 1).bit_length()
            held = {p: [256, 0] for p in range(m)}
            for x, at, v in zip(s.tolist(), (jaccard.mix(s ^ np.uint64((k + 1) * 0x51ED270B)) % np.uint64(m)).tolist(), jaccard.mix(s + jaccard._SPREAD).tolist(), strict=True):
                held[at] = [min(held[at][0], int(ranks[x % jaccard.SLOTS])), (held[at][1] + v) % (1 << 64)]
            best = sorted(held, key=lambda p: (held[p][0], held[p][1] >> 9 >> low, p))[: d + 1]
            salt = jaccard.mix(np.array(best, np.uint64) * jaccard._SPREAD + np.uint64(k))
            want += jaccard.mix(np.array([held[p][1] for p in best], np.uint64) + salt).tolist()
        assert jaccard.segments(s, ranks).tolist() == want
    t, u = jaccard.THRESHOLD.numerator, jaccard.THRESHOLD.denominator
    assert all(jaccard.most_apart(a, b) * (u + t) <= (a + b) * (u - t) < (jaccard.most_apart(a, b) + 1) * (u + t) for a in range(1, 60) for b in range(1, 60))
