"""Quotient filters by round trips, phrases by a plain count of everything."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from passagework.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string"
LOWER = {i: i + 32 for i in range(65, 91)}


def plainly(rows, least=10, top=2000, share=50):
    """The digest's rows as sets of tuples, by counters over all phrases."""
    n, f = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    held = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for (lang, *w), a in held.items():
        score, k = min((1_000_000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w)))
        if not any(100 * b >= share * a for q, b in held.items() if len(q) == 4 and len(w) == 2 and q[0] == lang and (list(q[1:3]) == w or list(q[2:4]) == w)):
            out.append((lang, -score, -a, " ".join(w).encode(), f[lang, *w[:k]], f[lang, *w[k:]]))
    found = []
    for lang in n:
        own = sorted(x for x in out if x[0] == lang)[:top]
        found += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (_, s, a, p, l, r) in enumerate(own, 1)]  # noqa: E741
    return sorted(found)


def got(df):
    return sorted(tuple(r[k] for k in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def made(seed, docs):
    r = random.Random(seed)
    words = ["the", "The", "of", "naïve", "Éa", "日本", "x" * 40, "a.b", "-", "10,000"] + [f"w{i}" for i in range(30)]
    text = lambda: "".join(r.choice(words[: r.choice([4, 12, 40])]) + r.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\x0b"]) for _ in range(r.randint(0, 80)))
    return [(i, text(), r.choice(["en", "en", "fr", None, ""])) for i in range(docs)] + [(1, None, "en"), (1, "", None), (2, " \t. ", "none")]


@given(st.integers(2, 63), st.integers(0, 2**63 - 1), st.integers(0, 2**63 - 1))
@settings(max_examples=300, deadline=None)
def test_permutation_is_undone(bits, x, y):
    x, y = (np.array([v & ((1 << bits) - 1)], np.uint64) for v in (x, y))
    a, b = c.permute(x, y, bits)
    assert max(a[0], b[0]) < 1 << bits
    assert [v.tolist() for v in c.restore(a, b, bits)] == [x.tolist(), y.tolist()]


@pytest.mark.parametrize("b", [2, 8, 20, 42])
@pytest.mark.parametrize("n", [2, 3])
def test_ids_are_packed_and_unpacked(n, b):
    r = np.random.default_rng(b)
    ids = [r.integers(0, 1 << b, 500).astype(np.uint64) for _ in range(n)]
    left, right = c.packed(ids, b)
    assert max(int(left.max()), int(right.max())) < 1 << c.half_bits(n, b)
    assert [x.tolist() for x in c.unpacked(left, right, n, b)] == [x.tolist() for x in ids]


@pytest.mark.parametrize(("bits", "split", "size"), [(2, 1, 5), (12, 3, 900), (30, 0, 5000), (63, 10, 3000), (63, 63, 4), (9, 9, 300), (40, 4, 1)])
def test_filters_are_lossless(bits, split, size):
    r = np.random.default_rng(size)
    left, right = (r.integers(0, 1 << min(bits, 62), size).astype(np.uint64) for _ in range(2))
    entries = c.counted(left, right, r.choice([1, 2, 254, 255, 256, 10**12], size))
    back = [c.decoded(data, part, bits - split, bits) for part, data in c._split(*entries, split, bits)]
    for was, now in zip(entries, map(np.concatenate, zip(*back, strict=True)), strict=True):
        assert was.tolist() == now.tolist()


def test_filters_are_compact():
    r = np.random.default_rng(0)
    left, right = (r.integers(0, 1 << 20, 100_000).astype(np.uint64) for _ in range(2))
    entries = c.counted(left, right, np.ones(100_000, np.int64))
    assert sum(len(x) for _, x in c._split(*entries, 2, 20)) < 6 * len(entries[0])  # 24 bytes as three numbers


@pytest.mark.parametrize(("least", "entries", "round_bits"), [(10, c.ENTRIES, c.ROUND_BITS), (2, 60, 2), (1, 500, 3)])
def test_phrases_equal_plain_counts(spark, monkeypatch, least, entries, round_bits):
    """Also where filters are merged in many rounds and shards are a few texts each."""
    monkeypatch.setattr(c, "ROUND_BITS", round_bits)
    monkeypatch.setattr(c, "SHARD_BYTES", 4000 if entries < 1000 else c.SHARD_BYTES)
    rows = made(5, 200)
    df = spark.createDataFrame([(*x, "n", 3) for x in rows], SCHEMA + ", words string, shard int").repartition(3)
    found = c.standing(c.phrases(df, least, entries))
    want = plainly(rows, least, 10**6)
    assert sorted((r["lang"], " ".join(w for w in (r["w1"], r["w2"], r["w3"]) if w is not None), r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found.collect()) == sorted((x[0], *x[2:]) for x in want)


def test_ranks_and_ties(spark):
    rows = [(i, t, "en") for i, t in enumerate(["b c. a b", "a b, c d", "c d; B C", "e f g"] * 12)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(c.digest(df)) == plainly(rows)
    assert got(c.digest(df, top=3)) == [x for x in plainly(rows) if x[1] <= 3]
    assert [x[2] for x in got(c.digest(df)) if x[1] == 1] == ["e f g"]


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n = [(999_999_999_989, 10**13 + 37, 10**13 - 3), (10**15 - 1, 10**15 - 1, 10**15 - 1), (10, 10, 11)]
    df = spark.createDataFrame(n, "a long, l long, r long").select("a", "l", "r", c._score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert {tuple(r) for r in df.collect()} == {(a, l, r, 1_000_000 * a * a // (l * r)) for a, l, r in n}  # noqa: E741


def test_edges(spark, empty, edge):
    assert c.digest(empty).collect() == []
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in edge.collect()]
    assert got(c.digest(edge)) == plainly(rows)
