"""N-gram Jaccard join by parity sketches; no link is missed.

A document's set holds its distinct word shingles. Sets with Jaccard similarity t or more differ
in at most D = (1-t)/(1+t) * (|A|+|B|) shingles. Hashing a set's shingles by XOR into a bit array
gives a parity sketch; every differing shingle flips one bit, so the Hamming distance of two
sketches is at most the size of the difference, for sketches of any length.

Candidates: sizes fall into bands. The wide sketch of a band has m = 2(D+1) segments, with D the
largest difference a pair of the band can have; a shingle belongs to one segment and each
differing shingle changes one, so at least m - D segments of a linked pair agree. All segments
are ranked by what they hold, common content last, and only the first D+1 of each document are
joined on: at most m-D-1 are left out, so the best ranked of the segments that agree is among
those of both. Ranks use counts of shingles over all documents, kept in a table of fixed size;
they decide how much work is done, never what is found.

Candidate pairs pass a size test, then a test of narrow parity sketches, and are then verified on
the sets. Copies of one set are a single class throughout. Candidates meet in rounds: first
each holder of a segment meets the segment's least holder, which links groups of near copies by
as many pairs as documents; then holders that are still in different components meet each other,
in blocks.

Defined cases: a null text, or one without words, has an empty set and is linked with nothing; a
text of fewer words than a shingle is one shingle; repeated rows are copies; rows of one doc_id
with different texts are told apart until the last step, where each row gets its own component's
smallest doc_id; a null doc_id is no smallest one unless its component has no other; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blobs, met, slices, written
from .words import mix, shingle_sets

WORDS, THRESHOLD = 5, Fraction(3, 4)
#: Slots of the table of shingle counts, whatever the input.
SLOTS = 1 << 22
_SLOT_CHUNK = 1 << 17
#: Tables of counts that one task adds up.
FAN = 64
#: Segment entries per bucket aimed at, and held in a task before they are sent.
BUCKET_ENTRIES, HELD_ENTRIES = 1_000_000, 1_000_000
#: Holders of a segment meet pair by pair up to this number, beyond it in blocks by sketch.
FEW_HOLDERS, BLOCK_HOLDERS = 24, 512
#: So many of a holder's first segments tell whether two holders meet in an earlier one.
FIRST_SEGMENTS = 8
#: Rounds in which a holder meets only the nearest one of another component, before all meet.
NEAREST_ROUNDS = 1
_BAND = 16 / 9
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def most_apart(a: int, b: int) -> int:
    """The largest symmetric difference of linked sets of a and b shingles."""
    t, u = THRESHOLD.numerator, THRESHOLD.denominator
    return (a + b) * (u - t) // (u + t)


def band(n: int) -> tuple[int, int]:
    """(number, exclusive upper size limit) of the size band of ``n``."""
    k = 0
    top = 2
    while top <= n:
        k += 1
        top = max(top + 1, int(top * _BAND))
    return k, top


@lru_cache(1 << 16)
def bands_of(n: int) -> list[tuple[int, int]]:
    """(band, D) in which a set of ``n`` takes part: a pair meets in its smaller set's band."""
    out, (k, top) = [], band(n)
    low = band_floor(k)
    out.append((k, top))
    if k and -(-n * THRESHOLD.numerator // THRESHOLD.denominator) < low:  # a smaller partner may lie below
        out.append((k - 1, low))
    return [(j, most_apart(t - 1, (t - 1) * THRESHOLD.denominator // THRESHOLD.numerator)) for j, t in out]


def band_floor(k: int) -> int:
    top = 2
    low = 0
    for _ in range(k):
        low, top = top, max(top + 1, int(top * _BAND))
    return low


def sketch(s: np.ndarray) -> bytes:
    """Narrow parity sketch: the power of two of bits that is at least four times the set's size."""
    bits = 64
    while bits < 4 * len(s):
        bits *= 2
    flips = np.bincount((mix(s * _SPREAD) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def _folded(b: bytes, size: int) -> np.ndarray:
    """The same sketch on fewer bits: parity is linear, so parts are added by XOR."""
    return np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, size // 8), axis=0)


def apart_at_least(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    return int(np.bitwise_count(_folded(a, size) ^ _folded(b, size)).sum())


@lru_cache(32)
def _salt(k: int, m: int) -> np.ndarray:
    """A number of each place of band ``k``, whose wide sketch has ``m`` of them."""
    return mix(np.arange(m, dtype=np.uint64) * _SPREAD + np.uint64(k))


def segments(s: np.ndarray, commonness: np.ndarray) -> np.ndarray:
    """Signatures of the segments on which a set takes part in the join."""
    out = []
    slots = commonness[(s & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64)
    mixed = mix(s + _SPREAD)
    for k, d in bands_of(len(s)):
        m = 2 * (d + 1)
        at = (mix(s ^ np.uint64((k + 1) * 0x51ED270B)) % np.uint64(m)).astype(np.int64)
        content = np.zeros(m, np.uint64)
        np.add.at(content, at, mixed)
        # The rarest shingle of a segment ranks it; an empty one is the commonest of all.
        rank = np.full(m, 256, np.uint64)
        np.minimum.at(rank, at, slots)
        # One number orders a segment by rank, content and place, and ends in its place.
        low = np.uint64((m - 1).bit_length())
        order = rank << np.uint64(55) | content >> np.uint64(9) >> low << low | np.arange(m, dtype=np.uint64)
        chosen = (np.sort(order)[: d + 1] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
        out.append(mix(content[chosen] + _salt(k, m)[chosen]))
    return np.concatenate(out)


def _sets(raw: list[bytes]) -> list[np.ndarray]:
    return shingle_sets([t.lower() for t in raw], WORDS)


def _digest(s: np.ndarray) -> int:
    """A signed 64-bit name of a set; with its size, what tells sets apart before verification."""
    v = int(np.bitwise_xor.reduce(mix(s ^ _SPREAD))) ^ (int(mix(s * _SPREAD + np.uint64(7)).sum(dtype=np.uint64)) * 0xD6E8FEB86659FD93)
    v &= (1 << 64) - 1
    return v - (1 << 64) if v >> 63 else v


def _measured(docs: DataFrame) -> DataFrame:
    """Per row (doc_id, n, set, sketch) and its other columns, and rows (slot chunk, counts) per
    task, in one pass."""
    keyed = {c: {"bigint": pa.int64(), "string": pa.string()}[t] for c, t in docs.dtypes if c not in ("doc_id", "text")}
    names = ["doc_id", "n", "set", "sketch", "chunk", "counts", *keyed]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.uint32)
        for b in slices(batches):
            sets = _sets(blobs(b))
            if some := [s for s in sets if len(s)]:
                at, n = np.unique(np.concatenate(some) & np.uint64(SLOTS - 1), return_counts=True)
                counts[at.astype(np.int64)] += n.astype(np.uint32)
            n = len(sets)
            yield pa.record_batch(
                [
                    b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else 0 for s in sets], pa.int64()),
                    pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
                    *(b.column(c) for c in keyed),
                ],
                names=names,
            )
        chunks = range(SLOTS // _SLOT_CHUNK)
        blob = [zlib.compress(counts[c * _SLOT_CHUNK : (c + 1) * _SLOT_CHUNK].astype("<i8").tobytes(), 1) for c in chunks]
        k = len(blob)
        yield pa.record_batch(
            [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(chunks, pa.int32()), pa.array(blob, pa.binary()), *(pa.nulls(k, t) for t in keyed.values())],
            names=names,
        )

    return docs.mapInArrow(go, "doc_id long, n long, set long, sketch binary, chunk int, counts binary" + "".join(f", {c} {'long' if t == pa.int64() else 'string'}" for c, t in keyed.items()))


def _counts(measured: DataFrame) -> np.ndarray:
    """The table of shingle counts: SLOTS numbers, added up by chunk in a tree, FAN tables at a time."""

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(_SLOT_CHUNK, np.int64)
        for x in group["counts"]:
            total += np.frombuffer(zlib.decompress(x.as_py()), "<i8")
        return pa.table({"chunk": group["chunk"].slice(0, 1), "node": group["node"].slice(0, 1), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    at = measured.where("chunk is not null").select("chunk", F.spark_partition_id().alias("node"), "counts")
    for _ in range(3):  # FAN**3 tasks, beyond that the last tables are larger groups
        at = at.withColumn("node", F.floor(F.col("node") / FAN).cast("int")).groupBy("chunk", "node").applyInArrow(add, "chunk int, node int, counts binary")
    rows = at.groupBy("chunk").applyInArrow(add, "chunk int, node int, counts binary").collect()  # SLOTS numbers
    out = np.zeros(SLOTS, np.int64)
    for r in rows:
        out[r["chunk"] * _SLOT_CHUNK : (r["chunk"] + 1) * _SLOT_CHUNK] = np.frombuffer(zlib.decompress(r["counts"]), "<i8")
    return out


def _entries(docs: DataFrame, counts: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, entries): signatures of all segments, packed by bucket.

    A block of bytes holds k, then k set names and sizes, then entries of a signature's low
    half and the position of its set. A set is sent once per block, so copies that a task holds
    together count once.
    """
    # Quarter powers of two are fine enough to rank by: SLOTS bytes.
    table = docs.sparkSession.sparkContext.broadcast((4 * np.log2(1 + counts)).astype(np.uint8))

    def flush(sets: list[tuple[int, int]], held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sig = np.concatenate(held)
        who = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x) for x in held])
        to = ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(to, kind="stable")
        sig, who, to = sig[order], who[order], to[order]
        names = np.array(sets, np.int64)
        edge = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])).tolist() + [len(to)]
        out_b, out_e = [], []
        for a, z in zip(edge[:-1], edge[1:], strict=True):
            own, local = np.unique(who[a:z], return_inverse=True)
            small = len(own) < 1 << 16
            out_b.append(int(to[a]))
            out_e.append(
                np.array([len(own)], "<u4").tobytes() + names[own].astype("<i8").tobytes() + (sig[a:z] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + local.astype("<u2" if small else "<u4").tobytes()
            )
            if len(out_b) >= 256:
                yield pa.record_batch([pa.array(out_b, pa.int64()), pa.array(out_e, pa.binary())], names=["bucket", "entries"])
                out_b, out_e = [], []
        if out_b:
            yield pa.record_batch([pa.array(out_b, pa.int64()), pa.array(out_e, pa.binary())], names=["bucket", "entries"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        sets, held, n = [], [], 0
        for b in slices(batches):
            for s in _sets(blobs(b)):
                if len(s) and (name := (_digest(s), len(s))) not in seen:
                    seen.add(name)
                    sets.append(name)
                    held.append(segments(s, table.value))
                    n += len(held[-1])
                    if n > HELD_ENTRIES:
                        yield from flush(sets, held)
                        seen, sets, held, n = set(), [], [], 0
        if held:
            yield from flush(sets, held)

    return docs.mapInArrow(go, "bucket long, entries binary")


def _shared(entries: DataFrame) -> DataFrame:
    """(sig, set, n): holders of every segment that more than one set holds."""

    def meet(group: pa.Table) -> pa.Table:
        sigs, sets, sizes = [], [], []
        for x in group["entries"]:
            raw = x.as_buffer()
            k = int(np.frombuffer(raw, "<u4", 1)[0])
            names = np.frombuffer(raw, "<i8", 2 * k, 4).reshape(k, 2)
            width = 2 if k < 1 << 16 else 4
            n = (len(raw) - 4 - 16 * k) // (4 + width)
            sig = np.frombuffer(raw, "<u4", n, 4 + 16 * k)
            local = np.frombuffer(raw, f"<u{width}", n, 4 + 16 * k + 4 * n)
            sigs.append(sig)
            sets.append(names[local, 0])
            sizes.append(names[local, 1])
        sig, name, size = np.concatenate(sigs), np.concatenate(sets), np.concatenate(sizes)
        order = np.lexsort((name, sig))
        sig, name, size = sig[order], name[order], size[order]
        fresh = np.concatenate([[True], (sig[1:] != sig[:-1]) | (name[1:] != name[:-1])])
        sig, name, size = sig[fresh], name[fresh], size[fresh]
        alike = sig[1:] == sig[:-1]
        shared = np.concatenate([[False], alike]) | np.concatenate([alike, [False]])
        bucket = np.int64(group["bucket"][0].as_py()) << np.int64(32)
        return pa.table({"sig": pa.array(bucket | sig[shared].astype(np.int64)), "set": pa.array(name[shared]), "n": pa.array(size[shared])})

    return entries.groupBy("bucket").applyInArrow(meet, "sig long, set long, n long")


def _sized(a: str, b: str):
    """Whether two sizes allow a link."""
    t, u = THRESHOLD.numerator, THRESHOLD.denominator
    return F.least(F.col(a), F.col(b)) * u >= F.greatest(F.col(a), F.col(b)) * t


def _close(pairs: DataFrame) -> DataFrame:
    """Pairs (a, n_a, sketch_a, b, n_b, sketch_b) whose sketches allow a link."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            cols = [b.column(c).to_pylist() for c in ("n_a", "n_b", "sketch_a", "sketch_b")]
            ok = [apart_at_least(x, y) <= most_apart(n, m) for n, m, x, y in zip(*cols, strict=True)]
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return pairs.mapInArrow(go, "a long, b long")


def _shingled(texts: DataFrame) -> DataFrame:
    """(set, shingles) of (set, text), for the texts that have that set."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            held = [(k, s.tobytes()) for k, s in zip(b.column("set").to_pylist(), _sets(blobs(b)), strict=True) if len(s) and _digest(s) == k]
            yield pa.record_batch([pa.array([k for k, _ in held], pa.int64()), pa.array([s for _, s in held], pa.binary())], names=["set", "shingles"])

    return texts.mapInArrow(go, "set long, shingles binary")


def _verified(shingled: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of set names whose sets are linked, by the sets themselves."""
    both = pairs.join(shingled.withColumnsRenamed({"set": "a", "shingles": "sa"}), "a").join(shingled.withColumnsRenamed({"set": "b", "shingles": "sb"}), "b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ok = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(common * THRESHOLD.denominator >= (len(s) + len(t) - common) * THRESHOLD.numerator)
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(test, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(set, root): the least set reachable by links, for every set that has one.

    Each round points every set to the least root among its neighbours and shortens paths;
    rounds are written to the shared folder and end when nothing changes.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    roots = written(both.groupBy(F.col("a").alias("set")).agg(F.min("b").alias("m")).select("set", F.least("set", "m").alias("root")))
    while True:
        near = both.join(roots, both["b"] == roots["set"]).groupBy("a").agg(F.min("root").alias("near"))
        step = roots.join(near, roots["set"] == near["a"]).select("set", "root", F.least("root", "near").alias("low"))
        # The old root learns of the lower one as well, and everyone takes its root's root.
        hook = step.where("low < root").groupBy(F.col("root").alias("at")).agg(F.min("low").alias("hook"))
        step = written(step.join(hook, step["set"] == hook["at"], "left").select("set", "root", F.least("low", "hook").alias("low")))
        up = step.select(F.col("set").alias("at"), F.col("low").alias("up"))
        nxt = written(step.join(up, step["low"] == up["at"]).select("set", F.least("low", "up").alias("next"), "root"))
        if nxt.where("next <> root").isEmpty():
            return nxt.select("set", F.col("next").alias("root"))
        roots = nxt.select("set", F.col("next").alias("root"))


def _mixed(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(sig, set, n, root, k) of the segments whose k holders lie in several components."""
    placed = shared.join(roots, "set", "left").select("sig", "set", "n", F.coalesce("root", "set").alias("root"))
    spread = placed.groupBy("sig").agg(F.count("*").alias("k"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    return placed.join(spread.where("lo <> hi").select("sig", "k"), "sig")


def _few(mixed: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components within segments of at most FEW_HOLDERS holders."""
    own = mixed.where(F.col("k") <= FEW_HOLDERS)
    side = lambda c: own.select("sig", F.col("set").alias(c), F.col("n").alias(f"n_{c}"), F.col("root").alias(f"root_{c}"))
    met = side("a").join(side("b"), "sig").where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & _sized("n_a", "n_b"))
    return met.select("a", "b").distinct()


def _many(mixed: DataFrame, known: DataFrame, nearest: bool) -> DataFrame:
    """Pairs (a, b) of different components within segments of more holders, whose sizes and
    sketches allow a link; with ``nearest`` only the pairs of each holder and its nearest.

    A segment is dealt in blocks by pairs of parts, so that no task holds more than two parts.
    Two holders that are known to meet in an earlier segment don't meet again.
    """
    large = mixed.where(F.col("k") > FEW_HOLDERS)
    low = large.groupBy("set").agg(F.slice(F.array_sort(F.collect_set("sig")), 1, FIRST_SEGMENTS).alias("low"))  # D + 1 segments at most
    own = large.withColumn("parts", F.ceil(F.col("k") / BLOCK_HOLDERS)).withColumn("part", F.pmod(F.xxhash64("set"), F.col("parts")))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda q: F.struct(F.least("part", q).alias("p"), F.greatest("part", q).alias("q")))
    tiles = own.join(known.select("set", "sketch").join(low, "set"), "set").withColumn("tile", F.explode(pair)).select("sig", "tile.p", "tile.q", "part", "set", "n", "sketch", "root", "low")

    def meet(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n", "ascending"), ("set", "ascending")])
        n, root, name, part = (group[c].to_numpy() for c in ("n", "root", "set", "part"))
        p, q = group["p"][0].as_py(), group["q"][0].as_py()
        raw = group["sketch"].to_pylist()
        width = min(map(len, raw))
        rows = np.array([_folded(x, width) for x in raw])
        sig = group["sig"][0].as_py()
        before = np.array([(x + [sig] * FIRST_SEGMENTS)[:FIRST_SEGMENTS] for x in group["low"].to_pylist()], np.int64)
        a, b = [], []
        best, mate = np.full(len(n), 1 << 40), np.full(len(n), -1)
        for i in range(len(n) - 1):
            hi = int(np.searchsorted(n, n[i] * THRESHOLD.denominator // THRESHOLD.numerator, side="right"))
            j = np.arange(i + 1, hi)
            j = j[root[j] != root[i]]
            if p != q:
                j = j[part[j] != part[i]]
            if len(j):
                far = np.bitwise_count(rows[j] ^ rows[i]).sum(axis=1).astype(np.int64)
                limit = (n[j] + n[i]) * (THRESHOLD.denominator - THRESHOLD.numerator) // (THRESHOLD.denominator + THRESHOLD.numerator)
                ok = far <= limit
                j, far = j[ok], far[ok]
                earlier = before[i][before[i] < sig]
                if len(earlier) and len(j):
                    new = ~np.isin(before[j], earlier).any(axis=1)
                    j, far = j[new], far[new]
                if not nearest:
                    a += [name[i]] * len(j)
                    b += name[j].tolist()
                elif len(j):
                    closer = far < best[j]
                    best[j[closer]], mate[j[closer]] = far[closer], i
                    k = int(far.argmin())
                    if far[k] < best[i]:
                        best[i], mate[i] = far[k], j[k]
        if nearest:
            i = np.flatnonzero(mate >= 0)
            a, b = name[i], name[mate[i]]
        x, y = np.minimum(a, b), np.maximum(a, b)
        return pa.table({"a": pa.array(x.astype(np.int64)), "b": pa.array(y.astype(np.int64))})

    return tiles.groupBy("sig", "p", "q").applyInArrow(meet, "a long, b long").distinct()


def classes(docs: DataFrame, key: Column | None = None) -> DataFrame:
    """(doc_id, n_shingles, set, component_id, root) per row of (doc_id, text), and its ``key``.

    ``set`` names the class of documents with equal sets; component_id is the least doc_id
    reachable by links, the document's own where there are none; ``root`` names the component,
    and is null for a row without words.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("said"), *([key.alias("key")] if key is not None else []))
    kept_key = ["key"] if key is not None else []
    measured = written(_measured(rows))
    counts = _counts(measured)
    own = measured.where("chunk is null").select("doc_id", "said", "n", "set", "sketch", *kept_key)
    total = own.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-int(total) * 6 // 10 // BUCKET_ENTRIES))
    shared = written(_shared(_entries(rows.select("doc_id", "text"), counts, buckets)))
    alike = own.where("n > 0").groupBy("set", "doc_id", "said").agg(F.count("*").alias("alike"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    held = alike.groupBy("set").agg(F.min(F.struct("doc_id", "said", "alike")).alias("r"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    known = written(held.join(shared.select("set").distinct(), "set", "left_semi").select("set", "r.*", "n", "sketch"))
    # Only sets that share a segment can be in a pair: their shingles are made and moved once, from one
    # row each. An id alone may be that of many texts, or none; of rows alike in id and text any one will do.
    of = known.select("set", F.col("doc_id").alias("doc"), F.col("said").alias("as"), "alike")
    same = rows["doc_id"].eqNullSafe(F.col("doc")) & (rows["said"] == F.col("as"))
    texts = rows.join(of.where("alike = 1"), same).select("set", "text")
    if not (several := of.where("alike > 1")).isEmpty():
        texts = texts.unionByName(rows.join(several, same).select("set", "text").dropDuplicates(["set"]))
    shingled = written(_shingled(texts))

    def sketched(pairs: DataFrame) -> DataFrame:
        side = lambda c: known.select(F.col("set").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
        return _close(pairs.join(side("a"), "a").join(side("b"), "b").where(_sized("n_a", "n_b")))

    pivot = shared.groupBy("sig").agg(F.min("set").alias("a"))
    first = shared.join(pivot, "sig").select("a", F.col("set").alias("b")).where("a <> b").distinct()
    links = written(_verified(shingled, written(sketched(first))))
    roots = components(links)
    for k in range(NEAREST_ROUNDS + 1):
        mixed = written(_mixed(shared, roots))
        if nearest := k < NEAREST_ROUNDS and not mixed.where(F.col("k") > FEW_HOLDERS).isEmpty():
            across = sketched(_many(mixed, known, True))
        else:
            across = sketched(_few(mixed)).unionByName(sketched(_many(mixed, known, False))).distinct()
        more = written(_verified(shingled, written(across)))
        if not more.isEmpty():
            links = links.union(more)
            roots = components(links)
        elif nearest:  # merging has come to rest; what is left meets in full
            across = sketched(_few(mixed)).unionByName(sketched(_many(mixed, known, False))).distinct()
            more = written(_verified(shingled, written(across)))
            if not more.isEmpty():
                roots = components(links.union(more))
            break
        if not nearest:
            break
    least = written(own.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies")).join(roots, "set", "left").withColumn("root", F.coalesce("root", "set")))
    first_doc = least.groupBy("root").agg(F.min("doc").alias("component_id"), F.count("*").alias("k"))
    named = written(met(least, first_doc, "root", "k").select("set", "component_id", "root", "copies"))
    none = F.lit(None).cast("long")
    empty = own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), none.alias("set"), F.col("doc_id").alias("component_id"), none.alias("root"), *kept_key)
    return met(own.where("n > 0"), named, "set", "copies").select("doc_id", F.col("n").alias("n_shingles"), "set", "component_id", "root", *kept_key).unionByName(empty)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's row of every document."""
    return classes(docs).select("doc_id", "n_shingles", "component_id")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, one of each component: that of the least doc_id, of several texts of
    that id the one with the least hash. Every row without words stays."""
    text = F.col("text").cast("string")
    key = F.sha2(text, 256)
    found = classes(docs, key).where("root is not null").groupBy("root", "doc_id", "key").agg(F.count("*").alias("copies"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "key", "copies")).alias("r"))
    mark = "__"
    while any(c.lower().startswith(mark) for c in docs.columns):  # a prefix that no column of the input has
        mark += "_"
    kept = written(first.select(F.col("r.doc_id").alias(f"{mark}id"), F.col("r.key").alias(f"{mark}key"), F.col("r.copies").alias(f"{mark}copies")))
    wordless = ~F.coalesce(text, F.lit("")).rlike(r"[^ \t\n\x0B\f\r]")
    rest = docs.where(~wordless).withColumn(f"{mark}text_key", key)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{mark}id")) & (F.col(f"{mark}text_key") == F.col(f"{mark}key"))
    out = rest.join(kept.where(f"{mark}copies = 1"), same, "left_semi")
    if not (several := kept.where(f"{mark}copies > 1")).isEmpty():  # rows alike in id and text: any one of them
        out = out.unionByName(rest.join(several, same, "left_semi").dropDuplicates(["doc_id", f"{mark}text_key"]))
    return out.drop(f"{mark}text_key").unionByName(docs.where(wordless))
