"""Homomorphic multiset fingerprints of documents.

A paragraph (line) gives a wide vector; a document's fingerprint is the sum of its paragraphs'
vectors, each lane modulo a power of two. Sums don't depend on order, a paragraph can be added or
taken away without the rest, and the sum of two fingerprints is that of both texts together.

Lanes: 32 of 32 bits, all set by the paragraph's hash (equality); 512 of 8 bits in 8 levels of
halving density, each hit by the paragraph's word trigrams (likeness); two 64-bit counts, of
paragraphs and of trigrams. The number of unequal lanes tells how many trigrams differ, and with
the counts their multiset Jaccard similarity (standard error of that number about a tenth).

Defined cases: a null text counts as empty and its fingerprint is all zero; an empty line is a
paragraph too; equal texts have equal fingerprints; repeated rows each give their row; rows of
one doc_id are ordered by text; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .words import mix, word_hashes

DENSE, LEVELS, LANES, GRAM = 32, 8, 64, 3
_SALTS = mix(np.arange(1, DENSE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: How many lanes are unequal on average when that many trigrams differ.
_DIFFER = np.concatenate([[0], np.geomspace(1, 1 << 22, 4000)])
_SHARES = [0.5 ** (i + 1) for i in range(LEVELS - 1)] + [0.5 ** (LEVELS - 1)]
_UNEQUAL = sum(LANES * -np.expm1(_DIFFER * p * np.log1p(-1 / LANES)) for p in _SHARES)
_M = [np.uint64(pow(0xBF58476D1CE4E5B9, j + 1, 1 << 64)) for j in range(GRAM)]


class Fingerprint:
    """Lanes of a multiset of paragraphs; add and subtract to insert and delete."""

    __slots__ = ("dense", "sketch", "paragraphs", "grams")

    def __init__(self, dense: np.ndarray, sketch: np.ndarray, paragraphs: int, grams: int):
        self.dense, self.sketch, self.paragraphs, self.grams = dense, sketch, paragraphs, grams

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.dense + other.dense, self.sketch + other.sketch, self.paragraphs + other.paragraphs, self.grams + other.grams)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.dense - other.dense, self.sketch - other.sketch, self.paragraphs - other.paragraphs, self.grams - other.grams)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Fingerprint) and self.text() == other.text()

    def __hash__(self) -> int:
        return hash(self.text())

    def text(self) -> str:
        counts = np.array([self.paragraphs, self.grams], "<i8").tobytes()
        return base64.b64encode(counts + self.dense.astype("<u4").tobytes() + self.sketch.tobytes()).decode()

    @staticmethod
    def parse(s: str) -> Fingerprint:
        raw = base64.b64decode(s)
        counts = np.frombuffer(raw[:16], "<i8")
        return Fingerprint(np.frombuffer(raw[16 : 16 + 4 * DENSE], "<u4").astype(np.uint32), np.frombuffer(raw[16 + 4 * DENSE :], np.uint8).copy(), int(counts[0]), int(counts[1]))

    def likeness(self, other: Fingerprint) -> float:
        """Estimated Jaccard similarity of the trigram multisets; 1 only if the lanes agree."""
        if np.array_equal(self.dense, other.dense) and np.array_equal(self.sketch, other.sketch):
            return 1.0
        n = self.grams + other.grams
        if not n:
            return 0.0
        odd = int(np.count_nonzero(self.sketch != other.sketch))
        d = float(np.interp(odd, _UNEQUAL, _DIFFER))
        d = min(max(d, abs(self.grams - other.grams)), n)
        return min((n - d) / (n + d), 1 - 1 / (n + 1))


def fingerprints(texts: list[bytes]) -> list[Fingerprint]:
    lines = [t.split(b"\n") if t else [] for t in texts]
    flat = [x for own in lines for x in own]
    if not flat:
        return [Fingerprint(np.zeros(DENSE, np.uint32), np.zeros(LEVELS * LANES, np.uint8), 0, 0) for _ in texts]
    own = np.repeat(np.arange(len(texts)), [len(x) for x in lines])
    keys = np.array([xxhash.xxh3_64_intdigest(x) for x in flat], np.uint64)
    more = np.array([xxhash.xxh3_64_intdigest(x, 1) for x in flat], np.uint64)
    dense = np.zeros((len(texts), DENSE), np.uint32)
    for k in range(DENSE):
        lane = (mix(keys ^ _SALTS[k]) + more * _SALTS[k]) >> np.uint64(32)
        total = np.concatenate([[0], np.cumsum(lane, dtype=np.uint64)])
        ends = np.cumsum([len(x) for x in lines])
        starts = ends - [len(x) for x in lines]
        dense[:, k] = (total[ends].astype(np.uint64) - total[starts].astype(np.uint64)).astype(np.uint32)
    h, bounds = word_hashes(flat)
    words = np.diff(bounds)
    line = np.repeat(np.arange(len(flat)), words)
    n = max(0, len(h) - GRAM + 1)
    grams = np.zeros(n, np.uint64)
    for j in range(GRAM):
        grams += h[j : n + j] * _M[j]
    whole = line[:n] == line[GRAM - 1 : n + GRAM - 1]
    grams, of = mix(grams[whole]), own[line[:n][whole]]
    few = np.flatnonzero((words > 0) & (words < GRAM))  # a short line is one item
    grams, of = np.concatenate([grams, mix(keys[few])]), np.concatenate([of, own[few]])
    low = grams & np.uint64((1 << LEVELS - 1) - 1)
    level = np.zeros(len(grams), np.int64)
    for i in range(1, LEVELS):
        level += (low & np.uint64((1 << i) - 1)) == 0
    slot = of * (LEVELS * LANES) + level * LANES + ((grams >> np.uint64(16)) % np.uint64(LANES)).astype(np.int64)
    value = ((grams >> np.uint64(32)) & np.uint64(255)) | np.uint64(1)
    sketch = np.bincount(slot, weights=value.astype(np.float64), minlength=len(texts) * LEVELS * LANES)
    sketch = (sketch.astype(np.int64) & 255).astype(np.uint8).reshape(len(texts), -1)
    n_grams = np.bincount(of, minlength=len(texts))
    return [Fingerprint(dense[i], sketch[i], len(lines[i]), int(n_grams[i])) for i in range(len(texts))]


def _ranged(docs: DataFrame, parts: int) -> DataFrame:
    """(doc_id, text, part, guest): rows dealt to ranges of falling doc_id, every range with a
    copy (guest) of the first row of the next one, the last with that of the first.

    Range limits are quantiles of the ids; a row's range is found by binary search.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = rows.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts)).first() if parts > 1 else None
    limits = sorted(set(cuts[0])) if cuts and cuts[0] else []

    def part_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.array(limits, np.int64)
        for b in slices(batches):
            ids = b.column("doc_id")
            v = ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            part = len(at) - np.searchsorted(at, v, side="left")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part.astype(np.int64))], names=[*b.schema.names, "part"])

    dealt = rows.mapInArrow(part_of, "doc_id long, text string, part long")
    key = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    ids = rows.select("doc_id").mapInArrow(part_of, "doc_id long, part long")
    heads = {r["part"]: r["id"] for r in ids.groupBy("part").agg(F.max(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("id")).collect()}
    order = sorted(heads)
    # Of each range's first id (one row a range): its row goes to the range before as well.
    guests = [(heads[p], order[i - 1]) for i, p in enumerate(order)]
    if not guests:
        return dealt.withColumns({"guest": F.lit(False), "key": key})
    to = F.broadcast(spark.createDataFrame(guests, "id long, before long"))
    first = rows.withColumn("key", key).join(to, F.col("key.id") == F.col("id"))
    first = first.groupBy("before").agg(F.max_by(F.struct("doc_id", "text", "key"), "key").alias("r"))
    guest = first.select("r.doc_id", "r.text", F.col("before").alias("part"), F.lit(True).alias("guest"), "r.key")
    return dealt.withColumns({"guest": F.lit(False), "key": key}).unionByName(guest)


def edited(text: str, following: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + following[:n] if n else text


def scan(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """The contract's row for each input row, in one shuffle of the texts."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _ranged(docs, parts).repartition(parts, "part").sortWithinPartitions(
        "part", "guest", F.col("key.id").desc(), F.col("key.sha").desc()
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in slices(batches):
            yield from zip(*(b.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text")), strict=True)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = None
        for part, guest, i, t in rows(batches):
            t = t or ""
            if held is not None and held[0] == part:
                yield held[1], held[2], t
            held = None if guest else (part, i, t)

    def out(ready: list[tuple]) -> pa.RecordBatch:
        own = [t.encode() for _, t, _ in ready]
        new = [edited(t, f).encode() for _, t, f in ready]
        a, b = fingerprints(own), fingerprints(new)
        c = fingerprints([ready[-1][2].encode()])
        nxt = [a[j + 1] if j + 1 < len(a) and ready[j][2] is ready[j + 1][1] else None for j in range(len(a))]
        loose = [j for j, x in enumerate(nxt) if x is None and j + 1 < len(a)]
        for j, x in zip(loose, fingerprints([ready[j][2].encode() for j in loose]), strict=True):
            nxt[j] = x
        nxt[-1] = c[0]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _, _ in ready], pa.int64()),
                pa.array([len(t) for _, t, _ in ready], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in new]),
                pa.array([x.text() for x in a]),
                pa.array([x.text() for x in b]),
                pa.array([x.likeness(y) for x, y in zip(a, b, strict=True)], pa.float64()),
                pa.array([x.likeness(y) for x, y in zip(a, nxt, strict=True)], pa.float64()),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, size = [], 0
        for p in pairs(batches):
            ready.append(p)
            size += len(p[1])
            if size > 1 << 20:
                yield out(ready)
                ready, size = [], 0
        if ready:
            yield out(ready)

    return dealt.mapInArrow(
        go,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
