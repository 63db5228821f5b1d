"""Phrase collocations, counted in mergeable counting quotient filters.

Texts are cut to words once and stored as sequences of word numbers of their own shard, with the
shard's words and counts beside them. Words that are frequent in the whole corpus get corpus-wide
ids; an n-gram of them, packed bit by bit, goes through an invertible permutation whose image is
split into a quotient and the full remainder, so a filter is lossless: no two n-grams share a
counter. Sorted filters of shards merge by quotient range, and what is left is turned back to words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written
from .words import mix

#: Text bytes of a shard (a longer text is a shard of its own) and entries a merged filter should have.
SHARD_BYTES, ENTRIES = 1 << 23, 1 << 20
#: Bits by which one round of merging splits the filters, at most.
ROUND_BITS = 10
#: Rows that each part of a language gives to the last ranking are at most ``top`` of the report.
RANK_PARTS = 64

_SEPARATOR, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_SEPARATOR[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BLANK[[0x20, 0x09]] = True
_ROUNDS = tuple(np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (2**64 - 1)) for i in range(4))


def permute(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A Feistel network over pairs of ``bits``-bit numbers: a bijection, undone by ``restore``."""
    mask = np.uint64((1 << bits) - 1)
    for i, k in enumerate(_ROUNDS):
        left, right = (left ^ (mix(right ^ k) & mask), right) if i % 2 else (left, right ^ (mix(left ^ k) & mask))
    return left, right


def restore(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    for i, k in reversed(list(enumerate(_ROUNDS))):
        left, right = (left ^ (mix(right ^ k) & mask), right) if i % 2 else (left, right ^ (mix(left ^ k) & mask))
    return left, right


def packed(ids: list[np.ndarray], b: int) -> tuple[np.ndarray, np.ndarray]:
    """Two or three arrays of ``b``-bit word ids (``b`` even) as the halves of one packed number."""
    if len(ids) == 2:
        return ids[0], ids[1]
    h = np.uint64(b // 2)
    return ids[0] << h | ids[1] >> h, (ids[1] & ((np.uint64(1) << h) - np.uint64(1))) << np.uint64(b) | ids[2]


def unpacked(left: np.ndarray, right: np.ndarray, n: int, b: int) -> list[np.ndarray]:
    if n == 2:
        return [left, right]
    h, low = np.uint64(b // 2), lambda x, k: x & ((np.uint64(1) << k) - np.uint64(1))
    return [left >> h, low(left, h) << h | right >> np.uint64(b), low(right, np.uint64(b))]


def half_bits(n: int, b: int) -> int:
    return b if n == 2 else 3 * b // 2


def counted(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (left, right) in order, their ``n`` added up."""
    order = np.lexsort((right, left))
    left, right, n = left[order], right[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])])) if len(left) else np.zeros(0, np.int64)
    return left[first], right[first], np.add.reduceat(n, first) if len(first) else n


def encoded(left: np.ndarray, right: np.ndarray, n: np.ndarray, low: int, bits: int) -> bytes:
    """A filter of sorted distinct entries that share all but the ``low`` last bits of ``left``.

    Quotients are kept as one bit an entry and one a quotient, as a quotient filter's runs are;
    remainders in whole bytes; counters in one byte, those of 255 and more aside in eight.
    """
    q = min(low, max(len(left).bit_length() - 1, 0))
    tail = left & np.uint64((1 << low) - 1)
    runs = np.zeros(len(left) + (1 << q), bool)
    runs[np.arange(len(left)) + (tail >> np.uint64(low - q)).astype(np.int64)] = True
    rest = tail & np.uint64((1 << (low - q)) - 1)
    cut = lambda x, k: np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, : (k + 7) // 8].tobytes()
    big = n >= 255
    head = np.array([len(left), q, int(big.sum())], "<i8").tobytes()
    return b"".join([head, np.packbits(runs).tobytes(), cut(rest, low - q), cut(right, bits), np.where(big, 255, n).astype(np.uint8).tobytes(), n[big].astype("<i8").tobytes()])


def decoded(data: bytes, part: int, low: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of a filter whose ``left`` starts with ``part``."""
    size, q, big = np.frombuffer(data, "<i8", 3).tolist()
    at = 24

    def take(n: int) -> np.ndarray:
        nonlocal at
        at += n
        return np.frombuffer(data, np.uint8, n, at - n)

    def wide(k: int) -> np.ndarray:
        out = np.zeros((size, 8), np.uint8)
        out[:, : (k + 7) // 8] = take(size * ((k + 7) // 8)).reshape(size, -1) if k else 0
        return out.reshape(-1).view("<u8").astype(np.uint64)

    slots = size + (1 << q)
    quotient = (np.flatnonzero(np.unpackbits(take((slots + 7) // 8), count=slots)) - np.arange(size)).astype(np.uint64)
    left = np.uint64(part << low) | quotient << np.uint64(low - q) | wide(low - q)
    right, n = wide(bits), take(size).astype(np.int64)
    if big:
        n[n == 255] = np.frombuffer(take(big * 8).tobytes(), "<i8")
    return left, right, n


def word_runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words in order, the number of the piece that each is in); A-Z lower-cased."""
    texts = pc.ascii_lower(texts.cast(pa.large_string()))
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64)
    data = np.frombuffer(b"".join(x.as_buffer() for x in texts), np.uint8)
    apart = _SEPARATOR[data]
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~(apart | _BLANK[data])
    begins = np.zeros(len(data) + 1, bool)
    begins[ends] = True
    edge = solid[1:] != solid[:-1]
    cut = begins & solid[1:] & solid[:-1]  # a word would run over from one text to the next
    starts, stops = np.flatnonzero((edge & solid[1:]) | cut), np.flatnonzero((edge & solid[:-1]) | cut)
    piece = np.searchsorted(np.flatnonzero(apart), starts) + np.searchsorted(ends, starts, side="right")
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    kept = data[solid[1:-1]].tobytes()
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(kept)), piece


def sequences(docs: DataFrame) -> DataFrame:
    """(shard, lang, n, words, counts, ids, pieces): texts of one language as word numbers of their shard.

    ``ids`` holds the words' numbers as little-endian 32-bit numbers, ``pieces`` a byte a word: 1 where
    another piece begins. Null texts are empty, a null language is ``und``.
    """

    def shard(lang: str, texts: list[pa.Array], number: int) -> pa.RecordBatch:
        words, piece = word_runs(pa.chunked_array(texts).combine_chunks())
        coded = words.dictionary_encode()
        ids = coded.indices.to_numpy(zero_copy_only=False).astype("<i4")
        n = np.bincount(ids, minlength=len(coded.dictionary)).astype(np.int64)
        step = np.minimum(np.diff(piece, prepend=piece[:1]), 1).astype(np.uint8)
        row = [[number], [lang], [len(ids)], [coded.dictionary.cast(pa.string()).to_pylist()], [n.tolist()], [ids.tobytes()], [step.tobytes()]]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary())
        return pa.record_batch([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["shard", "lang", "n", "words", "counts", "ids", "pieces"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Array]] = {}
        size: dict[str, int] = {}
        number = TaskContext.get().partitionId() << 32
        for b in slices(batches, 10_000, SHARD_BYTES):
            langs = b.column("lang")
            for lang in pc.unique(langs).to_pylist():
                own = pc.filter(b.column("text"), pc.equal(langs, lang))
                held.setdefault(lang, []).append(own)
                size[lang] = size.get(lang, 0) + (pc.sum(pc.binary_length(own)).as_py() or 0)
                if size[lang] >= SHARD_BYTES:
                    yield shard(lang, held.pop(lang), number)
                    size.pop(lang)
                    number += 1
        for i, (lang, texts) in enumerate(held.items()):
            yield shard(lang, texts, number + i)

    rows = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.col("text")).where("text is not null")
    return rows.mapInArrow(go, "shard long, lang string, n long, words array<string>, counts array<long>, ids binary, pieces binary")


def _listed(shards: DataFrame) -> DataFrame:
    """(shard, lang, word, local, n): the words of each shard."""
    both = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "x"))
    return both.select("shard", "lang", F.col("x.words").alias("word"), "local", F.col("x.counts").alias("n"))


def _frequent(shards: DataFrame, least: int) -> tuple[DataFrame, int]:
    """(id, lang, word, f) of the words that occur ``least`` times or more, and the even number of
    bits that every id fits in. Ids are dense but for the unevenness of the partitions."""
    f = _listed(shards).groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    rows = written(f.withColumn("m", F.monotonically_increasing_id()))
    at, row = F.shiftright("m", 33), F.col("m").bitwiseAND((1 << 33) - 1)
    most = rows.agg(F.max(at).alias("parts"), F.max(row).alias("rows")).first()
    width = (most["rows"] or 0) + 1
    bits = max(((most["parts"] or 0) * width + width).bit_length(), 2)
    return rows.select((at * width + row).alias("id"), "lang", "word", "f"), bits + bits % 2


def _ngrams(shards: DataFrame, words: DataFrame, b: int, split: int) -> DataFrame:
    """(shard, size, part, filter): the n-grams of frequent words of each shard, by leading bits."""
    named = _listed(shards).join(words.select("lang", "word", "id"), ["lang", "word"]).select(F.col("shard").alias("of"), "local", "id")

    def go(key: tuple, seqs: pa.Table, own: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for i in range(seqs.num_rows):
            ids = np.frombuffer(seqs["ids"][i].as_buffer(), "<i4")
            step = np.frombuffer(seqs["pieces"][i].as_buffer(), np.uint8).astype(np.int64)
            to = np.full(int(ids.max()) + 1 if len(ids) else 0, -1, np.int64)
            to[own["local"].to_numpy()] = own["id"].to_numpy()
            seq, piece = to[ids], np.cumsum(step)
            for n in (2, 3):
                if len(seq) < n:
                    continue
                cols = [seq[j : len(seq) - n + 1 + j] for j in range(n)]
                ok = (piece[n - 1 :] == piece[: len(seq) - n + 1]) & np.logical_and.reduce([c >= 0 for c in cols])
                left, right = permute(*packed([c[ok].astype(np.uint64) for c in cols], b), half_bits(n, b))
                out += [(key[0].as_py(), n, *x) for x in _split(*counted(left, right, np.ones(len(left), np.int64)), min(split, half_bits(n, b)), half_bits(n, b))]
        return _rows(out)

    return shards.select("shard", "ids", "pieces").groupBy("shard").cogroup(named.groupBy("of")).applyInArrow(go, "shard long, size int, part long, filter binary")


def _rows(out: list[tuple]) -> pa.Table:
    kinds = (("shard", pa.int64()), ("size", pa.int32()), ("part", pa.int64()), ("filter", pa.binary()))
    return pa.table([pa.array([x[i] for x in out], t) for i, (_, t) in enumerate(kinds)], names=[k for k, _ in kinds])


def _split(left: np.ndarray, right: np.ndarray, n: np.ndarray, split: int, bits: int) -> Iterator[tuple[int, bytes]]:
    """Filters of the sorted entries by their ``split`` leading bits."""
    part = (left >> np.uint64(bits - split)).astype(np.int64)
    at = np.flatnonzero(np.diff(part, prepend=-1))
    for a, z in zip(at, [*at[1:], len(part)][: len(at)], strict=True):
        yield int(part[a]), encoded(left[a:z], right[a:z], n[a:z], bits - split, bits)


def _merged(filters: DataFrame, b: int, split: int, groups: int, then: int | None, least: int) -> DataFrame:
    """Filters of the same group of shards and leading bits merged, in one pass over sorted rows.

    With ``then``, filters by that many leading bits; else (size, a, ids) of n-grams of ``least`` or more.
    A task holds the entries of one merged filter, however many shards there are.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        held: list[tuple] = []
        loose = 0

        def pack() -> None:
            nonlocal held, loose
            held, loose = [counted(*(np.concatenate(x) for x in zip(*held, strict=True)))], 0

        def give() -> pa.RecordBatch:
            pack()
            (left, right, n), size, bits = held[0], at[1], half_bits(at[1], b)
            if then is not None:
                return _rows([(at[0], size, *x) for x in _split(left, right, n, min(then, bits), bits)]).combine_chunks().to_batches()
            often = n >= least
            ids = unpacked(*restore(left[often], right[often], bits), size, b)
            cols = [x.astype(np.int64) for x in ids] + [np.full(int(often.sum()), -1)] * (3 - size)
            return [pa.record_batch([pa.array(np.full(len(cols[0]), size, np.int32)), pa.array(n[often]), *map(pa.array, cols)], names=["size", "a", "i1", "i2", "i3"])]

        for batch in slices(batches, 1000, 1 << 22):
            rows = [batch.column(c).to_pylist() for c in ("owner", "size", "part", "filter")]
            for owner, size, part, data in zip(*rows, strict=True):
                if at != (owner, size, part):
                    if at:
                        yield from give()
                    at, held, loose = (owner, size, part), [], 0
                bits = half_bits(size, b)
                held.append(decoded(data, part, bits - min(split, bits), bits))
                loose += len(held[-1][0])
                if loose > ENTRIES:
                    pack()
        if at:
            yield from give()

    owner = F.pmod(F.xxhash64("shard"), F.lit(groups)).alias("owner")
    dealt = filters.select(owner, "size", "part", "filter").repartition("owner", "size", "part").sortWithinPartitions("owner", "size", "part")
    return dealt.mapInArrow(go, "shard long, size int, part long, filter binary" if then is not None else "size int, a long, i1 long, i2 long, i3 long")


def phrases(docs: DataFrame, least: int = 10, entries: int = ENTRIES) -> DataFrame:
    """(lang, n, size, i1, i2, i3, w1, w2, w3, a, l, r, score) of the candidate phrases of each language.

    A candidate has two or three words of one piece and occurs ``least`` times or more; ``a``, ``l``
    and ``r`` are the occurrences of the phrase and of the parts of its lowest-scoring cut, ``n`` of all words.
    A third id and word are -1 and null where there is none. ``docs``: lang, text; other columns are ignored, rows of
    one id or text each count. Null and empty texts give nothing, very long ones are one shard each.
    """
    shards = written(sequences(docs))
    total = shards.agg(F.count("*").alias("shards"), F.sum("n").alias("words")).first()
    words, b = _frequent(shards, least)
    bits = max((2 * (total["words"] or 0) // entries).bit_length(), 1)
    done, groups = min(bits, ROUND_BITS), total["shards"]
    filters = _ngrams(shards, words, b, done)
    while done < bits:  # beyond so many parts as one split makes: groups of shards first, then finer parts
        after, groups = min(done + ROUND_BITS, bits), max(groups >> ROUND_BITS, 1)
        filters = written(_merged(filters, b, done, groups, after, least))
        done = after
    found = written(_merged(filters, b, done, 1, None, least))
    return _scored(found, words, shards)


def _scored(found: DataFrame, words: DataFrame, shards: DataFrame) -> DataFrame:
    """Candidates with their words and the lowest-scoring cut. All sides are stored tables with one row
    a key, so Spark splits the hot words and pairs of a join by itself."""
    named = lambda rows, i: rows.join(words.select(F.col("id").alias(f"i{i}"), F.col("f").alias(f"f{i}"), F.col("word").alias(f"w{i}"), *([F.col("lang")] if i == 1 else [])), f"i{i}")
    pairs = written(named(named(found.where("size = 2").select("i1", "i2", "a"), 1), 2))
    of = pairs.select("i1", "i2", F.col("a").alias("f"))
    three = named(named(named(found.where("size = 3").select("i1", "i2", "i3", "a"), 1), 2), 3)
    three = three.join(of.toDF("i1", "i2", "f12"), ["i1", "i2"]).join(of.toDF("i2", "i3", "f23"), ["i2", "i3"])
    cut = lambda k, l, r: F.struct(_score(F.col("a"), F.col(l), F.col(r)).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))  # noqa: E731, E741
    two = pairs.withColumns({"c": cut(1, "f1", "f2"), "i3": F.lit(-1).cast("long"), "w3": F.lit(None).cast("string"), "size": F.lit(2)})
    both = two.unionByName(three.withColumns({"c": F.least(cut(1, "f1", "f23"), cut(2, "f12", "f3")), "size": F.lit(3)}), allowMissingColumns=True)
    n = shards.groupBy("lang").agg(F.sum("n").alias("n"))
    n = F.broadcast(n) if n.limit(10_001).count() <= 10_000 else n
    return written(both.join(n, "lang").select("lang", "n", "size", "i1", "i2", "i3", "w1", "w2", "w3", "a", "c.l", "c.r", "c.score"))


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)), exact for counts up to 10**15."""
    d = lambda x: x.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (d(a) * d(a)), d(l) * d(r))


def standing(rows: DataFrame, share: int = 50) -> DataFrame:
    """``rows`` without the pairs that lie inside a three-word candidate with ``share`` percent of their count or more."""
    three = rows.where("size = 3").select("a", F.explode(F.array(F.struct("i1", "i2"), F.struct(F.col("i2").alias("i1"), F.col("i3").alias("i2")))).alias("p"))
    most = three.groupBy(F.col("p.i1").alias("i1"), F.col("p.i2").alias("i2")).agg(F.max("a").alias("longest"))
    # One row a pair on both sides, so no key is hot here; trigrams find nothing as their third id differs.
    held = rows.join(most.withColumn("i3", F.lit(-1).cast("long")), ["i1", "i2", "i3"], "left")
    return held.where(F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("a"))).drop("longest")


def digest(docs: DataFrame, least: int = 10, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` standing phrases of each language.

    Ties of score go to the more frequent phrase, then to the smaller in byte order.
    """
    phrase = F.concat_ws(" ", "w1", "w2", "w3").alias("phrase")
    rows = standing(phrases(docs, least)).select("lang", phrase, "a", "l", "r", "n", "score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # Each part's own best first, so the last ranking of a language reads RANK_PARTS * top rows at most.
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    own = rows.withColumn("_p", part).withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_p").orderBy(*order))).where(F.col("_r") <= top)
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL of ``digest`` over ``documents``.
SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
p AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(t, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
g AS (SELECT lang, unnest(w) AS g, 1 AS size FROM p
UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM p
UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY 1),
f AS MATERIALIZED (SELECT lang, g, any_value(size) AS size, count(*)::BIGINT AS a FROM g GROUP BY 1, 2 HAVING count(*) >= 10),
k AS MATERIALIZED (SELECT lang, g, size, a, k, array_to_string(string_split(g, ' ')[1:k], ' ') AS x, array_to_string(string_split(g, ' ')[k + 1:], ' ') AS y FROM f CROSS JOIN (VALUES (1), (2)) c(k) WHERE k < size),
l AS MATERIALIZED (SELECT k.*, f.a AS l FROM k JOIN f ON f.lang = k.lang AND f.g = k.x),
cuts AS MATERIALIZED (SELECT l.lang, l.g, l.size, l.a, k, l, f.a AS r, l.a::HUGEINT * l.a * 1000000 // (l::HUGEINT * f.a) AS score FROM l JOIN f ON f.lang = l.lang AND f.g = l.y),
best AS MATERIALIZED (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS MATERIALIZED (SELECT lang, g, max(a) AS longest FROM (SELECT lang, a, unnest([x, y]) AS g FROM k WHERE size = 3) WHERE contains(g, ' ') GROUP BY 1, 2),
left_ AS (SELECT best.* FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.g = best.g WHERE longest IS NULL OR 100 * longest < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score::BIGINT AS score FROM left_ JOIN n USING (lang)
QUALIFY rank <= 2000
"""
