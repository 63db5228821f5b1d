"""Best-fit packing of token pieces by a grouping genetic algorithm on islands.

Texts are tokenized, closed by one end id and cut into pieces of the sequence length; full pieces
are sequences already. The others are dealt by hash into blocks of about BLOCK pieces. For each
block several islands evolve packings: crossover injects well-filled bins of one parent into the
other, bins holding their duplicates are dissolved, and displaced pieces go back by best fit;
after each epoch an island's best packings migrate to the next island of the block. A block with
as few bins as its token sum allows stops at once.

Pieces of one length are interchangeable, so a packing is kept as lengths only; pieces are put in
their places once the best packing of each block is known.

Special tokens that a text holds get their own ids, as by the tokenizer's default; none is added.

Defined cases: a null or empty text is the end id alone; a very long text gives as many pieces as it
needs, encoded as one batch of its own; repeated rows each give their pieces; a null doc_id stays
null in its pieces; pieces of equal length take each other's places by arrival; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import os
import random
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, slices, written

LENGTH, END, BLOCK, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2048, 0, 16384, 3, 3, 12, 6
TOKENIZER = "word_bpe_49k.json"
#: Letter runs whose ids a worker keeps, in each of two generations.
_CACHE_WORDS = 120_000
#: Marks that the vocabulary's splitting keeps apart from letters before them.
_CLOSING = ".,*#$%&!|;:?"
#: Bytes of texts that are encoded together.
_SUBBATCH = 1 << 21
#: Most tasks of an epoch; each evolves whole islands.
_TASKS = 4096

Packing = list[tuple[int, ...]]
_encoders: dict[str, Callable[[list[bytes]], list[np.ndarray]]] = {}
#: Ids of a vocabulary's special tokens.
_specials: dict[str, dict[bytes, int]] = {}


def _simple_letters() -> str:
    """Letters up to U+024F that normalising and lower-casing turn into one letter each: only a run
    of these is sure to be one part for the vocabulary's splitting, whatever mark follows."""
    one = lambda c: unicodedata.normalize("NFC", c) == c and len(c.lower()) == 1 and c.lower().isalpha()
    return "".join(c for c in map(chr, range(0x41, 0x250)) if c.isalpha() and one(c))


_SIMPLE = _simple_letters()


class _Cache:
    """Packed ids by key, in two generations: keys in use survive, the others go."""

    def __init__(self, most: int, learn: Callable[[list[bytes]], list[bytes]]):
        self.most, self.learn = most, learn
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def __call__(self, keys: list[bytes]) -> list[bytes]:
        """The ids of distinct keys; those not held are learnt together."""
        young, old = self.young.get, self.old.get
        out = [young(k) or old(k) for k in keys]
        missing = [k for k, v in zip(keys, out, strict=True) if v is None]
        if missing:
            found = iter(self.learn(missing))
            out = [next(found) if v is None else v for v in out]
        if len(self.young) + len(keys) > self.most:
            self.young, self.old = {}, self.young
        self.young.update(zip(keys, out, strict=True))
        return out


def encoder(path: str) -> Callable[[list[bytes]], list[np.ndarray]]:
    """Ids of UTF-8 texts, special tokens read as plain text.

    White space parts words for this vocabulary, so each distinct word of a batch is encoded once.
    Most words are simple letters and marks that close them: their letters are encoded in lower
    case, many at a time, and kept from batch to batch. Every other word goes to the tokenizer as
    it is (case matters there: some letters and marks compose in one case only).
    """
    if path in _encoders:
        return _encoders[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    # ``text_encoder`` cuts special tokens out before.
    tokenizer.encode_special_tokens = True
    _specials[path] = {t.content.encode(): i for i, t in tokenizer.get_added_tokens_decoder().items() if t.special}
    # Runs of lower-case simple letters are normal and parted by blanks alone.
    plain = Tokenizer.from_file(path)
    plain.normalizer = normalizers.Sequence([])
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    closes = np.zeros(tokenizer.get_vocab_size(), bool)  # ids that end a run of letters
    for token, i in tokenizer.get_vocab().items():
        closes[i] = token.endswith("</w>")
    whole = lambda own: [np.array(e.ids, np.uint32).tobytes() for e in tokenizer.encode_batch_fast([x.decode() for x in own], add_special_tokens=False)]

    def letters(own: list[bytes]) -> list[bytes]:
        out, runs = [], [own[i : i + 500] for i in range(0, len(own), 500)]
        for run, e in zip(runs, plain.encode_batch_fast([b" ".join(r).decode().lower() for r in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends, raw = (4 * (np.flatnonzero(closes[ids]) + 1)).tolist(), ids.tobytes()
            out += [raw[i:j] for i, j in zip([0, *ends], ends)] if len(ends) == len(run) else whole(run)
        return out

    by_letters, by_word = _Cache(_CACHE_WORDS, letters), _Cache(_CACHE_WORDS // 4, whole)
    only_simple = f"^[{_SIMPLE}]+$"

    def table(keys: pa.Array, ids: Callable[[list[bytes]], list[bytes]]) -> tuple[list[bytes], np.ndarray]:
        """The ids of the distinct keys, and each key's place among them."""
        coded = keys.dictionary_encode()
        return ids(coded.dictionary.cast(pa.binary()).to_pylist()), coded.indices.to_numpy().astype(np.int64)

    def encode(texts: list[bytes]) -> list[np.ndarray]:
        words = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary
        core = pc.ascii_rtrim(distinct, characters=_CLOSING)
        simple = pc.match_substring_regex(core, only_simple)
        # A word is two parts: letters and marks, or itself and nothing.
        first, one = table(pc.ascii_lower(core.filter(simple)), by_letters)
        mark = pc.utf8_ltrim(distinct.filter(simple), characters=_SIMPLE)
        second, two = table(mark, by_word)
        third, three = table(distinct.filter(pc.invert(simple)), by_word)
        at, ok = np.zeros((len(distinct), 2), np.int64), simple.to_numpy(zero_copy_only=False)
        nothing = len(first) + len(second) + len(third)
        at[ok, 0], at[ok, 1] = one, len(first) + two
        at[~ok, 0], at[~ok, 1] = len(first) + len(second) + three, nothing
        ids = [*first, *second, *third, b""]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, start = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(size) - size
        spread = lambda begin, n: np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        flat = flat[spread(start[at.reshape(-1)], size[at.reshape(-1)])]  # of the distinct words in order
        size = size[at].sum(axis=1)
        start = np.cumsum(size) - size
        of = coded.indices.to_numpy()
        n = size[of]
        bounds = np.concatenate([[0], np.cumsum(n)])[words.offsets.to_numpy()]
        return np.split(flat[spread(start[of], n)], bounds[1:-1])

    _encoders[path] = encode
    return encode


def text_encoder(path: str) -> Callable[[list[bytes]], list[np.ndarray]]:
    """Ids of UTF-8 texts as the tokenizer gives them with ``add_special_tokens=False`` alone:
    special tokens part a text, and what lies between them is encoded by itself."""
    encode, special = encoder(path), _specials[path]
    if not special:
        return encode
    marks = re.compile(b"(" + b"|".join(re.escape(x) for x in sorted(special, key=len, reverse=True)) + b")")

    def go(texts: list[bytes]) -> list[np.ndarray]:
        if not any(x in t for t in texts for x in special):
            return encode(texts)
        cut = [marks.split(t) for t in texts]  # plain parts at even places, special tokens between
        plain = iter(encode([x for own in cut for x in own[::2]]))
        return [np.concatenate([np.array([special[x]], np.uint32) if i % 2 else next(plain) for i, x in enumerate(own)]) for own in cut]

    return go


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids in pieces."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path(TOKENIZER)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(tokenizer)
        for b in slices(batches, 4000, _SUBBATCH):
            rows = []
            for k, tokens in zip(b.column("doc_id").to_pylist(), encode(blobs(b)), strict=True):
                tokens = np.append(tokens, np.uint32(END)).astype("<u4")
                rows += [
                    (k, j, s, len(cut := tokens[s : s + length]), zlib.crc32(cut.tobytes()))
                    for j, s in enumerate(range(0, len(tokens), length))
                ]
            if rows:
                k, j, s, n, c = zip(*rows, strict=True)
                yield pa.record_batch(
                    [pa.array(k, pa.int64()), pa.array(j, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(go, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(items: list[int], bins: Packing, capacity: int) -> Packing:
    """``bins`` with ``items`` added, each to the fullest bin that has room, else to a new one."""
    open_: dict[int, list[list[int]]] = {}
    gaps, full = 0, []
    for b in bins:
        gap = capacity - sum(b)
        if gap:
            open_.setdefault(gap, []).append(list(b))
            gaps |= 1 << gap
        else:
            full.append(b)
    for x in items:
        fits = gaps >> x
        if fits:
            gap = x + (fits & -fits).bit_length() - 1
            own = open_[gap]
            b = own.pop()
            if not own:
                gaps ^= 1 << gap
            b.append(x)
            gap -= x
        else:
            b, gap = [x], capacity - x
        if gap:
            held = open_.setdefault(gap, [])
            if not held:
                gaps |= 1 << gap
            held.append(b)
        else:
            full.append(tuple(b))
    return full + [tuple(b) for own in open_.values() for b in own]


def fitness(bins: Packing) -> tuple[int, int]:
    """Less is better: bins used, then evenness (full bins beside empty ones are better)."""
    return len(bins), -sum(sum(b) ** 2 for b in bins)


def crossover(a: Packing, b: Packing, capacity: int, rng: random.Random) -> Packing:
    """``a`` with some well-filled bins of ``b``, without the pieces they already hold."""
    held = Counter(map(lambda x: tuple(sorted(x)), a))
    fresh = []
    for x in b:
        k = tuple(sorted(x))
        if held[k]:
            held[k] -= 1  # both parents have this bin
        else:
            fresh.append(x)
    fresh.sort(key=sum, reverse=True)
    injected = [x for x in fresh[: max(1, len(fresh) // 2)] if rng.random() < 0.7] or fresh[:1]
    want = Counter(x for bin_ in injected for x in bin_)
    kept, displaced = [], []
    for bin_ in sorted(a, key=lambda x: sum(x) + rng.randrange(64)):
        if any(want[x] > 0 for x in bin_):
            for x in bin_:
                if want[x] > 0:
                    want[x] -= 1
                else:
                    displaced.append(x)
        else:
            kept.append(bin_)
    return best_fit(sorted(displaced, reverse=True), kept + injected, capacity)


def mutate(a: Packing, capacity: int, rng: random.Random) -> Packing:
    """``a`` with its emptiest bins and a few others dissolved and packed again."""
    order = sorted(a, key=sum)
    n = max(2, len(order) // 20)
    loose, rest = order[:n], order[n:]
    rng.shuffle(rest)
    loose, rest = loose + rest[:n], rest[n:]
    items = sorted((x for b in loose for x in b), key=lambda x: x * rng.uniform(0.9, 1.1), reverse=True)
    return best_fit(items, rest, capacity)


def evolve(population: list[Packing], items: list[int], capacity: int, generations: int, seed: int) -> list[Packing]:
    """The population, best first, after some generations; an empty one is started anew."""
    rng = random.Random(seed)
    least = -(-sum(items) // capacity)
    if not population:
        population = [best_fit(sorted(items, reverse=True), [], capacity)]
    while len(population) < POPULATION and len(population[0]) > least:
        noise = rng.choice((0.02, 0.05, 0.1))
        order = sorted(items, key=lambda x: x * rng.uniform(1 - noise, 1 + noise), reverse=True)
        population.append(best_fit(order, [], capacity))
    population = sorted(population, key=fitness)[:POPULATION]
    for _ in range(generations):
        if len(population[0]) <= least:
            break
        if len(population) > 1:
            a, b = rng.sample(population[: max(2, len(population) // 2 + 1)], 2)
            child = crossover(a, b, capacity, rng)
        else:
            child = population[0]
        child = mutate(child, capacity, rng)
        if fitness(child) < fitness(population[-1]) and child not in population:
            population[-1] = child
            population.sort(key=fitness)
    return population


def _flat(p: Packing) -> list[int]:
    """Bins as one list, parted by zeros."""
    return list(chain.from_iterable((*b, 0) for b in p))


def _bins(flat: np.ndarray) -> Packing:
    return [tuple(x[:-1].tolist()) for x in np.split(flat, np.flatnonzero(flat == 0) + 1)[:-1]]


def pack(cut: DataFrame, length: int = LENGTH, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS) -> DataFrame:
    """``pieces`` rows with sequence_id and offset. Reads its input several times."""
    cut = cut.withColumn("row", F.monotonically_increasing_id())
    full = cut.where(F.col("length") >= length).select(
        *cut.columns[:-1], (F.col("row") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    short = cut.where(F.col("length") < length)
    n = -(-short.count() // block) or 1
    short = short.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "row"), F.lit(n)))
    # A block is about BLOCK lengths; their counts leave each task already added up.
    lengths = short.groupBy("block", "length").agg(F.count("*").cast("int").alias("n"))
    state = (
        lengths.withColumn("island", F.explode(F.array(*map(F.lit, range(islands)))))
        .select("block", "island", F.array_repeat(F.col("length").cast("int"), F.col("n")).alias("packing"))
    )
    schema = "block long, island int, packing array<int>"

    def epoch(number: int) -> Callable[[pa.Table], pa.Table]:
        def go(group: pa.Table) -> pa.Table:
            blk, isl = group["block"][0].as_py(), group["island"][0].as_py()
            rows = [np.array(x, np.int64) for x in group["packing"].to_pylist()]
            if number == 0:
                items, population = np.sort(np.concatenate(rows)).tolist(), []
            else:
                population = [_bins(x) for x in rows]
                items = sorted(x for b in population[0] for x in b)
            # Arrival order is not fixed; the seed and this order are.
            population.sort(key=lambda p: (fitness(p), p))
            best = evolve(population, items, length, generations, hash((blk, isl, number)))
            out = [(isl, p) for p in best] + [((isl + 1) % islands, p) for p in best[:2]]
            return pa.table(
                {"block": pa.array([blk] * len(out), pa.int64()), "island": pa.array([i for i, _ in out], pa.int32()), "packing": pa.array([_flat(p) for _, p in out], pa.list_(pa.int32()))}
            )

        return go

    # Islands are few bytes and much work: they are dealt by number, which AQE leaves as it is.
    tasks = min(n * islands, _TASKS)
    for number in range(epochs):
        state = state.repartition(tasks, "block", "island").groupBy("block", "island").applyInArrow(epoch(number), schema)
    best = state.withColumn("bins", F.size(F.filter("packing", lambda x: x == 0)))
    best = best.groupBy("block").agg(F.min_by("packing", F.struct("bins", F.col("island"), F.xxhash64("packing"))).alias("packing"))

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        by: dict[int, list[tuple[int, int]]] = {}
        for s, b in enumerate(_bins(np.array(right["packing"][0].as_py(), np.int64))):
            at = 0
            for x in b:
                by.setdefault(x, []).append((s, at))
                at += x
        spots = [by[x].pop() for x in left["length"].to_pylist()]
        first = left["block"][0].as_py() << 32
        return left.drop_columns(["row", "block"]).append_column("sequence_id", pa.array([first + s for s, _ in spots], pa.int64())).append_column(
            "offset", pa.array([o for _, o in spots], pa.int64())
        )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    placed = short.groupBy("block").cogroup(best.groupBy("block")).applyInArrow(place, schema)
    return placed.unionByName(full)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's row of every piece."""
    return pack(written(pieces(docs)))
