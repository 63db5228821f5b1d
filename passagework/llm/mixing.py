"""Mixing overlapping sources to target weights by min-cost flow.

A text that several sources hold belongs to all of them. Documents are aggregated by membership
pattern, the set of sources that hold their text. A flow network sends the word capacity of every
pattern to the quotas of its sources: each source can draw on its own documents, up to three times
each, and every further use of a pattern's distinct words, by whichever source, costs more (convex).
So a source whose own words suffice leaves shared ones to those that have nothing else, and words
repeat only where a quota needs it. The flow gives each (pattern, source) an amount; that source's
documents of the pattern are then taken in seeded order until the amount is met.

The selection needs no sort of a whole source: documents fall into slices of a seeded hash, slice
sums give the slice in which the amount is met, and only that slice's documents, about
``SLICE_DOCS``, are looked at one by one.

Very many patterns make a tree of flows: groups of patterns get words from the quotas as one pattern
would, and deal what they get among their own groups in turn. A source draws on no more than its own
documents in either, so a quota that one flow meets is met by the tree too; only which of its
patterns repeats its words is decided group by group.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; rows
without any word are taken zero times; a very long text is one document like any other; repeated
rows count as separate documents of one text, ties in the seeded order fall to doc_id and size, and
rows equal in all of these are interchangeable; rows of one doc_id, or without one, are told apart
by their texts; an empty table gives an empty result; other columns pass through ``selected`` and are
ignored by ``digest``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import met, written

MAX_REPEATS = 3
#: Cost of the first, second and third use of a word.
REPEAT_COST = (0, 1, 3)
SEED = 20240607
SLICE_DOCS = 1024
#: Among so few documents the best choice is searched for where the plain one is a hundredth off.
FEW_DOCS = 64
#: Uses of a pattern's words that are priced apart; from the last one on each costs alike.
LEVELS = 12
#: One flow is solved over so many (pattern, source) pairs, on the driver. Of more pairs patterns are
#: put together to groups, and the flows of groups, of their groups and last of patterns are solved in tasks.
MAX_PATTERNS = 200_000
#: Texts of several sources up to this number are broadcast, more are joined by a shuffle in SALTS parts.
SMALL_TEXTS, SALTS = 200_000, 16


def size_of(text: Column) -> Column:
    """Number of runs of characters other than space and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], repeats: int = MAX_REPEATS) -> dict[str | None, float]:
    """Shares of the total size by weight, none above ``repeats`` times its source's size.

    What exceeds a limit is shared among the rest by weight until no target is above.
    """
    rest, left, out = dict(sizes), float(sum(sizes.values())), {}
    while rest:
        w = sum(weights[s] for s in rest)
        over = [s for s in rest if left * weights[s] / w > repeats * sizes[s]]
        if not over:
            return out | {s: left * weights[s] / w for s in rest}
        for s in over:
            out[s] = float(repeats * sizes[s])
        left -= sum(out[s] for s in over)
        rest = {s: n for s, n in rest.items() if s not in over}
    return out


def route(patterns: list[tuple[int, frozenset | dict]], quotas: dict, costs: tuple[int, ...] = REPEAT_COST) -> list[dict]:
    """Per pattern the whole words it gives each source: a min-cost flow.

    patterns: (words, sources), each source drawing on all words once per cost; or (distinct words,
    {source: words that it may draw}), where uses are priced by ``LEVELS``. Successive shortest paths
    with potentials; each pattern has one edge per use, of its capacity and that use's cost.
    """
    sources = list(quotas)
    at = {s: i for i, s in enumerate(sources)}
    n_p, start = len(patterns), 0
    sink, total = 1 + n_p + len(sources), 2 + n_p + len(sources)
    graph: list[list[int]] = [[] for _ in range(total)]
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def edge(a: int, b: int, capacity: int, price: int) -> None:
        for u, v, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            graph[u].append(len(to))
            to.append(v)
            room.append(c)
            cost.append(p)

    links: list[list[tuple]] = []
    for i, (words, members) in enumerate(patterns):
        rooms = members if isinstance(members, dict) else {s: words * len(costs) for s in members}
        if isinstance(members, dict):
            left, k = sum(rooms.values()), 0
            while words and left:
                edge(start, 1 + i, take := left if k == LEVELS - 1 else min(words, left), k * (k + 1) // 2)
                left, k = left - take, k + 1
        else:
            for c in costs:
                edge(start, 1 + i, words, c)
        own = []
        for s in sorted(rooms, key=lambda s: at[s]):
            own.append((s, len(to)))
            edge(1 + i, 1 + n_p + at[s], rooms[s], 0)
        links.append(own)
    for s, q in quotas.items():
        edge(1 + n_p + at[s], sink, q, 0)
    potential = [0] * total
    while True:
        dist, back = [None] * total, [-1] * total
        dist[start], queue = 0, [(0, start)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > dist[u]:
                continue
            for e in graph[u]:
                v = to[e]
                if room[e] > 0:
                    nd = d + cost[e] + potential[u] - potential[v]
                    if dist[v] is None or nd < dist[v]:
                        dist[v], back[v] = nd, e
                        heapq.heappush(queue, (nd, v))
        if dist[sink] is None:
            break
        far = max(d for d in dist if d is not None)
        potential = [p + (far if d is None else d) for p, d in zip(potential, dist, strict=True)]
        # All paths of this length at once: a blocking flow over edges of reduced cost 0.
        place = [0] * total
        while pushed := _push(start, sink, graph, to, room, cost, potential, place):
            assert pushed > 0
    return [{s: room[e ^ 1] for s, e in own if room[e ^ 1]} for own in links]


def _push(start, sink, graph, to, room, cost, potential, place) -> int:
    """Send as much as one path of reduced cost 0 bears; 0 if there is none left."""
    path, u, seen = [], start, {start}
    while u != sink:
        while place[u] < len(graph[u]):
            e = graph[u][place[u]]
            v = to[e]
            if room[e] > 0 and v not in seen and cost[e] + potential[u] - potential[v] == 0:
                break
            place[u] += 1
        if place[u] < len(graph[u]):
            path.append(e)
            seen.add(v)
            u = v
        elif path:
            e = path.pop()
            seen.discard(u)
            u = to[e ^ 1]
            place[u] += 1
        else:
            return 0
    amount = min(room[e] for e in path)
    for e in path:
        room[e] -= amount
        room[e ^ 1] += amount
    return amount


def _unit() -> Column:
    """A seeded value in [0, 1) of the document."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", "key", "size"), 11)).cast("double") / float(1 << 53)


def _fill(amount: int, sizes: np.ndarray, room: int) -> np.ndarray:
    """How often to take each document, in order, so that the sum comes near ``amount``.

    One pass takes once what still fits; the one document that then brings the sum nearest closes
    it. Only where that stays over a hundredth off (a few documents, one of them very long) do
    further passes repeat documents, up to ``room`` times each.
    """
    taken, left = np.zeros(len(sizes), np.int64), amount

    def go() -> None:
        nonlocal left
        for i, s in enumerate(sizes.tolist()):
            if 0 < s <= left and taken[i] < room:
                taken[i] += 1
                left -= s

    def close() -> None:
        nonlocal left
        rest = np.flatnonzero((taken < room) & (sizes > 0))
        if left and len(rest):
            best = rest[np.argmin(np.abs(sizes[rest] - left))]
            if abs(int(sizes[best]) - left) < left:
                taken[best] += 1
                left = 0

    go()
    rest = sizes[(taken == 0) & (sizes > 0)]
    while left * 100 > amount and not (len(rest) and np.abs(rest - left).min() * 100 <= amount) and taken.sum() < room * len(sizes):
        before = left
        go()
        if left == before:
            break
    close()
    if abs(int(taken @ sizes) - amount) * 100 > amount and len(sizes) <= FEW_DOCS and (best := _nearest(amount, sizes.tolist(), room)):
        return np.array(best, np.int64)
    return taken


def _nearest(amount: int, sizes: list[int], room: int) -> list[int] | None:
    """How often to take each of a few documents so that the sum is the nearest to ``amount`` that
    there is: reachable sums as bits of one number per step; None where that takes too much memory."""
    items = [i for i, s in enumerate(sizes) if s > 0 for _ in range(room)]
    bits = amount + max(sizes, default=0) + 1
    if bits * (len(items) + 1) > 1 << 28:
        return None
    mask, reach = (1 << bits) - 1, [1]
    for i in items:
        reach.append((reach[-1] | reach[-1] << sizes[i]) & mask)
    below = (reach[-1] & ((1 << (amount + 1)) - 1)).bit_length() - 1
    above = reach[-1] >> amount
    total = amount + (above & -above).bit_length() - 1 if above else below
    total = below if not above or amount - below <= total - amount else total
    out = [0] * len(sizes)
    for k in range(len(items), 0, -1):
        if not reach[k - 1] >> total & 1:
            out[items[k - 1]] += 1
            total -= sizes[items[k - 1]]
    return out


def _order(name: str | None) -> tuple:
    return (name is None, (name or "").encode())


def plan(sized: DataFrame, weights: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(patterns, sources) for rows with doc_id, key, size, source and ``members`` (all sources of the text).

    ``patterns`` has a row per membership pattern and source: members, source, slices, copies, part,
    open, and where there are more than MAX_PATTERNS also ``n``, the number of its documents. A document in a slice
    below ``part`` is taken copies + 1 times, above it copies times; the documents of slice ``part`` have ``open`` words
    of a further copy among them. The driver holds a name and two numbers of each source.
    """
    spark = sized.sparkSession
    pairs = written(sized.groupBy("members", "source").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    once = sized.where("size > 0").select("members", "key", "size").distinct().groupBy("members").agg(F.sum("size").alias("words"))
    few = pairs.limit(MAX_PATTERNS + 1).count() <= MAX_PATTERNS
    own = {r["source"]: r["words"] for r in pairs.groupBy("source").agg(F.sum("words").alias("words")).collect()}
    names = sorted(own, key=_order)
    goal = targets({s: own[s] for s in names}, weights or {s: 1 + i % 3 for i, s in enumerate(names)})
    quotas = {s: round(goal[s]) for s in names}
    sources = spark.createDataFrame([(s, own[s], goal[s]) for s in names], "source string, source_size long, target double")
    if not few:
        return _many(sized, _routed(pairs, once, quotas)), sources
    found = sorted(pairs.collect(), key=lambda r: ([_order(m) for m in r["members"]], _order(r["source"])))
    distinct = {tuple(r["members"]): r["words"] for r in once.collect()}  # no more than the pairs above
    rooms: dict[tuple, dict] = {}
    for r in found:
        rooms.setdefault(tuple(r["members"]), {})[r["source"]] = MAX_REPEATS * r["words"]
    flow = dict(zip(rooms, route([(distinct.get(m, 0), r) for m, r in rooms.items()], quotas), strict=True))
    amounts = [flow[tuple(r["members"])].get(r["source"], 0) for r in found]
    # Whole documents miss an amount by a part of one. A source's largest pattern makes up for its others.
    main: dict[str | None, int] = {}
    for i, r in enumerate(found):
        if r["source"] not in main or r["words"] > found[main[r["source"]]]["words"]:
            main[r["source"]] = i
    others = [i for i in range(len(found)) if main[found[i]["source"]] != i]
    if others:
        took = taken(sized, _amounts(sized, found, amounts, others)).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("words"))
        short = {r["source"]: -r["words"] for r in took.collect()}
        for i in others:
            short[found[i]["source"]] = short.get(found[i]["source"], 0) + amounts[i]
        for s, missing in short.items():
            amounts[main[s]] = min(max(0, amounts[main[s]] + missing), MAX_REPEATS * found[main[s]]["words"])
    return _amounts(sized, found, amounts, range(len(found))), F.broadcast(sources)  # MAX_PATTERNS sources at most


def _solve(group: pa.Table) -> pa.Table:
    """What the children of one node give each source: rows of (child, source, words, room, quota)."""
    rows = sorted(group.to_pylist(), key=lambda r: (r["child"], _order(r["source"])))
    words: dict[str, int] = {}
    rooms: dict[str, dict] = {}
    for r in rows:
        words[r["child"]] = words.get(r["child"], 0) + r["words"]
        rooms.setdefault(r["child"], {})[r["source"]] = r["room"]
    quotas = {s: q for s, q in sorted({r["source"]: r["quota"] for r in rows}.items(), key=lambda x: _order(x[0]))}
    flow = dict(zip(rooms, route([(words[c], rooms[c]) for c in rooms], quotas), strict=True))
    return pa.table({k: pa.array([r[k] for r in rows], pa.string()) for k in ("child", "source")} | {"quota": pa.array([flow[r["child"]].get(r["source"], 0) for r in rows], pa.int64())})


def _routed(pairs: DataFrame, once: DataFrame, quotas: dict) -> DataFrame:
    """``pairs`` with ``amount``, by a tree of flows whose nodes have about MAX_PATTERNS pairs each, or
    two of each source."""
    spark = pairs.sparkSession
    own = once.select(F.to_json("members").alias("own"), F.col("words").alias("distinct"))
    # A pattern's distinct words stand with its first source.
    rows = written(
        pairs.withColumn("own", F.to_json("members")).join(own, "own", "left")
        .withColumn("distinct", F.when(F.col("source").eqNullSafe(F.col("members")[0]), F.coalesce("distinct", F.lit(0))).otherwise(0))
        .withColumn("at", F.pmod(F.xxhash64("own"), F.lit(1 << 62)))
    )
    fan, depth, many = max(2, MAX_PATTERNS // len(quotas)), 0, rows.select("own").distinct().count()
    while fan ** (depth + 1) < many:
        depth += 1
    nodes = spark.createDataFrame([("0", s, q) for s, q in quotas.items()], "node string, source string, quota long")
    for level in range(depth + 1):
        child = F.col("own") if level == depth else (F.col("at") % fan ** (level + 1)).cast("string")
        parts = rows.groupBy((F.col("at") % fan**level).cast("string").alias("node"), child.alias("child"), "source").agg(
            F.sum("distinct").alias("words"), (MAX_REPEATS * F.sum("words")).alias("room")
        )
        asked = nodes.withColumnsRenamed({"node": "_node", "source": "_source"})
        met = parts.join(asked, (F.col("node") == F.col("_node")) & F.col("source").eqNullSafe(F.col("_source"))).drop("_node", "_source")
        nodes = written(met.groupBy("node").applyInArrow(_solve, "child string, source string, quota long").withColumnRenamed("child", "node"))
    got = nodes.select(F.col("node").alias("_node"), F.col("source").alias("_source"), F.col("quota").alias("amount"))
    return written(
        rows.join(got, (F.col("own") == F.col("_node")) & F.col("source").eqNullSafe(F.col("_source")))
        .select(F.monotonically_increasing_id().alias("pattern"), "members", "own", "source", "n", "words", "amount")
    )


def _many(sized: DataFrame, pairs: DataFrame) -> DataFrame:
    """``plan``'s patterns where they are too many for the driver: a source's largest makes up for its others."""
    main = pairs.groupBy("source").agg(F.max(F.struct("words", "own", "pattern")).alias("m")).select("m.pattern")
    others = pairs.join(main, "pattern", "left_anti")
    took = taken(sized, _sliced(sized, _resting(others))).groupBy("source").agg((-F.sum(F.col("copies") * F.col("size"))).alias("short"))
    wanted = others.groupBy("source").agg(F.sum("amount").alias("short"))
    short = took.unionByName(wanted).groupBy(F.col("source").alias("_source")).agg(F.sum("short").alias("short"))
    mended = pairs.join(main, "pattern", "left_semi").join(short, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn(
        "amount", F.least(F.greatest(F.col("amount") + F.coalesce("short", F.lit(0)), F.lit(0)), MAX_REPEATS * F.col("words"))
    )
    return written(_sliced(sized, _resting(others.unionByName(mended.select(others.columns)))))


def _resting(pairs: DataFrame) -> DataFrame:
    """Patterns with the number of their slices, whole copies, and the words of a further copy."""
    copies = F.when(F.col("words") > 0, F.floor(F.col("amount") / F.col("words"))).otherwise(0)
    return pairs.withColumn("copies", copies.cast("long")).select(
        "pattern", "members", "source", "n", F.greatest(F.lit(1), F.floor(F.col("n") / SLICE_DOCS)).cast("long").alias("slices"), "copies",
        F.when(F.col("words") > 0, F.col("amount") - F.col("copies") * F.col("words")).otherwise(0).alias("rest"),
    )


def _amounts(sized: DataFrame, found: list[Row], amounts: list[int], chosen: Iterable[int]) -> DataFrame:
    """The patterns ``chosen`` of ``found`` with the slices in which their amounts are met."""
    rows = []
    for i in chosen:
        r = found[i]
        copies = amounts[i] // r["words"] if r["words"] else 0
        rows.append((i, r["members"], r["source"], max(1, r["n"] // SLICE_DOCS), copies, amounts[i] - copies * r["words"]))
    return _sliced(sized, sized.sparkSession.createDataFrame(rows, "pattern long, members array<string>, source string, slices long, copies long, rest long"))


def _sliced(sized: DataFrame, patterns: DataFrame) -> DataFrame:
    """``patterns`` with the slice in which the rest is met, and what of the rest is open before it."""
    slices = _placed(sized, patterns).groupBy("pattern", "rest", "at").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("pattern").orderBy("at"))
    met = slices.withColumn("upto", upto).where((F.col("rest") > 0) & (F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
    edges = met.groupBy("pattern").agg(F.min(F.struct(F.col("at").alias("part"), (F.col("rest") - F.col("upto") + F.col("words")).alias("open"))).alias("e")).select("pattern", "e.*")
    return patterns.join(edges, "pattern", "left").select(*patterns.columns, F.coalesce("part", F.lit(-1)).alias("part"), F.coalesce("open", F.lit(0)).alias("open"))


def _placed(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """``rows`` with their pattern's columns and their slice ``at``."""
    if "n" in patterns.columns:
        name = F.to_json(F.struct("members", "source"))
        side = patterns.withColumn("_pattern", name).drop("members", "source").withColumnRenamed("n", "_n")
        placed = met(rows.withColumn("_pattern", name), side, "_pattern", "_n").drop("_pattern", "_n")
    else:
        p = F.broadcast(patterns.withColumnsRenamed({"members": "own", "source": "of"}))  # MAX_PATTERNS rows at most
        placed = rows.join(p, F.col("members").eqNullSafe(F.col("own")) & F.col("source").eqNullSafe(F.col("of"))).drop("own", "of")
    return placed.withColumn("at", F.least(F.floor(_unit() * F.col("slices")), F.col("slices") - 1))


def taken(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """``rows`` (doc_id, key, size, source, members and any others) with ``copies``, by the plan."""
    kept = [*rows.columns, "copies"]
    placed = _placed(rows, patterns)
    sure = placed.where(F.col("at") != F.col("part")).withColumn("copies", F.col("copies") + (F.col("at") < F.col("part")).cast("long")).select(kept)
    close = placed.where(F.col("at") == F.col("part")).withColumn("unit", _unit())

    def settle(group: pa.Table) -> pa.Table:
        order = pc.sort_indices(group, [("unit", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])
        group = group.take(order)
        more = _fill(group["open"][0].as_py(), group["size"].to_numpy(), MAX_REPEATS - group["copies"][0].as_py())
        copies = pc.add(group["copies"], pa.array(more))
        return group.set_column(group.schema.get_field_index("copies"), "copies", copies).select(kept)

    settled = close.groupBy("pattern").applyInArrow(settle, sure.schema)
    return sure.unionByName(settled).withColumn("copies", F.when(F.col("size") > 0, F.col("copies")).otherwise(0))


def _sized(docs: DataFrame, source: str, *more: Column) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(*more, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), size_of(text).alias("size"), F.col(source).cast("string").alias("source"))


def shared_texts(sized: DataFrame) -> DataFrame:
    """(key, size, members) of the texts that several sources hold, sources in code point order."""
    held = sized.where("size > 0").groupBy("key", "size").agg(F.collect_set(F.struct("source")).alias("s")).where(F.size("s") > 1)  # sources at most
    return held.select("key", "size", F.transform(F.array_sort("s"), lambda x: x["source"]).alias("members"))


def with_members(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """``rows`` (key, size, source and any others) with ``members``."""
    if shared.limit(SMALL_TEXTS + 1).count() <= SMALL_TEXTS:
        met = rows.join(F.broadcast(shared), ["key", "size"], "left")
    else:  # a text that a third of the rows hold is met in parts
        part = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
        parts = shared.withColumn("_part", F.explode(F.array(*map(F.lit, range(SALTS)))))
        met = rows.withColumn("_part", part).join(parts, ["key", "size", "_part"], "left").drop("_part")
    return met.withColumn("members", F.coalesce("members", F.array("source")))


def _planned(docs: DataFrame, source: str, weights: dict | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    sized = written(_sized(docs, source))
    shared = written(shared_texts(sized))
    rows = with_members(sized, shared)
    return rows, shared, *plan(rows, weights)


def mix(docs: DataFrame, source: str = "source", weights: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, size, source, members, copies) of every document, and (source, source_size, target)."""
    rows, _, patterns, sources = _planned(docs, source, weights)
    return taken(rows, patterns), sources


def digest(docs: DataFrame) -> DataFrame:
    """The contract's row of every document."""
    rows, sources = mix(docs)
    s = sources.withColumnRenamed("source", "of")
    return rows.join(s, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def selected(docs: DataFrame, source: str = "source", weights: dict | None = None) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes it, same columns.

    Texts move only for the documents of the boundary slices, and where very many texts are shared.
    """
    _, shared, patterns, _ = _planned(docs, source, weights)
    rows = with_members(_sized(docs, source, F.struct("*").alias("row")), shared)
    return taken(rows, patterns).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
