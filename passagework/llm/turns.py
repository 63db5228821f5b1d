"""Repair of conversations whose turns are blank, repeated, cut short, mislabelled or missing.

The roles of a sound conversation are ``(s?(ua)+)?``: system at most once and first, then user and
assistant in turn. A generalised LR parser reads the rows in order; where no shift is possible, or a
cheaper way may exist, it also deletes a row, gives it another role or inserts one. Its
graph-structured stack keeps one node for equal tops, that of minimum (cost, audit).

Rows of a conversation are cut into ranges of about the same size, so a long one is read by many
tasks: each gives, for every top that it may start with, the best way to every top that it may end
with. These ways are short strings, and their sums over the ranges give the whole conversation's.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import met, slices, written

KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
#: Rows of a range.
RANGE_ROWS = 200_000
#: LR states of Talk -> empty | Turns | s Turns, Turns -> Pair | Turns Pair, Pair -> u a. The goto of
#: Pair and Turns is reduced at once, so a state's rows hold its shifts alone: after ``u a`` comes the
#: state that follows the Turns reduced below it.
SHIFT = {"start": {"s": "system", "u": "user"}, "system": {"u": "user"}, "user": {"a": "pairs"}, "pairs": {"u": "user"}}
TOPS, ACCEPTED = tuple(SHIFT), ("start", "pairs")
ROLE = {"s": "system", "u": "user", "a": "assistant"}


def insertions(top: str) -> list[tuple[str, str]]:
    """(top, inserted roles): every top that insertions reach, each by the fewest."""
    out, found, text = [(top, "")], {top}, ""
    while nexts := [(r, t) for r, t in SHIFT[top].items() if r != "s" and t not in found]:
        role, top = nexts[0]
        text += role
        found.add(top)
        out.append((top, text))
    return out


_INSERT = {t: insertions(t) for t in TOPS}


def actions(symbol: str, fault: str) -> list[tuple[str, str, int]]:
    """(edit, role or empty, cost) of a row with this role initial that needn't be deleted."""
    more = CUT_SHORT if fault == "truncated" else 0
    return [("D", "", DELETE), ("K", symbol, KEEP + more), *(("R", r, REROLE + more) for r in "au")]


def ways(rows: list[tuple[str, str, int]], start: str) -> list[tuple[str, int, str]]:
    """(top, cost, audit): the best way through (role initial, fault, number) rows to each top reached.

    Nodes of the stack after a row: for each top the least (cost, audit). Audits are kept as ranks
    and links: two that end with a row's edit and hold as many of them are never one the start of
    the other, so what is appended later can't change their order.
    """
    live, links = {start: (0, 0)}, []
    step: dict[tuple, list] = {}
    for *row, n in rows:
        row = tuple(row)
        if row[1] in ("blank", "duplicate"):  # deleted from every top; an insertion may as well come later, which is less in ASCII
            live = {t: (cost + n * DELETE, rank) for t, (cost, rank) in live.items()}
            links.append({t: (t, "D" * n) for t in live})
            continue
        if row not in step:  # from each top: insertions, then the row's own edit
            step[row] = [
                (t, to, INSERT * len(put) + cost, "I" * len(put) + edit)
                for t in TOPS for at, put in _INSERT[t] for edit, role, cost in actions(*row) if (to := SHIFT[at].get(role) if role else at)
            ]
        best: dict[str, tuple] = {}
        for t, to, cost, text in step[row]:
            if t in live:
                way = (live[t][0] + cost, live[t][1], text, t)
                if to not in best or way < best[to]:
                    best[to] = way
        order = {w[1:]: i for i, w in enumerate(sorted(best.values(), key=lambda w: w[1:]))}
        live = {to: (w[0], order[w[1:]]) for to, w in best.items()}
        links.append({to: (w[3], w[2]) for to, w in best.items()})
    out = []
    for to, (cost, _) in live.items():
        parts, t = [], to
        for link in reversed(links):
            t, text = link[t]
            parts.append(text)
        out.append((to, cost, "".join(reversed(parts))))
    return out


def joined(ranges: list[list[tuple[str, str, int, str]]]) -> tuple[int, str]:
    """(cost, audit) of the conversation whose ranges have these (start, top, cost, audit) ways."""
    live: dict[str, tuple[int, int]] = {"start": (0, 0)}
    links: list[dict[str, tuple[str, str]]] = []
    for way in ranges:
        best: dict[str, tuple] = {}
        for start, to, cost, audit in way:
            if start in live:
                w = (live[start][0] + cost, live[start][1], audit, start)
                if to not in best or w < best[to]:
                    best[to] = w
        order = {w[1:]: i for i, w in enumerate(sorted(best.values(), key=lambda w: w[1:]))}
        live = {to: (w[0], order[w[1:]]) for to, w in best.items()}
        links.append({to: (w[3], w[2]) for to, w in best.items()})
    cost, _, last, t = min((c + INSERT * len(put), rank, "I" * len(put), t) for t, (c, rank) in live.items() for at, put in _INSERT[t] if at in ACCEPTED)
    parts = [last]
    for link in reversed(links):
        t, text = link[t]
        parts.append(text)
    return cost, "".join(reversed(parts))


def applied(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation from its (role, text) rows and edits.

    A role is what the grammar expects, so the audit alone says it: a kept system row is the one row
    that isn't user or assistant in turn.
    """
    turn = 0
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        if edit == "K":
            yield role, text
            turn = 1 if role[:1] == "u" else 0
        else:
            yield ("user", "assistant")[turn], text
            turn = 1 - turn


def _marked(rows: DataFrame) -> DataFrame:
    """Rows with role and text not null, the text's key and the faults that a row has by itself."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    own = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    return own.withColumn("key", F.sha2("text", 256)).withColumn("own", F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise(""))


def _runs(marked: DataFrame) -> DataFrame:
    """(conv_id, turn, role, key, n, fault): equal rows as one with their number, without texts."""
    slim = marked.groupBy("conv_id", "turn", "role", "key").agg(F.count("*").alias("n"), F.first("own").alias("own"))
    said = F.xxhash64("conv_id", "role", "key").alias("said")  # only how the groups are dealt; they are told apart by the columns
    slim = written(slim.withColumn("said", said))
    seen = slim.groupBy("said", "conv_id", "role", "key").agg(F.count("*").alias("m"), F.min(F.struct("turn")).alias("first"))
    side = seen.groupBy("said").agg(F.sum("m").alias("m"), F.collect_list(F.struct("conv_id", "role", "key", "first")).alias("seen"))
    rows = met(slim, side, "said", "m")
    of = F.filter("seen", lambda x: x["conv_id"].eqNullSafe(F.col("conv_id")) & (x["role"] == F.col("role")) & (x["key"] == F.col("key")))
    fault = F.when(F.col("own") == "blank", "blank").when(~F.struct("turn").eqNullSafe(of[0]["first"]), "duplicate").otherwise(F.col("own"))
    return rows.select("conv_id", "turn", "role", "key", "n", fault.alias("fault"))


def _range(turn: list, roles: list[str], faults: list[str], counts: list[int], fresh: bool) -> str:
    """The summary of a conversation's rows within one range, as JSON."""
    rows: list[tuple[str, str, int]] = []
    for role, fault, n in zip(roles, faults, counts, strict=True):
        own = (role[:1] or " ", "blank" if fault == "blank" else "duplicate")
        rows += [(own[0], fault, 1), (*own, n - 1)] if n > 1 else [(own[0], fault, 1)]
    known = [t for t in turn if t is not None]
    illegal = sum(n - 1 for _, _, n in rows) + sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    faults_ = [sum(n for _, f, n in rows if f == kind) for kind in ("blank", "duplicate", "truncated")]
    found = [(t, *w) for t in (("start",) if fresh else TOPS) for w in ways(rows, t)]
    return json.dumps({"turns": [min(known), max(known), len(set(known))] if known else None, "ends": [rows[0][0], rows[-1][0]], "illegal": illegal, "faults": faults_, "ways": found})


def _whole(ranges: list[dict]) -> dict:
    """The figures of a conversation from those of its ranges in order."""
    known = [r["turns"] for r in ranges if r["turns"]]
    twice = sum(a[1] == b[0] for a, b in zip(known, known[1:], strict=False))
    gaps = known[-1][1] - known[0][0] + 1 - (sum(t[2] for t in known) - twice) if known else 0
    seams = sum(a["ends"][1] + b["ends"][0] not in ("su", "ua", "au") for a, b in zip(ranges, ranges[1:], strict=False))
    cost, audit = joined([[tuple(w) for w in r["ways"]] for r in ranges])
    blank, duplicate, truncated = (sum(r["faults"][i] for r in ranges) for i in range(3))
    return {"gaps": gaps, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": seams + sum(r["illegal"] for r in ranges), "cost": cost, "audit": audit}


def _ranges(runs: DataFrame, rows: int) -> DataFrame:
    """(conv_id, range, summary): the rows in order, cut into ranges of about ``rows`` each."""
    runs = written(runs)
    parts = (runs.count() // rows) + 1

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        range_, at, held, fresh = TaskContext.get().partitionId(), None, ([], [], [], []), False

        def given() -> pa.RecordBatch:
            return pa.record_batch([pa.array([at], pa.int64()), pa.array([range_], pa.int32()), pa.array([_range(*held, fresh)])], names=["conv_id", "range", "summary"])

        for b in slices(batches, 10_000):
            for i, (conv, *row) in enumerate(zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "fault", "n")), strict=True)):
                if held[0] and conv != at:
                    yield given()
                    held, fresh = ([], [], [], []), True
                at = conv
                for to, x in zip(held, row, strict=True):
                    to.append(x)
        if held[0]:
            yield given()

    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "key")]
    return runs.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(go, "conv_id long, range int, summary string")


def _streams(rows: DataFrame, every: DataFrame, range_rows: int, each: Callable[[int, dict, Iterator], Iterator[tuple]], columns: dict[str, pa.DataType]) -> DataFrame:
    """The rows of ``each(conv_id, figures, its rows)`` for every conversation of ``every``.

    Summaries come before rows, so a task holds a conversation's edits and one batch of its texts.
    """
    marked = _marked(rows)
    own = _ranges(_runs(marked), range_rows).select("conv_id", F.lit(1).alias("kind"), F.col("range").cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("key"), F.col("summary").alias("text"))
    ids = every.select("conv_id").distinct().select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("key"), F.lit("").alias("text"))
    texts = marked.select("conv_id", F.lit(2).alias("kind"), "turn", "role", "key", "text")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lines() -> Iterator[tuple]:
            for b in slices(batches, 10_000):
                yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text")), strict=True)

        def found() -> Iterator[tuple]:
            for conv, own in groupby(lines(), key=lambda x: x[0]):
                ranges, first = [], []
                for row in own:
                    if row[1] == 2:
                        first = [row]
                        break
                    if row[1] == 1:
                        ranges.append(json.loads(row[3]))
                yield from each(conv, _whole(ranges), ((role, text) for _, _, role, text in chain(first, own)))

        for block in _blocks(found()):
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*block, strict=True), columns.values(), strict=True)], names=list(columns))

    order = [F.asc_nulls_first(c) for c in ("conv_id", "kind", "turn", "role", "key")]
    return ids.unionByName(own).unionByName(texts).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(go, ", ".join(f"{c} {'long' if t == pa.int64() else 'string'}" for c, t in columns.items()))


def repaired(rows: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(conv_id, position, role, text): every conversation after its cheapest repair.

    ``rows``: conv_id, turn, role, text; other columns are ignored. Rows are read by turn (nulls
    first), then role and the text's hash; equal rows count each and all but the first are
    duplicates. A null role or text is one space, so null texts are blank; rows without a conv_id are one
    conversation. Texts are read whole and streamed, however long or many.
    """

    def each(conv: int, figures: dict, own: Iterator[tuple[str, str]]) -> Iterator[tuple]:
        return ((conv, at, *x) for at, x in enumerate(applied(figures["audit"], own)))

    return _streams(rows, rows, range_rows, each, {"conv_id": pa.int64(), "position": pa.int64(), "role": pa.string(), "text": pa.string()})


def _blocks(rows: Iterator[tuple], most: int = 1000, size: int = 1 << 24) -> Iterator[list[tuple]]:
    """The rows in lists of at most ``most`` and about ``size`` characters of strings."""
    block, held = [], 0
    for x in rows:
        block.append(x)
        held += sum(len(v) for v in x if isinstance(v, str))
        if len(block) == most or held > size:
            yield block
            block, held = [], 0
    if block:
        yield block


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the damage that crc32(``conv_id:turn``) % 20 chooses; a null there is one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", "role", "text", (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20).alias("d")).where("d <> 0")
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def digest(conversations: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every
    conversation after the damage and its repair.

    SHA-256 reads a text from its start to its end, so each conversation's repaired texts pass one
    task, as a stream; all else of a long conversation is dealt over its ranges.
    """

    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def each(conv: int, figures: dict, own: Iterator[tuple[str, str]]) -> Iterator[tuple]:
        h = hashlib.sha256()
        for i, (role, text) in enumerate(applied(figures["audit"], own)):
            h.update(f"{chr(10) if i else ''}{role}:{text}".encode())
        yield conv, *(figures[k] for k in numbers), figures["audit"], h.hexdigest()

    return _streams(damaged(conversations), conversations, range_rows, each, {"conv_id": pa.int64(), **dict.fromkeys(numbers, pa.int64()), "audit": pa.string(), "repaired_sha256": pa.string()})
