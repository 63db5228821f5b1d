"""Sections, paragraphs and chunks of texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chapter_label, once, roman, token_count

#: name -> (target tokens, overlap tokens, whether chunks carry their section)
VARIANTS = {"naive": (500, 50, False), "small": (300, 30, False), "section": (6000, 0, False), "parent": (500, 50, True)}


# Fixed value: what counts as blank at both ends of a paragraph.
BLANKS = "\t\n\x0b\f\r \u00a0\ufeff"


def blocks(text: str, separator: re.Pattern) -> list[tuple[int, int, int]]:
    """(piece, start, end) of the pieces between separators that aren't blank: paragraphs of lines or
    of sections, the one place that says what a paragraph is."""
    out, at = [], 0
    for piece, (end, then) in enumerate([*((m.start(), m.end()) for m in separator.finditer(text)), (len(text), len(text))]):
        if text[at:end].strip(BLANKS):
            out.append((piece, at, end))
        at = then
    return out


#: Texts, or sections, whose Python copies a task holds at a time.
HELD = 256


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches`` cut into at most HELD rows."""
    for b in batches:
        yield from (b.slice(at, HELD) for at in range(0, b.num_rows, HELD))


def _lists(rows: list[list[tuple]], names: tuple[str, ...]) -> pa.ListArray:
    """Lists of tuples of whole numbers as lists of structs, column by column."""
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.array([x for row in rows for x in row], np.int64).reshape(-1, len(names))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(len(names))], list(names)))


_PARAGRAPH = ("para", "piece", "char_start", "char_end")


def offsets(docs: DataFrame, separator: str = "\n", text: bool = False, count: Callable[[list[str]], list[int]] | None = None) -> DataFrame:
    """(doc_id, size, p): per row the array of its paragraphs (para, char_start, char_end); with ``text`` the text too,
    with ``count`` each paragraph's ``tokens`` by it.

    Offsets are added up within the row, so nothing is shuffled and rows of one doc_id don't mix;
    only they come back from Python, texts of paragraphs are cut where they are asked for.
    """
    cut = re.compile(re.escape(separator))
    kept = ["doc_id", "size", *(["text"] if text else [])]
    names = (*_PARAGRAPH, "tokens") if count else _PARAGRAPH

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):  # Python copies of so many texts at a time
                own = b.slice(at, 1000)
                whole = own.column("text").to_pylist()
                found = [[(k, *x) for k, x in enumerate(blocks(t, cut))] for t in whole]
                if count:
                    tokens = iter(count([t[x[2] : x[3]] for t, row in zip(whole, found, strict=True) for x in row]))
                    found = [[(*x, next(tokens)) for x in row] for row in found]
                yield pa.record_batch([*(own.column(c) for c in kept), _lists(found, names)], names=[*kept, "p"])

    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").cast("long").alias("size"), "text")
    return rows.mapInArrow(go, f"doc_id long, size long, {'text string, ' if text else ''}p array<struct<{','.join(f'{n}:bigint' for n in names)}>>")


def listed(docs: DataFrame, separator: str = "\n", count: Callable[[list[str]], list[int]] | None = None) -> DataFrame:
    """``offsets`` with the text, and the tokens of each paragraph: runs of word characters, or what
    ``count`` says, which is told the paragraphs of many texts at once (``ids.counter``)."""
    if count:
        return offsets(docs, separator, text=True, count=count).select("doc_id", "size", "text", "p")
    tokens = pieced(F.col("text"), separator, F.col("p"), token_count, lambda x, n: x.withField("tokens", n))
    return offsets(docs, separator, text=True).select("doc_id", "size", "text", tokens.alias("p"))


def pieced(text: Column, separator: str, paras: Column, of: Callable[[Column], Column], put: Callable[[Column, Column], Column]) -> Column:
    """Each of ``paras`` put together with what ``of`` makes of its piece; the text is split once."""
    return once(F.transform(F.split(text, separator), of), lambda made: F.transform(paras, lambda x: put(x, F.get(made, x["piece"].cast("int")))))


def paragraphs(docs: DataFrame, separator: str = "\n") -> DataFrame:
    """(doc_id, para, text, char_start, char_end, tokens); blank pieces go, offsets stay."""
    told = pieced(F.col("text"), separator, F.col("p"), lambda x: x, lambda x, t: x.withField("text", t))
    rows = offsets(docs, separator, text=True).select("doc_id", F.explode(told).alias("x"))
    return rows.select("doc_id", "x.para", "x.text", "x.char_start", "x.char_end", token_count(F.col("x.text")).alias("tokens"))


def grown(values: list[int | None], gap: int) -> list[bool]:
    """Which values a growing sequence accepts: v is next if expected <= v <= expected + gap."""
    want, took = 1, []
    for v in values:
        ok = v is not None and want <= v <= want + gap
        want = v + 1 if ok else want
        took.append(ok)
    return took


def monotone(rows: DataFrame, values: str, gap: int = 3) -> DataFrame:
    """``rows`` with ``ok``, for each element of the array column ``values`` whether it is accepted.

    One pass whose state is the expected value; NULL values are not accepted.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [grown(v or (), gap) for v in b.column(values).to_pylist()]
            ends = np.cumsum([0, *map(len, found)])
            ok = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([x for row in found for x in row], pa.bool_()))
            yield pa.record_batch([*b.columns, ok], names=[*b.schema.names, "ok"])

    types = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(go, f"{types}, ok array<boolean>")


def bounded(heads: Column, size: Column) -> Column:
    """An array of structs that have ``char_start``, in order, each with ``char_end``: the next one's
    start, ``size`` for the last."""
    ends = F.concat(F.transform(F.slice(heads, 2, F.greatest(F.size(heads), F.lit(1))), lambda h: h["char_start"]), F.array(size))
    return F.zip_with(heads, F.slice(ends, 1, F.greatest(F.size(heads), F.lit(1))), lambda h, e: h.withField("char_end", e))


def section_heads(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, char_start, numeral): every match of a head pattern whose group is a numeral."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        head = re.compile(pattern, re.MULTILINE)
        for b in batches:
            rows = [(i, m.start(), m[1]) for i, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for m in head.finditer(t or "")]
            ids, at, num = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(num, pa.string())], names=["doc_id", "char_start", "numeral"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(go, "doc_id long, char_start long, numeral string")


def sections(heads: DataFrame, lengths: DataFrame, gap: int = 3) -> DataFrame:
    """Accepted heads with their bounds: a section ends where the next accepted one starts."""
    listed = heads.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("char_start", "numeral"))).alias("h")).join(lengths, "doc_id")
    rows = monotone(listed.withColumn("v", F.transform("h", lambda x: roman(x["numeral"]).cast("long"))), "v", gap)
    kept = F.transform(F.filter(F.arrays_zip("h", "ok"), lambda x: x["ok"]), lambda x: x["h"])
    return rows.withColumn("h", kept).where(F.size("h") > 0).select("doc_id", "length", F.explode(bounded(F.col("h"), F.col("length"))).alias("x")).select("doc_id", "x.char_start", "x.numeral", "length", "x.char_end")


def pack(tokens: list[int], target: int, overlap: int, tail_repeat: bool = True) -> list[tuple[int, int]]:
    """Greedy chunks [i, j) over paragraphs, at least one each, started again by the overlap.

    With ``tail_repeat`` a last stretch that fits the overlap comes once more as its own chunk.
    """
    n, i, out = len(tokens), 0, []
    if sum(tokens) <= target:
        return [(0, n)] if n else []
    while i < n:
        j, total = i + 1, tokens[i]
        while j < n and total + tokens[j] <= target:
            total += tokens[j]
            j += 1
        out.append((i, j))
        if j >= n and not tail_repeat:
            break
        o, back = j, 0
        while o > i and back + tokens[o - 1] <= overlap:
            o -= 1
            back += tokens[o]
        i = o if o > i else i + 1
    return out


# Token windows that a text and the 3000 tokens around it may need.
TIERS = (16384, 32768, 65536, 102400)


def context_tier(need: Column) -> Column:
    """The least window that holds ``need`` tokens, else the largest."""
    tier = F.when(need <= TIERS[0], TIERS[0])
    for n in TIERS[1:-1]:
        tier = tier.when(need <= n, n)
    return tier.otherwise(TIERS[-1])


_CUT = "chunks array<struct<chunk_index:bigint,first_para:bigint,last_para:bigint,char_start:bigint,char_end:bigint,token_count:bigint>>"


def cut(held: DataFrame, target: int, overlap: int, tail_repeat: bool = True) -> DataFrame:
    """Chunks of (doc_id, p) rows, ``p`` an array of paragraphs; nothing is shuffled."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("chunk_index", "first_para", "last_para", "char_start", "char_end", "token_count")
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in names]))
        for b in batches:
            rows = []
            for p in b.column("p").to_pylist():
                n = [x["tokens"] for x in p]
                rows.append([dict(zip(names, (k, i, j - 1, p[i]["char_start"], p[j - 1]["char_end"], sum(n[i:j])), strict=True)) for k, (i, j) in enumerate(pack(n, target, overlap, tail_repeat))])
            yield pa.record_batch([b.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "chunks"])

    bare = held.select("doc_id", F.transform("p", lambda x: F.struct(x["char_start"].alias("char_start"), x["char_end"].alias("char_end"), x["tokens"].alias("tokens"))).alias("p"))
    return bare.mapInArrow(go, f"doc_id long, {_CUT}").select("doc_id", F.explode("chunks").alias("c")).select("doc_id", "c.*")


def chunks(paras: DataFrame, target: int, overlap: int, tail_repeat: bool = True) -> DataFrame:
    """(doc_id, chunk_index, first_para, last_para, char_start, char_end, token_count) of paragraphs
    that are rows of their own; ``cut`` takes texts that are still whole."""
    held = paras.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("para", "char_start", "char_end", "tokens"))).alias("p"))
    return cut(held, target, overlap, tail_repeat)


def variant(docs: DataFrame, name: str) -> DataFrame:
    """Chunks of a registered variant, with ``parent_start``, ``parent_end`` where it has parents."""
    target, overlap, parent = VARIANTS[name]
    found = cut(listed(docs), target, overlap).withColumn("version", F.lit(name))
    if parent:
        whole = docs.select("doc_id", F.lit(0).cast("long").alias("parent_start"), F.length("text").cast("long").alias("parent_end"))
        return found.join(whole, "doc_id")
    return found


#: What lies between the paragraphs of a section, and what is told of each.
BLANK_LINES, _BLOCK, _BLOCKS = re.compile("\n{2,}"), ("piece", "char_start", "char_end"), "array<struct<piece:bigint,char_start:bigint,char_end:bigint>>"
# How sections begin, by dialect; the first also has books.
BOOK = r"^BOOK ([IVX]+)$"
DIALECTS = {"books": r"^([IVXLC]+)\.--", "footnotes": r"^([IVXLC]+)\.(?:\[[0-9]+\])?\s+", "plain": r"^([IVXLC]+)\.\s+"}
_NUMERAL = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}


def _value(numeral: str) -> int:
    v = [_NUMERAL[c] for c in numeral]
    return sum(-x if x < y else x for x, y in zip(v, [*v[1:], 0], strict=True))


def split_sections(text: str, dialect: str, gap: int = 3) -> list[tuple[str | None, str, int, int]]:
    """(book, numeral, start, end): heads whose numbers grow by at most ``gap`` + 1, each up to the
    next accepted one or the end of its book; other heads belong to the section before."""
    head, out = re.compile(DIALECTS[dialect], re.MULTILINE), []
    books = list(re.finditer(BOOK, text, re.MULTILINE)) if dialect == "books" else []
    spans = [(f"Book {m[1]}", m.end(), n.start() if n else len(text)) for m, n in zip(books, [*books[1:], None], strict=False)] or [(None, 0, len(text))]
    for book, start, end in spans:
        kept, want = [], 1
        for m in head.finditer(text[start:end]):
            if want <= (v := _value(m[1])) <= want + gap:
                kept.append((m[1], start + m.start()))
                want = v + 1
        out += [(book, n, s, e) for (n, s), e in zip(kept, [*(x for _, x in kept[1:]), end], strict=False)]
    return out


def sections_of(docs: DataFrame, dialect: str, blocked: bool = False) -> DataFrame:
    """(doc_id, section, book, numeral, char_start, char_end, text) of every section, text trimmed; with
    ``blocked`` its paragraphs too, as ``section_chunks`` takes them, so that a task needs no worker of its own for these."""
    if dialect not in DIALECTS:
        raise ValueError(f"no section dialect {dialect!r}; known: {', '.join(DIALECTS)}")
    names = ("section", "book", "numeral", "char_start", "char_end", "text")
    kind = pa.struct([("section", pa.int64()), ("book", pa.string()), ("numeral", pa.string()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("text", pa.string())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, HELD):
                own = b.slice(at, HELD)
                rows = [[dict(zip(names, (k, *x, t[x[2] : x[3]].strip()), strict=True)) for k, x in enumerate(split_sections(t or "", dialect))] for t in own.column("text").to_pylist()]
                ends = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
                flat = pa.array([x for row in rows for x in row], kind)
                if blocked:
                    inner = _lists([blocks(x["text"], BLANK_LINES) for row in rows for x in row], _BLOCK)
                    flat = pa.StructArray.from_arrays([*flat.flatten(), inner], [*names, "b"])
                yield pa.record_batch([own.column("doc_id"), pa.ListArray.from_arrays(ends, flat)], names=["doc_id", "s"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(go, f"doc_id long, s array<struct<section:bigint,book:string,numeral:string,char_start:bigint,char_end:bigint,text:string{f',b:{_BLOCKS}' if blocked else ''}>>")
    return found.select("doc_id", F.explode("s").alias("s")).select("doc_id", "s.*")


def section_chunks(found: DataFrame, target: int, overlap: int) -> DataFrame:
    """Chunks of ``sections_of`` rows, numbered over all sections of a document, each with its
    section as parent: (doc_id, chunk_index, chapter, text, char_start, char_end, token_count,
    parent_start, parent_end). A section within ``target`` is one chunk."""
    names = ("local", "start", "end", "tokens")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            yield pa.record_batch([*b.columns, _lists([blocks(t, BLANK_LINES) for t in b.column("text").to_pylist()], _BLOCK)], names=[*b.schema.names, "b"])

    def cuts(size: int, own: list[dict], para: list[int]) -> list[tuple]:
        if sum(para) <= target:
            return [(0, 0, size, sum(para))]
        return [(k, own[i]["char_start"], own[j - 1]["char_end"], sum(para[i:j])) for k, (i, j) in enumerate(pack(para, target, overlap))]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            rows = [cuts(*x) for x in zip(*(b.column(c).to_pylist() for c in ("size", "b", "para")), strict=True)]
            yield pa.record_batch([*(b.column(c) for c in keep), _lists(rows, names)], names=[*keep, "cut"])

    keep = ["doc_id", "section", "book", "numeral", "char_start", "char_end", "text"]
    rows = found
    types = ", ".join(f"{c} {t}" for c, t in rows.select(*keep).dtypes)
    if "b" not in rows.columns:
        rows = rows.select(*keep).mapInArrow(split, f"{types}, b {_BLOCKS}")
    # Tokens are counted over the same blocks that are packed.
    s = rows.select(*keep, "b", (F.col("char_end") - F.col("char_start")).alias("size"), pieced(F.col("text"), "\n{2,}", F.col("b"), token_count, lambda x, n: n).alias("para"))
    rows = s.mapInArrow(go, f"{types}, cut array<struct<local:bigint,start:bigint,end:bigint,tokens:bigint>>").select(*keep, F.explode("cut").alias("c"))
    order = Window.partitionBy("doc_id").orderBy("section", "c.local")
    return rows.select(
        "doc_id", (F.row_number().over(order) - 1).cast("long").alias("chunk_index"), chapter_label(F.col("book"), F.col("numeral")).alias("chapter"),
        F.substr("text", (F.col("c.start") + 1).cast("int"), (F.col("c.end") - F.col("c.start")).cast("int")).alias("text"),
        (F.col("char_start") + F.col("c.start")).alias("char_start"), (F.col("char_start") + F.col("c.end")).alias("char_end"),
        F.col("c.tokens").alias("token_count"), F.col("char_start").alias("parent_start"), F.col("char_end").alias("parent_end"),
    )
