"""Language identification by Bayesian evidence fusion.

A record's text gives a likelihood per language (hashed character trigrams, counted by language
over all labelled documents). Its declared markup language, address suffix and address path tag
each give a likelihood, and its host gives a prior, smoothed towards its domain and that towards
the whole corpus. These four tables are grouped sums of the texts' own posteriors; a record's own
share is taken out of its host's and domain's sums before they are used on it. The posterior is
the normalised product.

Defined cases: a null text counts as empty and gives no text evidence; a null doc_id or page_id stays
null; a null host, declaration, suffix or path is a value of its own that carries no evidence beyond
its counts; null or empty markup is an empty page, and of malformed markup what opens and never closes
is text; a very long text or page is read whole, in time that grows with its length; of equally likely
languages the first in code point order is said; repeated rows each give their row; without labelled
text every language is null (``train`` alone stops with a message); languages beyond BLOCK_LANGUAGES
are scored in further passes over the texts; an empty table of records gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, once, slices, written

SLOTS = 1 << 14
#: So many languages are held at once, by the driver and by a task: 131 KB each.
BLOCK_LANGUAGES = 400
#: Trigrams of a text count as this many independent ones at most.
EVIDENCE = 60.0
#: Weight, in records, of the level above in a host's or domain's prior; of evenness in a likelihood.
KAPPA, FLAT = 5.0, 2.0
_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)
# Parts of a page that are no text, by how they open and close.
_OPENS = re.compile(r"<(!--)|<(script|style|nav|head|footer)\b|<(div) class=.?ad\b", re.IGNORECASE)
_CLOSES = {"!--": re.compile("-->")} | {k: re.compile(rf"</{k}\s*>", re.IGNORECASE) for k in ("script", "style", "nav", "head", "footer", "div")}
_TAG = re.compile(r"<[^>]*>")
_HTML = re.compile(r"<html\b[^>]*", re.IGNORECASE)
_LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.IGNORECASE)


def _slots(text: bytes, several: bool = False) -> np.ndarray:
    """The slots of a text's trigrams, or of ``several`` texts' with a byte 255, which UTF-8 hasn't, between them."""
    a = _FOLD[np.frombuffer(text, np.uint8)].astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.int64)
    v = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
    told = v != 0x202020  # blanks tell nothing
    v = v[told & (a[:-2] != 255) & (a[1:-1] != 255) & (a[2:] != 255)] if several else v[told]
    return ((v * np.uint32(0x9E3779B1)) >> np.uint32(32 - 14)).astype(np.int64)


class Model:
    """Log probability of each slot by language, read from a table of counts a block of languages at a time."""

    def __init__(self, counts: DataFrame, languages: list[str]):
        self.counts, self.languages = counts, languages

    def blocks(self) -> Iterator[np.ndarray]:
        for at in range(0, len(self.languages), BLOCK_LANGUAGES):
            names = self.languages[at : at + BLOCK_LANGUAGES]
            found = self.counts.where(F.col("lang").isin(names)).toArrow()  # SLOTS rows a language at most
            counts = np.full((len(names), SLOTS), 0.5)
            counts[pc.index_in(found["lang"], pa.array(names)).to_numpy(), found["slot"].to_numpy()] += found["n"].to_numpy()
            yield np.log(counts / counts.sum(axis=1, keepdims=True))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], Model]:
    """(languages, their model), from all rows with a language."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in slices(batches):
            by: dict[str, list[bytes]] = {}
            for t, k in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("lang").to_pylist(), strict=True):
                by.setdefault(k, []).append(t)
            for k, own in by.items():
                held = counts.setdefault(k, np.zeros(SLOTS, np.int64))
                at, size = 0, 0
                for i, t in enumerate(own):
                    size += len(t)
                    if size > 1 << 20 or i == len(own) - 1:
                        held += np.bincount(_slots(b"\xff".join(own[at : i + 1]), several=True), minlength=SLOTS)
                        at, size = i + 1, 0
        for k, held in counts.items():
            used = np.flatnonzero(held)
            yield pa.record_batch([pa.array([k] * len(used), pa.string()), pa.array(used), pa.array(held[used])], names=["lang", "slot", "n"])

    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    sums = written(rows.mapInArrow(go, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")))
    languages = sorted(r["lang"] for r in sums.select("lang").distinct().collect())
    if not languages:
        raise ValueError("no language has text")
    return languages, Model(sums, languages)


def visible(html: str) -> str:
    """The text of a page in one pass: hidden parts and tags become blanks; what opens a part that
    never closes, or a tag, is text."""
    parts, at, open_ended = [], 0, set()
    for m in _OPENS.finditer(html):
        kind = (m[1] or m[2] or m[3]).lower()
        if m.start() < at or kind in open_ended:
            continue
        if close := _CLOSES[kind].search(html, m.end()):
            parts += [html[at : m.start()], " "]
            at = close.end()
        else:
            open_ended.add(kind)  # nothing later closes either
    text = "".join([*parts, html[at:]])
    last = text.rfind(">") + 1  # before it every tag closes
    return _TAG.sub(" ", text[:last]) + text[last:]


def declared(html: str) -> str | None:
    """The language that the page's first html tag names."""
    tag = _HTML.search(html)
    m = tag and _LANG.search(tag[0])
    return m[1].lower() if m else None


def pages_as_records(pages: DataFrame) -> DataFrame:
    """(doc_id, page_id, text, markup, suffix, path, host, domain) of (page_id, url, html)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            html = [x or "" for x in b.column("html").to_pylist()]
            yield pa.record_batch(
                [b.column("page_id"), b.column("url"), pa.array([visible(x) for x in html], pa.string()), pa.array([declared(x) for x in html], pa.string())],
                names=["page_id", "url", "text", "markup"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    return rows.mapInArrow(go, "page_id long, url string, text string, markup string").select(
        F.lit(None).cast("long").alias("doc_id"), "page_id", "text", "markup",
        F.nullif(F.substring_index(host, ".", -1), F.lit("")).alias("suffix"),
        F.nullif(F.lower(F.regexp_extract("url", r"^[^/]+//[^/]+/([A-Za-z]{2})(?:[/?#]|$)", 1)), F.lit("")).alias("path"),
        host.alias("host"), F.substring_index(host, ".", -3).alias("domain"),
    )


def documents_as_records(docs: DataFrame) -> DataFrame:
    """Documents have no address and no markup; their source is their host."""
    none = F.lit(None).cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"), F.col("text").cast("string").alias("text"),
        none.alias("markup"), none.alias("suffix"), none.alias("path"),
        F.concat(F.lit("source:"), F.col("source").cast("string")).alias("host"), F.lit("source:").alias("domain"),
    )


def _text_evidence(records: DataFrame, model: Model) -> DataFrame:
    """Records with ``ll``, the log likelihood by language, in place of the text."""
    rows, more = records, len(model.languages) > BLOCK_LANGUAGES
    for i, block in enumerate(model.blocks()):
        rows = _scored(rows, block, i)
        rows = written(rows) if more else rows  # a task holds one block only
    ll = F.concat(*(F.col(f"_ll{j}") for j in range(i + 1)))
    top = lambda a: once(F.array_max(a), lambda m: F.transform(a, lambda x: x - m))
    return rows.select(*(c for c in records.columns if c != "text"), once(ll, top).alias("ll"))


def _scored(records: DataFrame, block: np.ndarray, i: int) -> DataFrame:
    """Records with ``_ll{i}``, the log likelihood by the languages of a block."""
    held = records.sparkSession.sparkContext.broadcast(block)  # BLOCK_LANGUAGES x SLOTS numbers at most

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = held.value
        for b in slices(batches):
            out = []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                s = _slots(t or b"")
                if len(s):
                    at, n = np.unique(s, return_counts=True)
                    out.append((logs[:, at] @ n * (min(1.0, EVIDENCE / len(s)))).tolist())
                else:
                    out.append([0.0] * len(logs))
            yield b.append_column(f"_ll{i}", pa.array(out, pa.list_(pa.float64())))

    kinds = ", ".join(f"{c} {t}" for c, t in records.dtypes)
    return records.mapInArrow(go, f"{kinds}, _ll{i} array<double>")


def _normal(logs: Column) -> Column:
    e = once(logs, lambda a: once(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x - top))))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda t, y: t + y)
    return once(e, lambda a: once(total(a), lambda t: F.transform(a, lambda x: x / t)))


def _with_sums(out: DataFrame, rows: DataFrame, key: str, k: int, n: int) -> DataFrame:
    """``out`` with ``key_sum``, the languages' sums over all ``n`` ``rows`` of their key, and ``key_sum_n``.

    Keys that more than a HOT_SHARE-th of the rows have are broadcast; their rows are dealt out evenly
    where the others meet their sums.
    """
    sums = rows.groupBy(key).agg(F.count("*").alias("n"), *(F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(k)))
    side = sums.select(F.col(key).alias("_key"), F.struct(F.col("n"), F.array(*(F.col(f"s{i}") for i in range(k))).alias("s")).alias("_sums"))
    if key in ("markup", "path"):  # two or three letters: 18,278 values and null at most
        met = out.join(F.broadcast(side), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    else:
        side = written(side)
        hot = F.broadcast(side.where(F.col("_sums.n") > n // HOT_SHARE).withColumnRenamed("_sums", "_hot"))
        # No key of ``side`` starts with two blanks.
        rare = side.where(F.col("_sums.n") <= n // HOT_SHARE).withColumn("_key", F.coalesce(F.concat(F.lit(" ="), "_key"), F.lit(" ")))
        met = out.join(hot, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
        own = F.when(F.col("_hot").isNull(), F.coalesce(F.concat(F.lit(" ="), key), F.lit(" "))).otherwise(F.concat(F.lit("  "), F.xxhash64("doc_id", "page_id", "ll").cast("string")))
        met = met.withColumn("_own", own).join(rare, F.col("_own") == F.col("_key"), "left").withColumn("_sums", F.coalesce("_hot", "_sums")).drop("_own", "_key", "_hot")
    return met.withColumns({f"{key}_sum_n": F.col("_sums.n"), f"{key}_sum": F.col("_sums.s")}).drop("_sums")


def identify(records: DataFrame, languages: list[str], model: Model) -> DataFrame:
    """(doc_id, page_id, lang, probability, text_lang, markup, host) of every record."""
    k = len(languages)
    rows = written(_text_evidence(records, model).withColumn("p", _normal(F.col("ll"))))
    whole = rows.agg(F.count("*").alias("n"), *(F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(k))).first()
    n = whole["n"] or 0
    base = F.array(*(F.lit(((whole[f"s{i}"] or 0.0) + 1.0) / (n + k)) for i in range(k)))
    out = rows
    for key in ("markup", "suffix", "path", "host", "domain"):
        out = _with_sums(out, rows, key, k, n)

    def prior(i: Column) -> Column:
        own = F.get("p", i)
        domain = (F.get("domain_sum", i) - own + KAPPA * F.get("base", i)) / (F.col("domain_sum_n") - 1 + KAPPA)
        return (F.get("host_sum", i) - own + KAPPA * domain) / (F.col("host_sum_n") - 1 + KAPPA)

    def share(key: str, i: Column) -> Column:
        """log P(value | language) up to what all languages share: its lift over the corpus."""
        lift = (F.get(f"{key}_sum", i) - F.get("p", i) + FLAT * F.get("base", i)) / ((F.col(f"{key}_sum_n") - 1 + FLAT) * F.get("base", i))
        return F.when(F.col(key).isNull(), F.lit(0.0)).otherwise(F.log(F.greatest(lift, F.lit(1e-9))))

    logs = F.transform("ll", lambda x, i: x + F.log(F.greatest(prior(i), F.lit(1e-9))) + share("markup", i) + share("suffix", i) + share("path", i))
    # Of equal languages the first in code point order.
    best = lambda a: F.element_at(F.array(*map(F.lit, languages)), F.array_position(a, F.array_max(a)).cast("int"))
    return out.withColumn("base", base).withColumn("post", _normal(logs)).select(
        "doc_id", "page_id", best(F.col("post")).alias("lang"), F.array_max("post").alias("probability"),
        F.when(F.array_min("ll") < 0, best(F.col("ll"))).alias("text_lang"), "markup", "host",
    )


def digest(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Languages of all documents (doc_id) and all pages (page_id)."""
    records = documents_as_records(docs).unionByName(pages_as_records(pages))
    if docs.where("text is not null and lang is not null").isEmpty():
        none = F.lit(None).cast("string")
        return records.select("doc_id", "page_id", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), "markup", "host")
    return identify(records, *train(docs))
