"""Named plans over texts and stored tables, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as t
from ..operators import segment
from ..sources import writers
from ..sources.tables import source_dimension, table

S = "[\\t\\n\\x0B\\f\\r \\x{00A0}\\x{FEFF}]"
BL = "[\\t\\x0B\\f \\x{00A0}\\x{FEFF}]"
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

LINES = r"""
pieces AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS piece FROM documents),
placed AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM pieces),
paras AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY piece) - 1)::BIGINT AS para, text, char_start, (char_start + length(text))::BIGINT AS char_end, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))::BIGINT AS tokens FROM placed WHERE regexp_matches(text, '[^\t\n\x0B\f\r \x{00A0}\x{FEFF}]'))
"""


def chunk_ctes(target: int, overlap: int, lines: str = LINES) -> str:
    return f"""{lines},
n AS (SELECT doc_id, count(*)::BIGINT AS n, sum(tokens)::BIGINT AS total FROM paras GROUP BY 1),
pre AS (SELECT doc_id, para AS i, coalesce(sum(tokens) OVER (PARTITION BY doc_id ORDER BY para ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS p FROM paras UNION ALL SELECT doc_id, n, total FROM n),
ends AS (SELECT a.doc_id, a.i, a.p, greatest(a.i + 1, max(CASE WHEN b.p - a.p <= {target} THEN b.i END)) AS e FROM pre a JOIN pre b ON a.doc_id = b.doc_id AND b.i > a.i GROUP BY 1, 2, 3),
nexts AS (SELECT x.doc_id, x.i, x.e, greatest(x.i + 1, min(CASE WHEN q.p - o.p <= {overlap} THEN o.i END)) AS nx FROM ends x JOIN pre q ON q.doc_id = x.doc_id AND q.i = x.e JOIN pre o ON o.doc_id = x.doc_id AND o.i <= x.e AND o.i >= x.i GROUP BY 1, 2, 3),
orbit(doc_id, k, i) AS (SELECT doc_id, 0::BIGINT, 0::BIGINT FROM n UNION ALL SELECT o.doc_id, o.k + 1, x.nx FROM orbit o JOIN nexts x ON x.doc_id = o.doc_id AND x.i = o.i JOIN n ON n.doc_id = o.doc_id WHERE n.total > {target} AND x.nx < n.n),
cut AS (SELECT o.doc_id, o.k AS chunk_index, o.i AS first_para, CASE WHEN n.total <= {target} THEN n.n - 1 ELSE x.e - 1 END AS last_para FROM orbit o JOIN n ON n.doc_id = o.doc_id JOIN nexts x ON x.doc_id = o.doc_id AND x.i = o.i),
chunks AS (SELECT c.doc_id, c.chunk_index, c.first_para, c.last_para, a.char_start, z.char_end, (SELECT sum(s.tokens) FROM paras s WHERE s.doc_id = c.doc_id AND s.para BETWEEN c.first_para AND c.last_para)::BIGINT AS token_count FROM cut c JOIN paras a ON a.doc_id = c.doc_id AND a.para = c.first_para JOIN paras z ON z.doc_id = c.doc_id AND z.para = c.last_para)
"""


def _ragged(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.concat(F.lit(" \n"), F.regexp_replace("text", "\n", " \t\r\n"), F.lit("\n\n\n\nend \n")).alias("text"))


def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    n = t.normalized(F.col("text"))
    return _ragged(table(spark, sf, "documents")).select("doc_id", F.md5(n).alias("digest"), F.length(n).cast("long").alias("length"))


def line_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return segment.paragraphs(table(spark, sf, "documents")).select("doc_id", "para", "char_start", "char_end", "tokens")


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", t.token_count(F.col("text")).alias("tokens"))


def snippet(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", t.snippet(F.col("text"), 200).alias("snippet"), t.truncated(F.col("text"), 100).alias("short"))


def marker_extract(spark: SparkSession, sf: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf, "pages").select(
        "page_id", F.md5(t.between(html, "<article>", "</article>")).alias("article"), t.after_nth(html, "<li>", 2, "</li>").alias("second_item")
    )


ROMAN_DIGITS = [["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"], ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"], ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"], ["", "M", "MM", "MMM"]]


def _numeral(n):
    digit = lambda k: F.element_at(F.array(*map(F.lit, ROMAN_DIGITS[k])), (F.floor(n / 10**k) % 10 + 1).cast("int"))
    return F.concat(*(digit(k) for k in (3, 2, 1, 0)))


def roman_to_int(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", _numeral(F.col("event_id") % 3999 + 1).alias("numeral"))
    return rows.select("event_id", t.roman(F.col("numeral")).cast("long").alias("value"))


def _accepted(docs: DataFrame) -> DataFrame:
    """(doc_id, value, para, char_start, char_end): each paragraph is headed by its number, shifted now
    and then; of the numbers those that a growing sequence accepts, each up to the next one."""
    number = lambda x: x["para"] + 1 + F.when((F.col("doc_id") + x["para"] * 7) % 5 == 0, 6).otherwise(0)
    heads = F.transform("p", lambda x: F.struct(number(x).alias("value"), x["para"].alias("para"), x["char_start"].alias("char_start")))
    held = segment.offsets(docs).select("doc_id", "size", heads.alias("h"))
    rows = segment.monotone(held.withColumn("v", F.transform("h", lambda x: x["value"])), "v")
    kept = rows.select("doc_id", "size", F.transform(F.filter(F.arrays_zip("h", "ok"), lambda x: x["ok"]), lambda x: x["h"]).alias("h")).where(F.size("h") > 0)
    return kept.select("doc_id", F.explode(segment.bounded(F.col("h"), F.col("size"))).alias("x")).select("doc_id", "x.*")


def monotone_sections(spark: SparkSession, sf: str) -> DataFrame:
    return _accepted(table(spark, sf, "documents")).select("doc_id", "para", "value")


def section_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return _accepted(table(spark, sf, "documents")).select("doc_id", "value", "char_start", "char_end")


ACCEPTED = f"""{LINES},
heads AS (SELECT doc_id, para, char_start, para + 1 + CASE WHEN (doc_id + para * 7) % 5 = 0 THEN 6 ELSE 0 END AS value FROM paras),
walk(doc_id, para, want, took) AS (
  SELECT doc_id, para, CASE WHEN value BETWEEN 1 AND 4 THEN value + 1 ELSE 1 END, value BETWEEN 1 AND 4 FROM heads WHERE para = 0
  UNION ALL
  SELECT h.doc_id, h.para, CASE WHEN h.value BETWEEN w.want AND w.want + 3 THEN h.value + 1 ELSE w.want END, h.value BETWEEN w.want AND w.want + 3
  FROM walk w JOIN heads h ON h.doc_id = w.doc_id AND h.para = w.para + 1),
accepted AS (SELECT h.* FROM walk w JOIN heads h ON h.doc_id = w.doc_id AND h.para = w.para WHERE w.took)
"""


def chunk_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return segment.cut(segment.listed(table(spark, sf, "documents")), 500, 50)


def chunk_variant_stats(spark: SparkSession, sf: str) -> DataFrame:
    held = segment.listed(table(spark, sf, "documents"))
    # Variants that cut alike, as those with and without parents do, are cut once.
    alike: dict[tuple, list[str]] = {}
    for name, (target, overlap, _) in segment.VARIANTS.items():
        alike.setdefault((target, overlap), []).append(name)
    rows = [segment.cut(held, *cut).select(F.explode(F.array(*map(F.lit, names))).alias("version"), "token_count") for cut, names in alike.items()]
    every = reduce(DataFrame.unionByName, rows)
    return every.groupBy("version").agg(
        F.count("*").alias("chunks"), F.round(F.avg("token_count"), 4).alias("avg_tokens"), F.max("token_count").alias("max_tokens"), F.sum("token_count").alias("tokens")
    )


def chunk_parent_child(spark: SparkSession, sf: str) -> DataFrame:
    return segment.variant(table(spark, sf, "documents"), "parent").select("doc_id", "chunk_index", "char_start", "char_end", "parent_start", "parent_end")


SMALL_ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")


def _marked(docs: DataFrame, dialect: str = "books") -> DataFrame:
    """Texts with a section head before each line, some out of order, and a book head before every
    fourth line where the dialect has books."""
    roman = lambda n: F.element_at(F.array(*map(F.lit, SMALL_ROMAN)), n.cast("int"))
    i = lambda k: k.cast("long")
    number = lambda k: (k % 4 if dialect == "books" else k % 6) + 1 + F.when((F.col("doc_id") + k * 7) % 5 == 0, 6).otherwise(0)
    book = lambda k: F.when(k % 4 == 0, F.concat(F.lit("BOOK "), roman(F.floor(k / 4) % 12 + 1), F.lit("\n\n"))).otherwise("")
    mark = {"books": lambda k: F.lit(".--"), "footnotes": lambda k: F.when(k % 2 == 0, ".[12] ").otherwise(". ")}[dialect]
    line = lambda x, k: F.concat(book(i(k)) if dialect == "books" else F.lit(""), roman(number(i(k))), mark(i(k)), x)
    return docs.where("text is not null").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), line), "\n\n").alias("text"))


def book_sections(spark: SparkSession, sf: str) -> DataFrame:
    found = segment.sections_of(_marked(table(spark, sf, "documents")), "books")
    return found.select("doc_id", "section", "book", "numeral", "char_start", "char_end", F.md5("text").alias("digest"))


def flat_sections(spark: SparkSession, sf: str) -> DataFrame:
    found = segment.sections_of(_marked(table(spark, sf, "documents"), "footnotes"), "footnotes")
    return found.select("doc_id", "section", "numeral", "char_start", "char_end")


def section_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks within sections, numbered over the document, each with its section as parent."""
    found = segment.section_chunks(segment.sections_of(_marked(table(spark, sf, "documents")), "books", blocked=True), 60, 25)
    return found.withColumn("text", F.md5("text")).withColumnRenamed("text", "digest")


def ingest_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of each source: number, mean, most and sum of tokens."""
    docs = table(spark, sf, "documents")
    found = segment.section_chunks(segment.sections_of(_marked(docs), "books", blocked=True), 60, 25).join(docs.select("doc_id", "source"), "doc_id")
    return found.groupBy("source").agg(F.count("*").alias("chunks"), F.round(F.avg("token_count"), 4).alias("mean"), F.max("token_count").alias("most"), F.sum("token_count").alias("tokens"))


def neighbour_context(spark: SparkSession, sf: str) -> DataFrame:
    """Each chunk with the numbers of the chunks up to two before and after it, and their tokens."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(-2, 2)
    rows = segment.cut(segment.listed(table(spark, sf, "documents")), 300, 30)
    return rows.select("doc_id", "chunk_index", F.min("chunk_index").over(w).alias("first"), F.max("chunk_index").over(w).alias("last"), F.sum("token_count").over(w).alias("tokens"))


def group_document(spark: SparkSession, sf: str) -> DataFrame:
    p = segment.paragraphs(table(spark, sf, "documents")).withColumn("book", F.col("para") % 3)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", "text"))), lambda x: x["text"]), "\n\n")
    return p.groupBy("doc_id", "book").agg(F.md5(joined).alias("digest"), F.count("*").alias("paras"))


def context_profile(spark: SparkSession, sf: str) -> DataFrame:
    need = t.token_count(F.col("text")) + 3000
    return table(spark, sf, "documents").select("doc_id", segment.context_tier(need).cast("long").alias("tier"))


def clamp_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(t.clamp(F.col("text"), 100)).alias("digest"))


def chunk_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy chunks whose tokens are ids of a rank table, here the one without merges."""
    return segment.cut(segment.listed(table(spark, sf, "documents"), count=ids.counter(ids.BYTES)), 2000, 200)


def clamp_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Texts after their 200th id of the same table, cut and decoded."""
    rows = ids.clamped(table(spark, sf, "documents").select("doc_id", "text"), "text", 200, ids.BYTES)
    return rows.select("doc_id", "tokens", F.md5("text").alias("digest"))


def context_text(spark: SparkSession, sf: str) -> DataFrame:
    docs, dim = table(spark, sf, "documents"), source_dimension(table(spark, sf, "documents"))
    cited = t.citation(F.col("author"), F.col("title"), t.chapter_label(F.col("lang"), F.col("doc_id")))
    note = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("note "), F.col("doc_id").cast("string")))
    return docs.join(dim, "source").select(
        "doc_id", F.md5(t.contextual(cited, note, F.col("text"))).alias("digest"),
        t.long_citation(F.col("author"), F.col("title"), F.col("translator"), F.col("year")).alias("citation"),
    )


def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("balance"))
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("balance"))
    return writers.upsert(old, new, ["c_custkey"])


def latest_order(spark: SparkSession, sf: str) -> DataFrame:
    return writers.latest(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


def replace_partition(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.round("c_acctbal", 2).alias("balance"))
    new = old.where("c_mktsegment = 'BUILDING' and balance > 0").withColumn("balance", F.lit(0.0))
    return old.join(new.select("c_mktsegment").distinct(), "c_mktsegment", "left_anti").unionByName(new)


def dup_keys(spark: SparkSession, sf: str) -> DataFrame:
    return writers.duplicate_keys(table(spark, sf, "documents").select(F.md5("text").alias("digest")), ["digest"])


def orphans(spark: SparkSession, sf: str) -> DataFrame:
    labels, docs = table(spark, sf, "labels"), table(spark, sf, "documents")
    return writers.orphans(docs.select("doc_id", "source"), labels, "doc_id", "doc_id")


def source_inventory(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return docs.join(labels, "doc_id", "left").groupBy("source").agg(
        F.count("*").alias("docs"), F.count("quality").alias("judged"), F.count(F.when(F.col("toxic") == 1, 1)).alias("toxic"), F.countDistinct("lang").alias("langs")
    )


def chapter_listing(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("first_doc")).cast("long"))


def count_non_null(spark: SparkSession, sf: str) -> DataFrame:
    """Sources without a matching row stay: the condition is part of the join."""
    dim, docs = source_dimension(table(spark, sf, "documents")), table(spark, sf, "documents")
    es = docs.where("lang = 'es' and n_chars > 4000")
    return dim.join(es, "source", "left").groupBy("source").agg(F.count("doc_id").alias("chunks"), F.sum("n_chars").cast("long").alias("chars"), F.first("year").alias("year"))


QUERIES = {f.__name__: f for f in (normalize_text, line_paragraphs, token_counts, snippet, marker_extract, roman_to_int, monotone_sections, section_bounds, chunk_greedy, book_sections, flat_sections, section_chunks, ingest_stats, neighbour_context, chunk_variant_stats, chunk_parent_child, group_document, context_profile, clamp_tokens, chunk_bytes, clamp_bytes, context_text, upsert_latest, latest_order, replace_partition, dup_keys, orphans, source_inventory, chapter_listing, count_non_null)}

_roman = lambda n: f"(['" + "','".join(SMALL_ROMAN) + f"'])[{n}]"


def marked_ctes(dialect: str = "books") -> str:
    """CTEs that end in ``secs``: accepted sections of the marked texts, found by position, not by pattern."""
    books = dialect == "books"
    number = f"(i % {4 if books else 6} + 1 + CASE WHEN (doc_id + i * 7) % 5 = 0 THEN 6 ELSE 0 END)"
    head = f"CASE WHEN i % 4 = 0 THEN 'BOOK ' || {_roman('i // 4 % 12 + 1')} || chr(10) || chr(10) ELSE '' END" if books else "''"
    mark = "'.--'" if books else "CASE WHEN i % 2 = 0 THEN '.[12] ' ELSE '. ' END"
    group = "i // 4" if books else "0"
    return f"""
ml AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
mp AS (SELECT doc_id, i, {group} AS g, {number} AS v, {head} AS head, {_roman(number)} || {mark} || line AS body FROM ml),
mo AS (SELECT *, coalesce(sum(length(head) + length(body) + 2) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM mp),
mt AS (SELECT doc_id, string_agg(head || body, chr(10) || chr(10) ORDER BY i) AS text FROM mp GROUP BY 1),
mw(doc_id, i, g, want, took) AS (
  SELECT doc_id, i, g, CASE WHEN v BETWEEN 1 AND 4 THEN v + 1 ELSE 1 END, v BETWEEN 1 AND 4 FROM mo WHERE i = 0
  UNION ALL
  SELECT n.doc_id, n.i, n.g, CASE WHEN n.v BETWEEN b.want AND b.want + 3 THEN n.v + 1 ELSE b.want END, n.v BETWEEN b.want AND b.want + 3
  FROM (SELECT doc_id, i, g, want FROM mw) w JOIN mo n ON n.doc_id = w.doc_id AND n.i = w.i + 1, LATERAL (SELECT CASE WHEN n.g = w.g THEN w.want ELSE 1 END AS want) b),
ends AS (SELECT m.doc_id, m.g, coalesce(min(n.at), length(any_value(t.text)))::BIGINT AS book_end FROM (SELECT DISTINCT doc_id, g FROM mo) m LEFT JOIN mo n ON n.doc_id = m.doc_id AND n.g > m.g JOIN mt t ON t.doc_id = m.doc_id GROUP BY 1, 2),
acc AS (SELECT o.doc_id, o.g, o.i, {_roman('o.v')} AS numeral, o.at + length(o.head) AS char_start FROM mo o JOIN mw w ON w.doc_id = o.doc_id AND w.i = o.i WHERE w.took),
secs AS (SELECT a.doc_id, (row_number() OVER (PARTITION BY a.doc_id ORDER BY i) - 1)::BIGINT AS section, 'Book ' || {_roman('a.g % 12 + 1')} AS book, numeral, char_start,
  coalesce(lead(char_start) OVER (PARTITION BY a.doc_id, a.g ORDER BY i), e.book_end)::BIGINT AS char_end FROM acc a JOIN ends e ON e.doc_id = a.doc_id AND e.g = a.g),
sect AS (SELECT s.*, regexp_replace(substring(t.text, char_start + 1, char_end - char_start), '^{S}+|{S}+$', '', 'g') AS text FROM secs s JOIN mt t ON t.doc_id = s.doc_id)"""


#: Blocks of the sections as paragraphs; a section's key stands where a document's does.
SECTION_LINES = marked_ctes() + r""",
pieces AS (SELECT doc_id * 1000000 + section AS doc_id, unnest(string_split(text, chr(10) || chr(10))) AS text, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS piece FROM sect),
placed AS (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM pieces),
paras AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY piece) - 1)::BIGINT AS para, text, char_start, (char_start + length(text))::BIGINT AS char_end, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))::BIGINT AS tokens FROM placed WHERE regexp_matches(text, '[^\t\n\x0B\f\r \x{00A0}\x{FEFF}]'))
"""
SECTION_CHUNKS = f"""WITH RECURSIVE {chunk_ctes(60, 25, SECTION_LINES).replace("ends AS (SELECT a.doc_id, a.i", "reach AS (SELECT a.doc_id, a.i").replace("FROM ends x JOIN pre q", "FROM reach x JOIN pre q")},
sc AS (SELECT s.doc_id, s.section, c.chunk_index AS local, s.book || ', §' || s.numeral AS chapter, s.char_start AS parent_start, s.char_end AS parent_end, c.token_count,
  CASE WHEN n.total <= 60 THEN s.char_start ELSE s.char_start + c.char_start END AS char_start, CASE WHEN n.total <= 60 THEN s.char_end ELSE s.char_start + c.char_end END AS char_end,
  CASE WHEN n.total <= 60 THEN s.text ELSE substring(s.text, c.char_start + 1, c.char_end - c.char_start) END AS text
  FROM sect s JOIN chunks c ON c.doc_id = s.doc_id * 1000000 + s.section JOIN n ON n.doc_id = c.doc_id)"""

DIM = r"""
dim AS (SELECT source, 'Author ' || upper(source) AS author, 'Title of ' || source AS title, CASE WHEN k % 7 = 3 THEN NULL ELSE k * 40 - 300 END::BIGINT AS year, CASE WHEN k % 4 = 0 THEN 'Translator ' || k::VARCHAR END AS translator
FROM (SELECT DISTINCT source, try_cast(regexp_extract(source, '(\d+)$', 1) AS INT) AS k FROM documents WHERE source IS NOT NULL))
"""

BYTE_LINES = LINES.replace(r"len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))", "strlen(text)")

SQL = {
    "normalize_text": rf"""
WITH r AS (SELECT doc_id, ' ' || chr(10) || replace(text, chr(10), ' ' || chr(9) || chr(13) || chr(10)) || repeat(chr(10), 4) || 'end ' || chr(10) AS t FROM documents),
a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\r\n?', chr(10), 'g'), '{BL}+(\n|$)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM r),
b AS (SELECT doc_id, regexp_replace(t, '^{S}+|{S}+$', '', 'g') AS t FROM a)
SELECT doc_id, md5(t) AS digest, length(t)::BIGINT AS length FROM b""",
    "line_paragraphs": f"WITH {LINES} SELECT doc_id, para, char_start, char_end, tokens FROM paras",
    "token_counts": f"SELECT doc_id, len({TOKENS})::BIGINT AS tokens FROM documents",
    "snippet": rf"""
SELECT doc_id, substring(trim(regexp_replace(text, '{S}+', ' ', 'g')), 1, 200) AS snippet, CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '... (+' || (length(text) - 100)::VARCHAR || ' chars)' ELSE text END AS short FROM documents""",
    "marker_extract": rf"""
WITH a AS (SELECT page_id, html, substring(html, instr(html, '<article>') + 9) AS rest, string_split(html, '<li>')[3] AS item FROM pages)
SELECT page_id, CASE WHEN instr(html, '<article>') > 0 AND instr(rest, '</article>') > 0 THEN md5(regexp_replace(substring(rest, 1, instr(rest, '</article>') - 1), '^{S}+|{S}+$', '', 'g')) END AS article,
CASE WHEN item IS NOT NULL THEN string_split(item, '</li>')[1] END AS second_item FROM a""",
    "roman_to_int": "SELECT event_id, (event_id % 3999 + 1)::BIGINT AS value FROM events",
    "monotone_sections": f"WITH RECURSIVE {ACCEPTED} SELECT doc_id, para, value::BIGINT AS value FROM accepted",
    "section_bounds": f"WITH RECURSIVE {ACCEPTED} SELECT a.doc_id, value::BIGINT AS value, char_start, coalesce(lead(char_start) OVER (PARTITION BY a.doc_id ORDER BY char_start), length(d.text))::BIGINT AS char_end FROM accepted a JOIN documents d ON d.doc_id = a.doc_id",
    "chunk_bytes": f"WITH RECURSIVE {chunk_ctes(2000, 200, BYTE_LINES)} SELECT * FROM chunks",
    "clamp_bytes": """
WITH p AS (SELECT doc_id, text, list_max(list_filter(range(0, 201), lambda n: strlen(substring(text, 1, n)) <= 200)) AS n FROM documents)
SELECT doc_id, strlen(text)::BIGINT AS tokens, md5(CASE WHEN strlen(text) <= 200 THEN text ELSE substring(text, 1, n) || CASE WHEN strlen(substring(text, 1, n)) < 200 THEN chr(65533) ELSE '' END END) AS digest FROM p""",
    "chunk_greedy": f"WITH RECURSIVE {chunk_ctes(500, 50)} SELECT * FROM chunks",
    "chunk_variant_stats": " UNION ALL ".join(
        f"SELECT '{v}' AS version, count(*)::BIGINT AS chunks, round(avg(token_count), 4) AS avg_tokens, max(token_count) AS max_tokens, sum(token_count)::BIGINT AS tokens FROM (WITH RECURSIVE {chunk_ctes(a, b)} SELECT * FROM chunks)"
        for v, (a, b, _) in segment.VARIANTS.items()
    ),
    "chunk_parent_child": f"WITH RECURSIVE {chunk_ctes(500, 50)} SELECT c.doc_id, chunk_index, char_start, char_end, 0::BIGINT AS parent_start, length(d.text)::BIGINT AS parent_end FROM chunks c JOIN documents d ON d.doc_id = c.doc_id",
    "book_sections": f"WITH RECURSIVE {marked_ctes()} SELECT doc_id, section, book, numeral, char_start, char_end, md5(text) AS digest FROM sect",
    "flat_sections": f"WITH RECURSIVE {marked_ctes('footnotes')} SELECT doc_id, section, numeral, char_start, char_end FROM secs",
    "section_chunks": f"{SECTION_CHUNKS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY section, local) - 1)::BIGINT AS chunk_index, chapter, md5(text) AS digest, char_start, char_end, token_count, parent_start, parent_end FROM sc",
    "ingest_stats": f"{SECTION_CHUNKS} SELECT source, count(*)::BIGINT AS chunks, round(avg(token_count), 4) AS mean, max(token_count) AS most, sum(token_count)::BIGINT AS tokens FROM sc JOIN documents USING (doc_id) GROUP BY 1",
    "neighbour_context": f"WITH RECURSIVE {chunk_ctes(300, 30)} SELECT doc_id, chunk_index, min(chunk_index) OVER w AS first, max(chunk_index) OVER w AS last, sum(token_count) OVER w::BIGINT AS tokens FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    "group_document": f"WITH {LINES} SELECT doc_id, para % 3 AS book, md5(string_agg(text, chr(10) || chr(10) ORDER BY para)) AS digest, count(*)::BIGINT AS paras FROM paras GROUP BY 1, 2",
    "context_profile": f"SELECT doc_id, CASE WHEN n <= 16384 THEN 16384 WHEN n <= 32768 THEN 32768 WHEN n <= 65536 THEN 65536 ELSE 102400 END::BIGINT AS tier FROM (SELECT doc_id, len({TOKENS}) + 3000 AS n FROM documents)",
    "clamp_tokens": r"""
WITH p AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}]+') AS tk, string_split_regex(text, '[\p{L}\p{N}]+') AS gap FROM documents)
SELECT doc_id, md5(CASE WHEN len(tk) > 100 THEN substring(text, 1, (list_sum(list_transform(tk[1:100], lambda x: length(x))) + list_sum(list_transform(gap[1:100], lambda x: length(x))))::BIGINT) ELSE text END) AS digest FROM p""",
    "context_text": rf"""
WITH {DIM} SELECT doc_id, md5(author || ', ' || title || ', ' || lang || ', §' || doc_id::VARCHAR || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || 'note ' || doc_id::VARCHAR END || chr(10) || chr(10) || regexp_replace(text, '^{S}+|{S}+$', '', 'g')) AS digest,
author || ', ' || title || coalesce(', tr. ' || translator, '') || ' (' || CASE WHEN year IS NULL THEN 'date unknown' WHEN year < 0 THEN '~' || (-year)::VARCHAR || ' BC' ELSE '~' || year::VARCHAR || ' AD' END || ')' AS citation
FROM documents JOIN dim USING (source)""",
    "upsert_latest": """
WITH n AS (SELECT o_custkey AS c_custkey, round(sum(o_totalprice), 2) AS balance FROM orders GROUP BY 1)
SELECT c_custkey, round(c_acctbal, 2) AS balance FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n""",
    "latest_order": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "replace_partition": """
SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0::DOUBLE ELSE round(c_acctbal, 2) END AS balance FROM customer WHERE c_mktsegment <> 'BUILDING' OR round(c_acctbal, 2) > 0""",
    "dup_keys": "SELECT md5(text) AS digest, count(*)::BIGINT AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "orphans": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "source_inventory": "SELECT source, count(*)::BIGINT AS docs, count(quality)::BIGINT AS judged, count(CASE WHEN toxic = 1 THEN 1 END)::BIGINT AS toxic, count(DISTINCT lang)::BIGINT AS langs FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "chapter_listing": "SELECT *, row_number() OVER (PARTITION BY source ORDER BY first_doc)::BIGINT AS place FROM (SELECT source, lang, count(*)::BIGINT AS docs, min(doc_id) AS first_doc FROM documents GROUP BY 1, 2)",
    "count_non_null": f"WITH {DIM} SELECT d.source, count(doc_id)::BIGINT AS chunks, sum(n_chars)::BIGINT AS chars, any_value(year) AS year FROM dim d LEFT JOIN documents x ON x.source = d.source AND lang = 'es' AND n_chars > 4000 GROUP BY 1",
}
