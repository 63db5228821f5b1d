"""Named plans of composed retrieval, prompts, evaluation runs and logs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import answers, guards, text as t
from ..operators import cost, evaluate, fusion, inverted, lexical, providers, retrieve as r, vector
from ..sources import store, writers
from ..sources.tables import known_or_fail, source_dimension, source_url, table
from . import retrieval, scoring
from .corpus import DIM, S
from .retrieval import bm25


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a vector as chunks of two versions; some have a context note."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    i = F.col("doc_id")
    return docs.select(
        i.alias("chunk_id"), F.col("source").alias("source_id"), F.when(i % 4 == 3, "contextual-v1").otherwise("naive-v1").alias("chunking_version"),
        (i % 7).alias("chunk_index"), t.chapter_label(F.lit(None).cast("string"), i % 7 + 1).alias("chapter"), "text",
        F.when(i % 3 == 0, F.concat(F.lit("note "), "lang")).alias("context"), (i % 5 * 100).alias("char_start"), (i % 5 * 100 + F.col("n_chars")).alias("char_end"), "embedding",
    )


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    return source_dimension(table(spark, sf, "documents")).select(F.col("source").alias("source_id"), F.col("source").alias("slug"), "author", "title", "year", "translator")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk whose id is divisible by 20 asks with its own text and vector, within its source."""
    return _chunks(spark, sf).where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("text").alias("question"), F.col("embedding").alias("vector"), F.col("source_id").alias("slug"))


def _vector(spark: SparkSession, sf: str, **options) -> DataFrame:
    return r.retrieve(_asked(spark, sf), _chunks(spark, sf), _sources(spark, sf), **options)


PROJECTION = ("query_id", "rank", "chunk_id", "slug", "author", "title", "year", "chapter", "chunk_index", "char_start", "char_end", "similarity")


def retrieve_vector(spark: SparkSession, sf: str) -> DataFrame:
    return _vector(spark, sf).select(*PROJECTION)


def retrieve_scoped(spark: SparkSession, sf: str) -> DataFrame:
    return _vector(spark, sf, scoped=True, top_k=3).select(*PROJECTION)


def retrieve_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return _vector(spark, sf, mode="hybrid").select("query_id", "rank", "chunk_id", "slug", "chapter", "similarity", "rrf")


def retrieve_reranked(spark: SparkSession, sf: str) -> DataFrame:
    return _vector(spark, sf, rerank=True).select("query_id", "rank", "first_rank", "chunk_id", "slug", "rerank")


def retrieve_parent(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty chunks, of which five are cut before their sections take their place."""
    i = F.col("chunk_id")
    parents = _chunks(spark, sf).where(i % 5 != 0).select("chunk_id", F.concat(F.lit("section "), (i % 3).cast("string"), F.lit(" of "), "source_id").alias("parent_text"), (i % 3 * 1000).alias("parent_start"), (i % 3 * 1000 + 999).alias("parent_end"))
    rows = r.expanded(_vector(spark, sf, top_k=20), parents, 5)
    return rows.select("query_id", "rank", "chunk_id", "slug", F.md5("text").alias("digest"), "char_start", "char_end")


def retrieve_multi_query(spark: SparkSession, sf: str) -> DataFrame:
    """Vector lists of a question and of its text without one word, fused and reranked by the question."""
    chunks, q = _chunks(spark, sf), _asked(spark, sf)
    one = _vector(spark, sf, top_k=50).select("query_id", "chunk_id", "rank")
    terms = lexical.query_terms(q.select("query_id", F.col("question").alias("text")), "query_id")
    own = chunks.where("chunking_version = 'naive-v1'").select("chunk_id", "text")
    scores = inverted.once(own, "chunk_id", terms, "query_id", 50).withColumn("score", F.round("score", 6))
    two = fusion.ranked(scores, "query_id", "chunk_id", "score", 50).select("query_id", "chunk_id", "rank")
    return r.many_variants([one, two], q.select("query_id", "question"), chunks.select("chunk_id", "text"), 50, 5)


def retrieve_variants(spark: SparkSession, sf: str) -> DataFrame:
    """A question and a variant of it, each searched by its own vector (that of the next chunk's text
    stands for the variant's), fused, and the pool reranked by the question itself."""
    chunks, q = _chunks(spark, sf), _asked(spark, sf)
    other = chunks.where("(chunk_id - 1) % 20 = 0").select((F.col("chunk_id") - 1).alias("query_id"), F.col("text").alias("question"), F.col("embedding").alias("vector"), F.col("source_id").alias("slug"))
    other = other.join(q.select("query_id"), "query_id", "left_semi")
    lists = [r.retrieve(x, chunks, _sources(spark, sf), top_k=50).select("query_id", "chunk_id", "rank") for x in (q, other)]
    return r.many_variants(lists, q.select("query_id", "question"), chunks.select("chunk_id", "text"), 50, 5)


def query_variants(spark: SparkSession, sf: str) -> DataFrame:
    """A question and its rephrasings, trimmed, none empty, three at most."""
    q = t.trimmed(F.col("text"))
    rows = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.concat(F.array(q), providers.variations(F.col("text")))).alias("at", "q"))
    return rows.select("item_id", F.col("at").cast("long").alias("at"), F.md5("q").alias("digest"))


def chunk_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks by a list of ids, with their source and its citation."""
    ids = table(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id"))
    rows = ids.join(_chunks(spark, sf).drop("embedding"), "chunk_id").join(_sources(spark, sf), "source_id")
    return rows.select("chunk_id", "slug", t.citation(F.col("author"), F.col("title"), F.col("chapter")).alias("citation"), t.year(F.col("year")).alias("written"), "translator", F.md5("text").alias("digest"))


def manifest_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Each source's manifest row; a name without one stops the query and lists those known."""
    names = table(spark, sf, "documents").where("source is not null").groupBy("source").agg(F.count("*").alias("docs"))
    return known_or_fail(names, source_dimension(table(spark, sf, "documents")).select("source", "title"), "source", "title")


def distinct_fetch(spark: SparkSession, sf: str) -> DataFrame:
    """Files are fetched once each, though several documents name one."""
    docs = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 50).alias("file"))
    files = docs.select("file").distinct().withColumn("url", source_url(F.col("file")))
    return docs.join(files, "file").select("doc_id", "url")


# The wordings of prompts and lists below are fixed values: what a model reads must be the same.

# -- prompts --------------------------------------------------------------------------------------


def _shown(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("question"))
    return _vector(spark, sf).join(q, "query_id")


def user_message(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered sources, then the question; a question without sources says so."""
    meta = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "author", F.lit(", "), "title", F.lit(" ("), t.year(F.col("year")), F.lit("), "), "chapter", F.lit("\n"), t.trimmed(F.col("text")), F.lit("\n"))
    blocks = _shown(spark, sf).groupBy("query_id").agg(r.ordered(meta).alias("b"))
    q = _asked(spark, sf).select("query_id", "question")
    body = F.when(F.col("b").isNull(), F.concat(F.lit("Question: "), "question", F.lit("\n\n(No sources were retrieved for this question.)"))).otherwise(F.concat(F.lit("Sources:\n\n"), "b", F.lit("\nQuestion: "), "question"))
    return q.join(blocks, "query_id", "left").select("query_id", F.md5(body).alias("digest"))


def result_list(spark: SparkSession, sf: str) -> DataFrame:
    """What a search shows: ids, citations and snippets."""
    cited = t.citation(F.col("author"), F.col("title"), F.col("chapter"))
    line = F.concat(F.lit("["), F.col("chunk_id").cast("string"), F.lit("] "), cited, F.lit('\n    "'), t.snippet(F.col("text"), 200), F.lit('…"'))
    g = _vector(spark, sf).groupBy("query_id").agg(F.count("*").alias("n"), r.ordered(line).alias("x"))
    return g.select("query_id", F.md5(F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(" chunk(s):\n\n"), "x", F.lit("\n\nCall read_chunk(chunk_id) for the full text before citing."))).alias("digest"))


def faithfulness_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """The judge's prompt, passages labelled by rank and by chunk id."""
    def block(label: str):
        return F.concat(F.lit("\n["), F.col(label).cast("string"), F.lit("] "), t.citation(F.col("author"), F.col("title"), F.col("chapter")), F.lit("\n"), t.trimmed(F.col("text")))

    g = _shown(spark, sf).groupBy("query_id", "question").agg(r.ordered(block("rank")).alias("a"), r.ordered(block("chunk_id")).alias("b"))
    whole = lambda c: F.md5(F.concat(F.lit("Question:\n"), "question", F.lit("\n\nSource passages:\n"), c, F.lit("\n\nCandidate answer:\n"), "question"))
    return g.select("query_id", whole("a").alias("by_rank"), whole("b").alias("by_id"))


def judge_prompts(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("text")
    lines = F.concat_ws("\n", F.lit("Question:"), F.col("source"), F.lit(""), F.lit("Ideal answer:"), F.col("lang"), F.lit(""), F.lit("Candidate answer:"), x)
    return table(spark, sf, "documents").select("doc_id", F.md5(lines).alias("completeness"), F.md5(F.concat(F.lit("Candidate answer:\n"), x)).alias("refusal"))


def frozen_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Test cases with their sources as one block, gold hits and whether to refuse."""
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), t.citation(F.col("author"), F.col("title"), F.col("chapter")), F.lit("\n"), t.trimmed(F.col("text")))
    gold = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("chunk_id"), F.lit(1).alias("gold"))
    g = _vector(spark, sf).join(gold, "chunk_id", "left").groupBy("query_id").agg(r.ordered(line, sep="\n\n").alias("b"), F.count("gold").alias("hits"))
    category = F.element_at(F.array(*map(F.lit, scoring.CATEGORIES)), (F.col("query_id") / 20 % 6 + 1).cast("int"))
    return g.select("query_id", category.alias("category"), F.md5("b").alias("sources"), "hits", ((F.col("hits") == 0) | (category == "out-of-scope")).alias("should_refuse"))


def tag_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(t.tags({"context": F.col("text"), "question": F.col("source"), "n": F.col("n_chars")})).alias("digest"))


def source_index(spark: SparkSession, sf: str) -> DataFrame:
    """The list of books: one line a source, oldest first, undated last; with counts of its chunks."""
    n = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("parts"))
    d = source_dimension(table(spark, sf, "documents")).join(n, "source")
    line = F.concat(F.lit("- **"), "title", F.lit("** by "), "author", F.lit(" ("), t.year(F.col("year")), F.lit("): "), F.col("n").cast("string"), F.lit(" chunks in "), F.col("parts").cast("string"))
    w = Window.orderBy(F.asc_nulls_last("year"), "source")  # a row a source
    return d.select("source", line.alias("line"), F.row_number().over(w).cast("long").alias("place"))


def prefix_completion(spark: SparkSession, sf: str) -> DataFrame:
    """Sources by each prefix of two characters that they begin with."""
    names = table(spark, sf, "documents").where("source is not null").select("source").distinct()
    asked = names.select(F.substring("source", 1, 2).alias("prefix")).distinct()
    return asked.join(names, F.col("source").startswith(F.col("prefix"))).groupBy("prefix").agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"))


# -- evaluation -----------------------------------------------------------------------------------


def gold_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Share of a question's spans that the union of what its searches consulted covers, whatever the rank.

    Three searches, by the question and by it without its first and without its last word, of five
    documents each; a document that several give counts once. Without spans there is no share.
    """
    lists = [retrieval._lexical(spark, sf, retrieval._whole(spark, sf, *ends), 5).select(F.col("query_id").alias("question"), F.col("doc_id").alias("source")) for ends in SEARCHES]
    consulted = lists[0].union(lists[1]).union(lists[2]).distinct()
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("source"), F.lit(0).cast("long").alias("char_start"), F.col("n_chars").alias("char_end"))
    spans = scoring.gold(spark, sf).withColumnRenamed("doc_id", "source")
    hit = evaluate.covered(consulted.join(docs, "source"), spans).where("question = item_id").groupBy("question").agg(F.count("*").alias("hits"))
    n = spans.groupBy(F.col("item_id").alias("question")).agg(F.count("*").alias("spans"))
    category = F.element_at(F.array(*map(F.lit, scoring.CATEGORIES)), (F.col("item_id") % 6 + 1).cast("int"))
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("question"), category.alias("category"))
    rows = items.join(n, "question", "left").join(hit, "question", "left")
    return rows.select("question", "category", F.coalesce("spans", F.lit(0)).alias("spans"), F.when(F.col("spans") > 0, F.round(F.coalesce("hits", F.lit(0)) / F.col("spans"), 6)).alias("coverage"))


SEARCHES = ((0, 0), (1, 0), (0, 1))


def _graded(spark: SparkSession, sf: str) -> DataFrame:
    """A run's results: every 17th failed and stays ungraded, the others have scores and costs."""
    i = F.col("doc_id")
    category = F.element_at(F.array(*map(F.lit, scoring.CATEGORIES)), (i % 6 + 1).cast("int"))
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").where(category != "contradiction")
    error = F.when(i % 17 == 0, F.concat(F.lit("HTTP "), F.when(i % 2 == 0, "503").otherwise("400")))
    ok = error.isNull()
    correct = guards.refusal_label(F.col("quality") == 0, F.col("toxic") == 1).startswith("correct")
    return rows.select(
        "doc_id", category.alias("category"), error.alias("error"), F.when(ok, 1 + 4 * F.col("quality") - i % 2).alias("faithfulness"), F.when(ok, 5 - 2 * F.col("toxic") - i % 3).alias("completeness"),
        F.when(ok, correct).alias("correct"), F.when(ok, i % 100).alias("generator"), F.when(ok & (i % 5 != 0), i % 10).alias("judge"),
    )


def run_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """A batch run, overall and by category: graded answers, means, share of right refusals, costs.
    Failed rows count but are in no mean; a category without rows has no line."""
    mean = lambda c: F.round(F.avg(c), 6)
    every = evaluate.with_total(
        _graded(spark, sf), "category", F.count("*").alias("n"), F.count("faithfulness").alias("answered"), mean("faithfulness").alias("faithfulness"), mean("completeness").alias("completeness"),
        mean(F.col("correct").cast("int")).alias("refusals_right"), F.sum(F.coalesce("generator", F.lit(0))).alias("generator_cost"), F.sum(F.coalesce("judge", F.lit(0))).alias("judge_cost"),
    )
    return every.where("n > 0")


def error_isolation(spark: SparkSession, sf: str) -> DataFrame:
    """Failures by message, whether another try is worth it."""
    rows = _graded(spark, sf).where("error is not null")
    return rows.groupBy("error").agg(F.count("*").alias("n"), F.first(guards.transient(F.col("error"))).alias("again"), F.first(guards.unparsed(F.col("error"))).alias("other_form"))


def rejudge(spark: SparkSession, sf: str) -> DataFrame:
    """Stored scores beside new ones, overall and by category, with the change."""
    new = table(spark, sf, "labels").select("doc_id", (5 - 3 * F.col("toxic")).alias("new"))
    rows = _graded(spark, sf).where("error is null").join(new, "doc_id").select("category", F.col("completeness").alias("old"), "new")
    g = evaluate.with_total(rows, "category", F.count("*").alias("n"), F.avg("old").alias("a"), F.avg("new").alias("b"), F.count_if(F.col("new") > F.col("old")).alias("up"), F.count_if(F.col("new") < F.col("old")).alias("down"))
    d = F.round(F.col("b") - F.col("a"), 6)
    shown = F.concat(F.when(d >= 0, "+").otherwise("-"), F.format_string("%.2f", F.abs(F.round(d, 2))))
    return g.select("category", "n", F.round("a", 6).alias("old"), F.round("b", 6).alias("new"), d.alias("delta"), shown.alias("shown"), "up", "down")


def agent_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of a tool loop, overall and by category: calls, share that ended by itself, consulted, coverage, cost."""
    log = table(spark, sf, "events").select("user_id", "event_type", "value")
    runs = log.groupBy("user_id").agg(
        F.count("*").alias("calls"), F.max((F.col("event_type") == "purchase").cast("int")).alias("done"), F.countDistinct("event_type").alias("consulted"),
        F.sum(F.round(F.col("value") * 100).cast("long")).alias("cost"), F.count_if(F.col("value") > 200).alias("hit"), F.count_if(F.col("value") > 150).alias("spans"),
    )
    coverage = F.when((F.col("user_id") % 5 != 0) & (F.col("spans") > 0), F.col("hit") / F.col("spans")).otherwise(F.lit(float("nan")))
    category = F.element_at(F.array(*map(F.lit, scoring.CATEGORIES)), (F.col("user_id") % 6 + 1).cast("int"))
    rows = runs.select("*", category.alias("category"), coverage.alias("coverage"))
    mean = lambda c: F.round(F.avg(c), 6)
    return evaluate.with_total(
        rows, "category", F.count("*").alias("runs"), mean("calls").alias("calls"), mean("done").alias("finalized"), mean("consulted").alias("consulted"),
        F.round(evaluate.mean_skipping_nan("coverage"), 6).alias("coverage"), F.sum("cost").alias("cost"),
    )


def top_gold_marks(spark: SparkSession, sf: str) -> DataFrame:
    """The first three rows of each question and whether they hold a passage."""
    ranks = retrieval._lexical(spark, sf, retrieval._whole(spark, sf), 3)
    g = scoring.gold(spark, sf).select(F.col("item_id").alias("query_id"), "doc_id", F.lit(True).alias("gold"))
    return ranks.join(g, ["query_id", "doc_id"], "left").select("query_id", "rank", "doc_id", F.coalesce("gold", F.lit(False)).alias("gold"))


PROMPTS = {"short": "{{text}}", "long": "Read this:\n{{text}}\nThen answer."}


def prompt_ab(spark: SparkSession, sf: str) -> DataFrame:
    """Every prompt with every message: prompts as columns, messages as rows."""
    cases = table(spark, sf, "conversations").where("role = 'user'")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("prompt"), t.rendered(p, {"text": F.col("text")}).alias("said")) for n, p in PROMPTS.items())))
    rows = cases.select("conv_id", "turn", each.alias("x")).select("conv_id", "turn", "x.prompt", F.md5("x.said").alias("said"))
    return rows.groupBy("conv_id", "turn").pivot("prompt", list(PROMPTS)).agg(F.first("said"))


def ab_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs of the same cases side by side, by key and not by position."""
    run = lambda role: table(spark, sf, "conversations").where(F.col("role") == role).select("conv_id", F.floor(F.col("turn") / 2).alias("case"), F.length("text").cast("long").alias(role))
    return run("user").join(run("assistant"), ["conv_id", "case"], "full_outer")


def call_stats(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", F.round(F.col("value") * 10).cast("long").alias("ms"))
    return e.groupBy("event_type").agg(F.count("*").alias("calls"), F.sum("ms").alias("total_ms"), F.round(F.avg("ms"), 6).alias("mean_ms"))


def golden_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of two categories and of the first ids; which of them ought to be refused."""
    s = scoring._golden(spark, sf).where(F.col("category").isin("literal", "out-of-scope", "synthesis"))
    return s.select("question", "category", (F.col("spans") > 0).alias("in_scope"), ((F.col("category") == "out-of-scope") | (F.col("spans") == 0)).alias("should_refuse"), guards_tier(F.col("category")).alias("tier"))


def guards_tier(category):
    return F.when(category.isin("multi-hop", "synthesis", "contradiction"), "reasoning").otherwise("simple")


# -- gold migration and caches --------------------------------------------------------------------


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    """Questions with the ids of their passages, some of which are gone."""
    g = scoring.gold(spark, sf).groupBy("item_id").agg(F.collect_list("doc_id").alias("ids"))
    lost = F.when(F.col("item_id") % 3 == 0, F.array(F.col("item_id") + 10_000_000)).otherwise(F.array().cast("array<bigint>"))
    return table(spark, sf, "benchmark").join(g, "item_id", "left").select("item_id", F.concat(F.coalesce("ids", F.array().cast("array<bigint>")), lost).alias("ids"))


def gold_migration(spark: SparkSession, sf: str) -> DataFrame:
    """Ids become spans, by source and start; ids that aren't found are counted."""
    one = _entries(spark, sf).select("item_id", F.explode_outer("ids").alias("doc_id"))
    spans = table(spark, sf, "documents").select("doc_id", "source", (F.col("doc_id") % 9 * 10).alias("start"), F.lit(True).alias("there"))
    held = one.join(spans, "doc_id", "left")
    listed = F.array_sort(F.collect_list(F.when(F.col("there"), F.struct("source", "start", "doc_id"))))
    g = held.groupBy("item_id").agg(listed.alias("s"), F.count_if(F.col("doc_id").isNotNull() & F.col("there").isNull()).alias("missing"))
    text = F.array_join(F.transform("s", lambda x: F.concat_ws(":", F.coalesce(x["source"], F.lit("")), x["start"].cast("string"), x["doc_id"].cast("string"))), ",")
    return g.select("item_id", F.size("s").cast("long").alias("spans"), "missing", text.alias("gold"))


def migration_totals(spark: SparkSession, sf: str) -> DataFrame:
    return gold_migration(spark, sf).agg(F.count("*").alias("entries"), F.sum("spans").alias("spans"), F.sum("missing").alias("skipped"))


def notes_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks meet the book that they are from, also where both have none, and their cached note."""
    d = table(spark, sf, "documents").select("doc_id", "source", F.nullif("lang", F.lit("es")).alias("book"))
    books = d.groupBy("source", "book").agg(F.count("*").alias("size"))
    notes = table(spark, sf, "labels").select(F.concat_ws(":", F.lit("s"), F.col("doc_id").cast("string")).alias("key"), F.when(F.col("toxic") == 1, "").otherwise(F.concat(F.lit("note "), F.col("quality").cast("string"))).alias("note"))
    b = books.withColumnsRenamed({"source": "s2", "book": "b2"})
    rows = d.join(b, (d["source"] == b["s2"]) & d["book"].eqNullSafe(b["b2"])).withColumn("key", F.concat_ws(":", F.lit("s"), F.col("doc_id").cast("string"))).join(notes, "key", "left")
    return rows.select("doc_id", "key", "size", F.col("note").isNotNull().alias("cached"), F.coalesce("note", F.lit("")).alias("note"))


# -- logs -----------------------------------------------------------------------------------------


def consulted_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """What each run consulted, by kind: first uses in order, read in full or only shown."""
    log = scoring._log(spark, sf).select("run", "seq", "tool", F.floor(F.col("value") / 50).alias("item"), (F.col("value") > 100).alias("read"))
    first = log.groupBy("run", "tool", "item").agg(F.min("seq").alias("seq"), F.max("read").alias("read"))
    line = F.concat(F.col("item").cast("string"), F.when(F.col("read"), "+").otherwise("-"))
    return first.groupBy("run", "tool").agg(F.count("*").alias("n"), F.md5(r.ordered(line, "seq", ",")).alias("items"))


def consulted_union(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks that any of a question's searches gave, each once, by first appearance."""
    one = _vector(spark, sf).select("query_id", "chunk_id", F.col("rank").alias("at"))
    two = _vector(spark, sf, scoped=True, top_k=3).select("query_id", "chunk_id", (F.col("rank") + 100).alias("at"))
    return one.union(two).groupBy("query_id", "chunk_id").agg(F.min("at").alias("first"))


def trace_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Requests, responses, tool calls and errors as one table, told apart by kind."""
    e = table(spark, sf, "events")
    part = lambda kind, name, **more: e.where(F.col("event_type") == name).select(F.lit(kind).alias("kind"), "user_id", *(c.alias(n) for n, c in more.items()))
    k = F.get_json_object("props", "$.k").try_cast("long")
    every = part("request", "click", tokens=k).unionByName(part("response", "view", tokens=k, ms=F.round(F.col("value") * 10).cast("long")), allowMissingColumns=True)
    every = every.unionByName(part("tool", "signup", ms=F.round(F.col("value")).cast("long")), allowMissingColumns=True).unionByName(part("error", "error", message=F.lit("timed out")), allowMissingColumns=True)
    return every.groupBy("kind").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.sum("ms").alias("ms"), F.count("message").alias("messages"))


def retry_log(spark: SparkSession, sf: str) -> DataFrame:
    """Tries of each call, three at most: how many, what it waited, and its note or an empty one."""
    e = table(spark, sf, "events")
    tries = F.when(F.col("event_type") == "error", F.when(F.col("value") > 100, 3).otherwise(2)).otherwise(1)
    log = e.select("event_id", "user_id", F.explode(F.sequence(F.lit(1), tries)).alias("attempt"), ((F.col("event_type") != "error") | (F.col("value") <= 100)).alias("recovers"))
    one = log.groupBy("event_id", "user_id").agg(F.max("attempt").alias("attempts"), F.sum(F.when(F.col("attempt") > 1, F.pow(F.lit(2), F.col("attempt") - 2)).otherwise(0)).cast("long").alias("waited"), F.first("recovers").alias("ok"))
    note = F.when(F.col("ok"), F.concat(F.lit("note "), F.col("event_id").cast("string")))
    return one.select("event_id", F.col("attempts").cast("long").alias("attempts"), "waited", F.coalesce(note, F.lit("")).alias("note"))


# -- JSON and small functions ---------------------------------------------------------------------


def json_props(spark: SparkSession, sf: str) -> DataFrame:
    """Typed fields of a JSON column; a malformed one gives NULL and is counted."""
    cut = F.when(F.col("event_id") % 50 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    p = F.from_json(cut, "k long")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(p["k"]).alias("typed"), F.sum(p["k"]).alias("k"), F.max(p["k"]).alias("most"))


def tagged_knn(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest rows of one tag, with a key of their JSON metadata."""
    e = table(spark, sf, "embeddings").withColumn("meta", F.concat(F.lit('{"cluster": "c'), F.col("label").cast("string"), F.lit('"}')))
    own = e.where("label % 2 = 0")
    near = vector.top_k(retrieval._every(own), own, 5).join(own.select("vec_id", F.get_json_object("meta", "$.cluster").alias("cluster")), "vec_id")
    return near.select("query_id", "rank", "vec_id", "cluster")


def nested_records(spark: SparkSession, sf: str) -> DataFrame:
    """Flat rows as JSON records with a nested source; missing parts are left out."""
    rows = _chunks(spark, sf).join(_sources(spark, sf), "source_id")
    rec = F.struct(F.col("chunk_id"), F.col("context"), F.struct("slug", "year").alias("source"))
    return rows.select("chunk_id", F.to_json(rec).alias("record"))


def usage_functions(spark: SparkSession, sf: str) -> DataFrame:
    v, i = F.col("value"), F.col("event_id")
    tokens = F.floor(v * 100)
    level = F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "off"))), (i % 4 + 1).cast("int"))
    op = F.element_at(F.array(*map(F.lit, ("add", "subtract", "multiply", "divide", "power"))), (i % 5 + 1).cast("int"))
    return table(spark, sf, "events").select(
        "event_id", F.round(cost.embedding_cost(tokens, F.when(i % 2 == 0, "small").otherwise("local")) * 1e9).cast("long").alias("embedding_e9"),
        t.per_second(tokens, F.when(i % 3 == 0, 0).otherwise(500)).alias("rate"), t.stop_reason(F.element_at(F.array(*map(F.lit, (*t.STOPS, "other"))), (i % 8 + 1).cast("int"))).alias("stop"),
        t.most_tokens(level, F.lit(4096)).cast("long").alias("most"), F.round(t.calculated(op, F.col("user_id").cast("double"), (i % 3).cast("double")), 6).alias("result"),
        F.round(v * 1000 / 1024).cast("long").alias("kb"), t.dollars(F.round(v, 2)).alias("dollars"), t.percent(F.when(i % 4 != 0, F.round(v / 1000, 3))).alias("share"),
        F.lower(F.upper("event_type")).isin("click", "view").alias("known"),
    )


def message_functions(spark: SparkSession, sf: str) -> DataFrame:
    x, i = F.col("text"), F.col("conv_id") + F.col("turn")
    blocks = F.array(F.struct(F.lit("text").alias("type"), x.alias("text")), F.struct(F.lit("tool_use").alias("type"), F.lit("hidden").alias("text")), F.struct(F.lit("text").alias("type"), F.col("role").alias("text")))
    listed = F.to_json(F.array(F.struct(F.lit("system").alias("role"), F.lit("s").alias("content")), F.struct(F.col("role"), F.lit("c").alias("content"))))
    m = t.messages(F.when(i % 3 == 0, listed).when(i % 3 == 1, F.concat(F.lit("[ "), x)).otherwise(x))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.md5(t.joined_blocks(blocks)).alias("blocks"), F.size(m).cast("long").alias("messages"), F.element_at(m, -1)["role"].alias("last_role"),
        F.md5(t.indented(x)).alias("indented"), F.coalesce(t.none_if_empty(F.when(i % 2 == 0, "").otherwise(F.col("role"))), F.lit("none")).alias("reasoning"),
        t.base_url(F.concat(F.lit("http://h"), F.when(i % 3 == 0, "/v1/").when(i % 3 == 1, "//").otherwise(""))).alias("url"), F.concat(F.col("role"), F.lit(":"), F.col("turn").cast("string")).alias("key"),
    )


def embedded_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings of all texts, asked for in requests of 32: their number by language, how many have the
    learnt dimension and unit length, and of all languages together the tokens and cost of the requests."""
    rows = providers.embedded(table(spark, sf, "documents").select("lang", "text"), "text", batch=32)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    tokens = F.sum(F.when(F.col("request.first"), F.col("request.tokens")).otherwise(0))
    told = rows.select("lang", "dimension", "request", norm.alias("norm"))
    g = evaluate.with_total(told, "lang", F.count("*").alias("n"), F.count_if(F.abs(F.col("norm") - 1) < 1e-4).alias("unit"), F.count_if(F.col("dimension") != 64).alias("wrong"), tokens.alias("tokens"))
    whole = F.col("lang") == "overall"  # a request holds texts of several languages
    return g.select("lang", "n", "unit", "wrong", F.when(whole, F.col("tokens")).alias("tokens"), F.when(whole, F.round(cost.embedding_cost(F.col("tokens"), F.lit("small")) * 1e9).cast("long")).alias("cost_e9"))


ANSWER = (answers.Field("category", allowed=("user", "assistant")), answers.Field("confidence", "number"), answers.Field("turn", "integer"), answers.Field("notes", required=False))


def structured_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of a declared form, some broken: what is read from each, by which form, and its faults.
    A number without a fraction, as 1.0, is an integer."""
    k = (F.col("conv_id") * 3 + F.col("turn")) % 8
    part = lambda **c: F.to_json(F.struct(*(v.alias(n) for n, v in c.items())))
    role, turn = F.col("role"), F.col("turn")
    sound = part(category=role, confidence=turn / 4, turn=turn, notes=F.lit("n"), more=F.lit(True))
    text = (
        F.when(k == 1, part(confidence=turn / 4, turn=turn)).when(k == 2, part(category=role, confidence=F.lit("high"), turn=turn / 4)).when(k == 3, F.concat(F.lit("Here is my answer: "), "text"))
        .when(k == 4, "  ").when(k == 5, F.substring(sound, 1, 20)).when(k == 6, "[1, 2]").when(k == 7, part(category=role, confidence=turn, turn=turn)).otherwise(sound)
    )
    second = F.when(k == 3, sound).when(k == 5, "{")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", answers.structured(text, ANSWER, second).alias("s"))
    v = F.col("s.value")
    return rows.select("conv_id", "turn", v["category"].alias("category"), v["confidence"].alias("confidence"), v["turn"].alias("said_turn"), v["notes"].alias("notes"), F.array_join("s.faults", ";").alias("faults"), F.col("s.form").alias("form"))


def tool_results(spark: SparkSession, sf: str) -> DataFrame:
    """Calculator calls as a log holds them: every one has a value or an error that the model reads."""
    i = F.col("event_id")
    op = F.element_at(F.array(*map(F.lit, ("add", "subtract", "multiply", "divide", "power"))), (i % 5 + 1).cast("int"))
    sent = F.when(i % 7 == 6, F.lit('{"operation": "add", "a": "one"}')).otherwise(F.to_json(F.struct(op.alias("operation"), F.col("user_id").alias("a"), (i % 3).alias("b"))))
    r = answers.executed(F.when(i % 11 == 10, "divine").otherwise("calculate"), sent)
    return table(spark, sf, "events").select("event_id", r.alias("r")).select("event_id", F.round("r.value", 6).alias("value"), "r.error")


def retrieve_other_column(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval by the second vector column, that of another model; the first is not read."""
    other = lambda c: F.transform(c, lambda x: F.abs(x))
    chunks = _chunks(spark, sf).withColumn("embedding_b", other("embedding"))
    return r.retrieve(_asked(spark, sf).withColumn("vector", other("vector")), chunks, _sources(spark, sf), column="embedding_b").select(*PROJECTION)


def golden_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of some categories that are also on a list of ids, both as comma lists."""
    categories, ids = (x.split(",") for x in ("literal,synthesis,multi-hop", "0,2,3,6,8,9,12,14,15,20,21"))
    rows = table(spark, sf, "benchmark").select("item_id", F.element_at(F.array(*map(F.lit, scoring.CATEGORIES)), (F.col("item_id") % 6 + 1).cast("int")).alias("category"))
    return rows.where(F.col("category").isin(categories) & F.col("item_id").cast("string").isin(ids))


def provider_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as a provider takes them: system texts first, then user and assistant in order, any
    other role as the user's."""
    said = F.struct((F.col("role") != "system").alias("after"), "turn", t.message_role(F.col("role")).alias("role"), "text")
    m = F.transform(F.array_sort(F.collect_list(said)), lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.md5(F.array_join(m, "\n")).alias("digest"), F.count("*").alias("messages"))


# -- stored tables --------------------------------------------------------------------------------


def retrieve_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval over the stored chunks of one version: of the others no file is read."""
    chunks = _chunks(spark, sf)
    path = store.built_once(table(spark, sf, "documents"), "chunks", lambda at: writers.write_chunks(chunks, at))
    own = store.stored_chunks(spark, path, "naive-v1")
    return r.retrieve(_asked(spark, sf), own, _sources(spark, sf)).select(*PROJECTION)


def upsert_stored(spark: SparkSession, sf: str) -> DataFrame:
    """A stored table of balances after two upserts and a rerun of the second, which changes nothing."""
    old = table(spark, sf, "customer").select("c_custkey", F.round("c_acctbal", 2).alias("balance"))
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("balance"))

    def build(at: str) -> None:
        for rows in (old, new, new):
            store.upsert_into(rows, at, ["c_custkey"], 16)

    path = store.built_once(table(spark, sf, "customer").unionByName(table(spark, sf, "orders"), allowMissingColumns=True), "balances", build)
    return store.current(spark, path, "c_custkey long, balance double")


def note_run(spark: SparkSession, sf: str) -> DataFrame:
    """Notes of all documents by a run that found those of every third one made; what it tried is told."""
    docs = table(spark, sf, "documents").select(F.concat(F.lit("s:"), F.col("doc_id").cast("string")).alias("key"), F.coalesce("lang", F.lit("none")).alias("profile"), "text")

    def note(profile: str, text: str) -> str:
        if len(text) % 11 == 0:
            raise ValueError("HTTP 503")
        return f"{profile} {len(text)}"

    def build(at: str) -> None:
        for part in (docs.where("substring(key, 3) % 3 = 0"), docs):
            store.noted(part, at, note, unit=10_000)

    path = store.built_once(table(spark, sf, "documents"), "notes", build)
    return store.there(spark, path, "key string, profile string, note string, tries int, message string").select("key", "note", F.col("tries").cast("long").alias("tries"), "message")


def stored_results(spark: SparkSession, sf: str) -> DataFrame:
    """A run's results, written as one struct a question and read back, with the totals that were seen in writing."""
    s = scoring._golden(spark, sf)
    recall = F.struct(*(F.col(f"r{k}").alias(f"k{k}") for k in evaluate.CUTS))
    rows = s.select(F.col("question").alias("id"), "category", recall.alias("recallAtK"), F.col("rr").alias("mrr"), (F.col("question") % 5).alias("generatorCost"))

    def build(at: str) -> None:
        seen = store.write_run(rows, f"{at}/results", ["generatorCost"])
        spark.createDataFrame([(seen["questions"], seen["generatorCost"])], "questions long, total long").write.json(f"{at}/totals")

    path = store.built_once(table(spark, sf, "benchmark").select("item_id"), "run", build)
    found = spark.read.schema("id long, category string, recallAtK struct<" + ",".join(f"k{k}:double" for k in evaluate.CUTS) + ">, mrr double, generatorCost long").json(f"{path}/results")
    totals = spark.read.schema("questions long, total long").json(f"{path}/totals")  # one row
    return found.join(F.broadcast(totals)).select("id", "category", F.round("recallAtK.k5", 6).alias("r5"), F.round("recallAtK.k20", 6).alias("r20"), F.round("mrr", 6).alias("rr"), "questions", "total")


QUERIES = {f.__name__: f for f in (retrieve_vector, retrieve_scoped, retrieve_hybrid, retrieve_reranked, retrieve_parent, retrieve_multi_query, retrieve_variants, query_variants, chunk_lookup, manifest_lookup, distinct_fetch, user_message, result_list, faithfulness_prompt, judge_prompts, frozen_cases, tag_blocks, source_index, prefix_completion, gold_coverage, run_rollup, error_isolation, rejudge, agent_rollup, top_gold_marks, prompt_ab, ab_merge, call_stats, golden_filters, gold_migration, migration_totals, notes_cache, consulted_by_source, consulted_union, trace_kinds, retry_log, json_props, tagged_knn, nested_records, usage_functions, message_functions, embedded_texts, structured_answers, tool_results, retrieve_stored, upsert_stored, note_run, stored_results, retrieve_other_column, golden_by_ids, provider_messages)}

TRIM = lambda x: f"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"
YEAR = "CASE WHEN year IS NULL THEN 'date unknown' WHEN year < 0 THEN '~' || (-year)::VARCHAR || ' BC' ELSE '~' || year::VARCHAR || ' AD' END"
CITED = "author || ', ' || title || ', ' || chapter"
CHUNKS = f"""{DIM},
ch AS (SELECT doc_id AS chunk_id, source AS slug, CASE WHEN doc_id % 4 = 3 THEN 'contextual-v1' ELSE 'naive-v1' END AS version, doc_id % 7 AS chunk_index, '§' || (doc_id % 7 + 1)::VARCHAR AS chapter, text, CASE WHEN doc_id % 3 = 0 THEN 'note ' || lang END AS context,
  doc_id % 5 * 100 AS char_start, doc_id % 5 * 100 + n_chars AS char_end, embedding::DOUBLE[] AS v FROM documents JOIN embeddings ON vec_id = doc_id),
nv AS (SELECT * FROM ch WHERE version = 'naive-v1'),
qs AS (SELECT chunk_id AS query_id, text AS question, v, slug FROM ch WHERE chunk_id % 20 = 0),
src AS (SELECT source AS slug, author, title, year, translator FROM dim)"""


def near(name: str, k: int, scoped: bool = False) -> str:
    return f"""{name} AS (SELECT query_id, chunk_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id)::BIGINT AS rank FROM
(SELECT query_id, chunk_id, round(list_cosine_similarity(q.v, n.v), 6) AS similarity FROM qs q JOIN nv n ON {'q.slug = n.slug' if scoped else 'true'}) QUALIFY rank <= {k})"""


def lex(name: str, k: int) -> str:
    """BM25 of the version's chunks for the questions."""
    return bm25(name, f"SELECT query_id, unnest(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}]+')) AS term FROM qs", k).replace("FROM documents", "FROM (SELECT chunk_id AS doc_id, text FROM nv)")


FUSED = """f AS (SELECT coalesce(v.query_id, b.query_id) AS query_id, coalesce(v.chunk_id, b.doc_id) AS chunk_id, v.similarity, round(coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS rrf FROM v FULL OUTER JOIN b ON v.query_id = b.query_id AND v.chunk_id = b.doc_id)"""
OVERLAP = lambda q, x: f"round(len(list_intersect(list_distinct(regexp_extract_all(lower({q}), '[\\p{{L}}\\p{{N}}]+')), list_distinct(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'))))::DOUBLE / len(list_distinct(regexp_extract_all(lower({q}), '[\\p{{L}}\\p{{N}}]+'))), 6)"
ROWS = "SELECT n.query_id, n.rank, n.chunk_id, c.slug, author, title, year, chapter, chunk_index, char_start, char_end, similarity FROM n JOIN nv c USING (chunk_id) JOIN src s ON s.slug = c.slug"
SHOWN = f"{CHUNKS}, {near('n', 5)}, sh AS (SELECT n.*, c.slug, c.text, c.chapter, author, title, year FROM n JOIN nv c USING (chunk_id) JOIN src s ON s.slug = c.slug)"
ENTRIES = f"{scoring.GOLD}, one AS (SELECT item_id, doc_id FROM gold UNION ALL SELECT item_id, item_id + 10000000 FROM benchmark WHERE item_id % 3 = 0)"
GRADED = f"""gr AS (SELECT doc_id, category, error, CASE WHEN error IS NULL THEN 1 + 4 * quality - doc_id % 2 END AS faithfulness, CASE WHEN error IS NULL THEN 5 - 2 * toxic - doc_id % 3 END AS completeness,
CASE WHEN error IS NULL THEN (quality = 0) = (toxic = 1) END AS correct, CASE WHEN error IS NULL THEN doc_id % 100 END AS generator, CASE WHEN error IS NULL AND doc_id % 5 <> 0 THEN doc_id % 10 END AS judge, toxic
FROM (SELECT doc_id, quality, toxic, CASE doc_id % 6 {scoring._case} END AS category, CASE WHEN doc_id % 17 = 0 THEN 'HTTP ' || CASE WHEN doc_id % 2 = 0 THEN '503' ELSE '400' END END AS error FROM documents JOIN labels USING (doc_id)) WHERE category <> 'contradiction')"""
_all = "CASE WHEN grouping(category) = 1 THEN 'overall' ELSE category END AS category"
MIGRATED = f"""{ENTRIES}, held AS (SELECT o.item_id, o.doc_id, d.source, o.doc_id % 9 * 10 AS start, d.doc_id IS NOT NULL AS there FROM one o LEFT JOIN documents d USING (doc_id)),
mig AS (SELECT b.item_id, count(h.doc_id) FILTER (there)::BIGINT AS spans, count(h.doc_id) FILTER (NOT there)::BIGINT AS missing, coalesce(string_agg(source || ':' || start::VARCHAR || ':' || h.doc_id::VARCHAR, ',' ORDER BY source, start, h.doc_id) FILTER (there), '') AS gold FROM benchmark b LEFT JOIN held h USING (item_id) GROUP BY 1)"""
_list = lambda items: "([" + ", ".join(f"'{x}'" for x in items) + "])"

SQL = {
    "retrieve_vector": f"WITH {CHUNKS}, {near('n', 5)} {ROWS}",
    "retrieve_scoped": f"WITH {CHUNKS}, {near('n', 3, True)} {ROWS}",
    "retrieve_hybrid": f"WITH {CHUNKS}, {near('v', 100)}, {lex('b', 100)}, {FUSED}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id)::BIGINT AS rank FROM f QUALIFY rank <= 5) SELECT query_id, rank, n.chunk_id, slug, chapter, similarity, rrf FROM n JOIN nv USING (chunk_id)",
    "retrieve_reranked": f"WITH {CHUNKS}, {near('n', 50)}, s AS (SELECT query_id, chunk_id, rank AS first_rank, c.slug, {OVERLAP('q.question', 'CASE WHEN length(context) > 0 THEN context || chr(10) || chr(10) || c.text ELSE c.text END')} AS rerank FROM n JOIN nv c USING (chunk_id) JOIN qs q USING (query_id)) SELECT query_id, chunk_id, first_rank, slug, rerank, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, first_rank)::BIGINT AS rank FROM s QUALIFY rank <= 5",
    "retrieve_parent": f"""WITH {CHUNKS}, {near('n', 5)}, p AS (SELECT query_id, rank, chunk_id, slug, chunk_id % 5 <> 0 AS has, chunk_id % 3 AS part, text, char_start, char_end FROM n JOIN nv USING (chunk_id))
SELECT query_id, rank, chunk_id, slug, md5(CASE WHEN has THEN 'section ' || part::VARCHAR || ' of ' || slug ELSE text END) AS digest, CASE WHEN has THEN part * 1000 ELSE char_start END AS char_start, CASE WHEN has THEN part * 1000 + 999 ELSE char_end END AS char_end
FROM p QUALIFY NOT has OR row_number() OVER (PARTITION BY query_id, has, slug, part ORDER BY rank) = 1""",
    "retrieve_multi_query": f"""WITH {CHUNKS}, {near('v', 50)}, {lex('b', 50)}, u AS (SELECT query_id, chunk_id, rank, 0 AS variant FROM v UNION ALL SELECT query_id, doc_id, rank, 1 FROM b),
f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, min(variant * 1000000 + rank) AS seen FROM u GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, seen, chunk_id)::BIGINT AS first_rank FROM f QUALIFY first_rank <= 50),
s AS (SELECT query_id, chunk_id, rrf, first_rank, {OVERLAP('q.question', 'c.text')} AS rerank FROM p JOIN ch c USING (chunk_id) JOIN qs q USING (query_id))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, first_rank)::BIGINT AS rank FROM s QUALIFY rank <= 5""",
    "retrieve_variants": f"""WITH {CHUNKS}, q2 AS (SELECT c.chunk_id - 1 AS query_id, c.v FROM ch c JOIN qs ON qs.query_id = c.chunk_id - 1), {near('v', 50)}, {near('w', 50).replace('FROM qs q', 'FROM q2 q')},
u AS (SELECT query_id, chunk_id, rank, 0 AS variant FROM v UNION ALL SELECT query_id, chunk_id, rank, 1 FROM w),
f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, min(variant * 1000000 + rank) AS seen FROM u GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, seen, chunk_id)::BIGINT AS first_rank FROM f QUALIFY first_rank <= 50),
s AS (SELECT query_id, chunk_id, rrf, first_rank, {OVERLAP('q.question', 'c.text')} AS rerank FROM p JOIN ch c USING (chunk_id) JOIN qs q USING (query_id))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, first_rank)::BIGINT AS rank FROM s QUALIFY rank <= 5""",
    "query_variants": r"""
WITH w AS (SELECT item_id, text, list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '') AS w FROM benchmark),
v AS (SELECT item_id, list_concat([trim(text)], list_filter([array_to_string(w[2:], ' '), array_to_string(w[:len(w) - 1], ' '), array_to_string(w[2:len(w) - 1], ' ')], lambda x: length(x) > 0)[1:3]) AS v FROM w)
SELECT item_id, (generate_subscripts(v, 1) - 1)::BIGINT AS at, md5(unnest(v)) AS digest FROM v""",
    "chunk_lookup": f"WITH {CHUNKS} SELECT chunk_id, c.slug, {CITED} AS citation, {YEAR} AS written, translator, md5(text) AS digest FROM ch c JOIN src s ON s.slug = c.slug JOIN labels ON doc_id = chunk_id",
    "manifest_lookup": f"WITH {DIM} SELECT source, count(*)::BIGINT AS docs, any_value(title) AS title FROM documents JOIN dim USING (source) GROUP BY 1",
    "distinct_fetch": "SELECT doc_id, 'https://example.org/texts/' || (doc_id % 50)::VARCHAR || '/' || (doc_id % 50)::VARCHAR || '.txt' AS url FROM documents",
    "user_message": f"WITH {SHOWN}, b AS (SELECT query_id, string_agg('[' || rank::VARCHAR || '] ' || author || ', ' || title || ' (' || {YEAR} || '), ' || chapter || chr(10) || {TRIM('text')} || chr(10), chr(10) ORDER BY rank) AS b FROM sh GROUP BY 1) SELECT query_id, md5('Sources:' || chr(10) || chr(10) || b || chr(10) || 'Question: ' || question) AS digest FROM qs JOIN b USING (query_id)",
    "result_list": f"WITH {SHOWN} SELECT query_id, md5('Found ' || count(*)::VARCHAR || ' chunk(s):' || chr(10) || chr(10) || string_agg('[' || chunk_id::VARCHAR || '] ' || {CITED} || chr(10) || '    \"' || substring(trim(regexp_replace(text, '{S}+', ' ', 'g')), 1, 200) || '…\"', chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Call read_chunk(chunk_id) for the full text before citing.') AS digest FROM sh GROUP BY 1",
    "faithfulness_prompt": f"WITH {SHOWN}, p AS (SELECT query_id, string_agg(chr(10) || '[' || rank::VARCHAR || '] ' || {CITED} || chr(10) || {TRIM('text')}, chr(10) ORDER BY rank) AS a, string_agg(chr(10) || '[' || chunk_id::VARCHAR || '] ' || {CITED} || chr(10) || {TRIM('text')}, chr(10) ORDER BY rank) AS b FROM sh GROUP BY 1), q AS (SELECT query_id, question AS q FROM qs) SELECT query_id, "
    + ", ".join(f"md5('Question:' || chr(10) || q || chr(10) || chr(10) || 'Source passages:' || chr(10) || {c} || chr(10) || chr(10) || 'Candidate answer:' || chr(10) || q) AS {n}" for c, n in (("a", "by_rank"), ("b", "by_id")))
    + " FROM p JOIN q USING (query_id)",
    "judge_prompts": "SELECT doc_id, md5(concat_ws(chr(10), 'Question:', source, '', 'Ideal answer:', lang, '', 'Candidate answer:', text)) AS completeness, md5('Candidate answer:' || chr(10) || text) AS refusal FROM documents",
    "frozen_cases": f"WITH {SHOWN}, g AS (SELECT query_id, CASE query_id // 20 % 6 {scoring._case} END AS category, md5(string_agg('[' || rank::VARCHAR || '] ' || {CITED} || chr(10) || {TRIM('text')}, chr(10) || chr(10) ORDER BY rank)) AS sources, count(quality)::BIGINT AS hits FROM sh LEFT JOIN labels ON doc_id = chunk_id AND quality = 1 GROUP BY 1) SELECT *, hits = 0 OR category = 'out-of-scope' AS should_refuse FROM g",
    "tag_blocks": "SELECT doc_id, md5(" + " || chr(10) || chr(10) || ".join(f"'<{n}>' || replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</{n}>'" for n, c in (("context", "text"), ("question", "source"), ("n", "n_chars::VARCHAR"))) + ") AS digest FROM documents",
    "source_index": f"WITH {DIM}, n AS (SELECT source, count(*) AS n, count(DISTINCT lang) AS parts FROM documents GROUP BY 1) SELECT source, '- **' || title || '** by ' || author || ' (' || {YEAR} || '): ' || n::VARCHAR || ' chunks in ' || parts::VARCHAR AS line, row_number() OVER (ORDER BY year ASC NULLS LAST, source)::BIGINT AS place FROM dim JOIN n USING (source)",
    "prefix_completion": "WITH s AS (SELECT DISTINCT source, substring(source, 1, 2) AS prefix FROM documents WHERE source IS NOT NULL) SELECT prefix, string_agg(source, ',' ORDER BY source) AS sources FROM s GROUP BY 1",
    "gold_coverage": f"""WITH {scoring.GOLD}, {', '.join(bm25(f'v{i}', retrieval.whole(*ends), 5) for i, ends in enumerate(SEARCHES))},
u AS ({' UNION '.join(f'SELECT query_id, doc_id FROM v{i}' for i in range(len(SEARCHES)))}),
n AS (SELECT item_id, count(*)::BIGINT AS spans FROM gold GROUP BY 1),
h AS (SELECT g.item_id, count(*) AS hits FROM gold g JOIN u ON u.query_id = g.item_id AND u.doc_id = g.doc_id GROUP BY 1)
SELECT m.item_id AS question, CASE m.item_id % 6 {scoring._case} END AS category, coalesce(spans, 0)::BIGINT AS spans, CASE WHEN spans > 0 THEN round(coalesce(hits, 0) / spans::DOUBLE, 6) END AS coverage FROM benchmark m LEFT JOIN n USING (item_id) LEFT JOIN h USING (item_id)""",
    "run_rollup": f"WITH {GRADED} SELECT {_all}, count(*)::BIGINT AS n, count(faithfulness)::BIGINT AS answered, round(avg(faithfulness), 6) AS faithfulness, round(avg(completeness), 6) AS completeness, round(avg(correct::INT), 6) AS refusals_right, sum(coalesce(generator, 0))::BIGINT AS generator_cost, sum(coalesce(judge, 0))::BIGINT AS judge_cost FROM gr GROUP BY ROLLUP (category)",
    "error_isolation": f"WITH {GRADED} SELECT error, count(*)::BIGINT AS n, error LIKE '%503%' AS again, false AS other_form FROM gr WHERE error IS NOT NULL GROUP BY 1",
    "rejudge": f"WITH {GRADED}, g AS (SELECT {_all}, count(*)::BIGINT AS n, avg(completeness) AS a, avg(5 - 3 * toxic) AS b, count(*) FILTER (5 - 3 * toxic > completeness)::BIGINT AS up, count(*) FILTER (5 - 3 * toxic < completeness)::BIGINT AS down FROM gr WHERE error IS NULL GROUP BY ROLLUP (category)) SELECT category, n, round(a, 6) AS old, round(b, 6) AS new, round(b - a, 6) AS delta, CASE WHEN round(b - a, 6) >= 0 THEN '+' ELSE '-' END || printf('%.2f', abs(round(round(b - a, 6), 2))) AS shown, up, down FROM g",
    "agent_rollup": f"""WITH r AS (SELECT user_id, CASE user_id % 6 {scoring._case} END AS category, count(*) AS calls, max((event_type = 'purchase')::INT) AS done, count(DISTINCT event_type) AS consulted, sum(round(value * 100)::BIGINT) AS cost, count(*) FILTER (value > 200) AS hit, count(*) FILTER (value > 150) AS spans FROM events GROUP BY 1)
SELECT {_all}, count(*)::BIGINT AS runs, round(avg(calls), 6) AS calls, round(avg(done), 6) AS finalized, round(avg(consulted), 6) AS consulted, round(avg(CASE WHEN user_id % 5 <> 0 AND spans > 0 THEN hit / spans::DOUBLE END), 6) AS coverage, sum(cost)::BIGINT AS cost FROM r GROUP BY ROLLUP (category)""",
    "top_gold_marks": f"WITH {scoring.GOLD}, {bm25('b', retrieval.whole(), 3)} SELECT query_id, rank, b.doc_id, g.doc_id IS NOT NULL AS gold FROM b LEFT JOIN gold g ON g.item_id = b.query_id AND g.doc_id = b.doc_id",
    "prompt_ab": "SELECT conv_id, turn, md5(text) AS short, md5('Read this:' || chr(10) || text || chr(10) || 'Then answer.') AS \"long\" FROM conversations WHERE role = 'user'",
    "ab_merge": "WITH a AS (SELECT conv_id, turn // 2 AS \"case\", length(text)::BIGINT AS user FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, turn // 2 AS \"case\", length(text)::BIGINT AS assistant FROM conversations WHERE role = 'assistant') SELECT * FROM a FULL OUTER JOIN b USING (conv_id, \"case\")",
    "call_stats": "SELECT event_type, count(*)::BIGINT AS calls, sum(round(value * 10)::BIGINT)::BIGINT AS total_ms, round(avg(round(value * 10)), 6) AS mean_ms FROM events GROUP BY 1",
    "golden_filters": f"WITH {scoring.GOLDEN} SELECT question, category, spans > 0 AS in_scope, category = 'out-of-scope' OR spans = 0 AS should_refuse, CASE WHEN category = 'synthesis' THEN 'reasoning' ELSE 'simple' END AS tier FROM items WHERE category IN ('literal', 'out-of-scope', 'synthesis')",
    "gold_migration": f"WITH {MIGRATED} SELECT * FROM mig",
    "migration_totals": f"WITH {MIGRATED} SELECT count(*)::BIGINT AS entries, sum(spans)::BIGINT AS spans, sum(missing)::BIGINT AS skipped FROM mig",
    "notes_cache": "WITH b AS (SELECT source, CASE WHEN lang <> 'es' THEN lang END AS book, count(*)::BIGINT AS size FROM documents GROUP BY 1, 2) SELECT d.doc_id, 's:' || d.doc_id::VARCHAR AS key, size, l.doc_id IS NOT NULL AS cached, coalesce(CASE WHEN toxic = 1 THEN '' ELSE 'note ' || quality::VARCHAR END, '') AS note FROM documents d JOIN b ON b.source = d.source AND b.book IS NOT DISTINCT FROM CASE WHEN lang <> 'es' THEN lang END LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "consulted_by_source": f"WITH {scoring.LOG}, f AS (SELECT run, tool, floor(value / 50)::BIGINT AS item, min(seq) AS seq, bool_or(value > 100) AS read FROM log GROUP BY 1, 2, 3) SELECT run, tool, count(*)::BIGINT AS n, md5(string_agg(item::VARCHAR || CASE WHEN read THEN '+' ELSE '-' END, ',' ORDER BY seq)) AS items FROM f GROUP BY 1, 2",
    "consulted_union": f"WITH {CHUNKS}, {near('a', 5)}, {near('b', 3, True)} SELECT query_id, chunk_id, min(pos) AS first FROM (SELECT query_id, chunk_id, rank AS pos FROM a UNION ALL SELECT query_id, chunk_id, rank + 100 FROM b) GROUP BY 1, 2",
    "trace_kinds": "WITH e AS (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE event_type IN ('click', 'view', 'signup', 'error')) SELECT CASE event_type WHEN 'click' THEN 'request' WHEN 'view' THEN 'response' WHEN 'signup' THEN 'tool' ELSE 'error' END AS kind, count(*)::BIGINT AS n, sum(CASE WHEN event_type IN ('click', 'view') THEN k END)::BIGINT AS tokens, sum(CASE event_type WHEN 'view' THEN round(value * 10) WHEN 'signup' THEN round(value) END)::BIGINT AS ms, count(CASE WHEN event_type = 'error' THEN 1 END)::BIGINT AS messages FROM e GROUP BY 1, event_type",
    "retry_log": "SELECT event_id, CASE WHEN event_type <> 'error' THEN 1 WHEN value > 100 THEN 3 ELSE 2 END::BIGINT AS attempts, CASE WHEN event_type <> 'error' THEN 0 WHEN value > 100 THEN 3 ELSE 1 END::BIGINT AS waited, CASE WHEN event_type = 'error' AND value > 100 THEN '' ELSE 'note ' || event_id::VARCHAR END AS note FROM events",
    "json_props": "WITH p AS (SELECT event_type, CASE WHEN event_id % 50 <> 0 THEN json_extract(props, '$.k')::BIGINT END AS k FROM events) SELECT event_type, count(*)::BIGINT AS n, count(k)::BIGINT AS typed, sum(k)::BIGINT AS k, max(k) AS most FROM p GROUP BY 1",
    "tagged_knn": f"WITH {retrieval.knn(5, probes=retrieval.EVERY).replace('FROM embeddings WHERE', 'FROM embeddings WHERE label % 2 = 0 AND').replace('e.vec_id <> p.query_id', 'e.vec_id <> p.query_id AND e.label % 2 = 0')} SELECT query_id, rank, n.vec_id, 'c' || e.label::VARCHAR AS cluster FROM near n JOIN embeddings e USING (vec_id)",
    "nested_records": f"""WITH {CHUNKS} SELECT chunk_id, '{{"chunk_id":' || chunk_id::VARCHAR || coalesce(',"context":"' || context || '"', '') || ',"source":{{"slug":"' || c.slug || '"' || coalesce(',"year":' || year::VARCHAR, '') || '}}}}' AS record FROM ch c JOIN src s ON s.slug = c.slug""",
    "usage_functions": f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN round(floor(value * 100) * 0.02 / 1e6 * 1e9)::BIGINT ELSE 0 END AS embedding_e9, CASE WHEN event_id % 3 = 0 THEN '?' ELSE printf('%.1f', floor(value * 100) * 1000.0::DOUBLE / 500) END AS rate,
{_list(["end_turn", "max_tokens", "tool_use", "stop_sequence", "end_turn", "max_tokens", "tool_use", "unknown"])}[event_id % 8 + 1] AS stop, ([4096, 5120, 17408, 4096])[event_id % 4 + 1]::BIGINT AS most,
round(CASE event_id % 5 WHEN 0 THEN user_id + event_id % 3 WHEN 1 THEN user_id - event_id % 3 WHEN 2 THEN user_id * (event_id % 3) WHEN 3 THEN user_id::DOUBLE / nullif(event_id % 3, 0) END::DOUBLE, 6) AS result,
round(value * 1000 / 1024)::BIGINT AS kb, '$' || printf('%.6f', round(value, 2)) AS dollars, CASE WHEN event_id % 4 = 0 THEN '-' ELSE printf('%.1f%%', round(value / 1000, 3) * 100) END AS share, event_type IN ('click', 'view') AS known FROM events""",
    "embedded_texts": f"""SELECT {_all.replace('category', 'lang')}, count(*)::BIGINT AS n, count(*) FILTER (w > 0)::BIGINT AS unit, 0::BIGINT AS wrong, CASE WHEN grouping(lang) = 1 THEN sum(w)::BIGINT END AS tokens, CASE WHEN grouping(lang) = 1 THEN round(sum(w) * 0.02 / 1e6 * 1e9)::BIGINT END AS cost_e9
FROM (SELECT lang, len(regexp_extract_all(text, '[^\\t-\\r\\x{{1C}}-\\x{{20}}\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+')) AS w FROM documents) GROUP BY ROLLUP (lang)""",
    "structured_answers": """WITH a AS (SELECT conv_id, turn, role, (conv_id * 3 + turn) % 8 AS k, CASE WHEN role IN ('user', 'assistant') THEN role END AS ok, CASE WHEN role NOT IN ('user', 'assistant') THEN 'not-allowed:category' END AS bad FROM conversations)
SELECT conv_id, turn, CASE WHEN k IN (0, 2, 3, 7) THEN ok END AS category, CASE WHEN k IN (0, 1, 3) THEN turn / 4.0::DOUBLE WHEN k = 7 THEN turn::DOUBLE END AS confidence, CASE WHEN k IN (0, 1, 3, 7) THEN turn WHEN k = 2 AND turn % 4 = 0 THEN turn // 4 END AS said_turn, CASE WHEN k IN (0, 3) THEN 'n' END AS notes,
CASE k WHEN 1 THEN 'missing:category' WHEN 2 THEN concat_ws(';', bad, 'wrong-type:confidence', CASE WHEN turn % 4 <> 0 THEN 'wrong-type:turn' END) WHEN 4 THEN 'empty content' WHEN 5 THEN 'json-parse' WHEN 6 THEN 'not-an-object' ELSE coalesce(bad, '') END AS faults, CASE k WHEN 3 THEN 2 WHEN 4 THEN 0 WHEN 5 THEN 0 ELSE 1 END::BIGINT AS form FROM a""",
    "retrieve_other_column": f"WITH {CHUNKS.replace('embedding::DOUBLE[] AS v', 'list_transform(embedding::DOUBLE[], lambda x: abs(x)) AS v')}, {near('n', 5)} {ROWS}",
    "golden_by_ids": f"SELECT item_id, category FROM (SELECT item_id, CASE item_id % 6 {scoring._case} END AS category FROM benchmark) WHERE category IN ('literal', 'synthesis', 'multi-hop') AND item_id IN (0, 2, 3, 6, 8, 9, 12, 14, 15, 20, 21)",
    "provider_messages": "SELECT conv_id, md5(string_agg(CASE WHEN role IN ('system', 'assistant') THEN role ELSE 'user' END || ':' || text, chr(10) ORDER BY role <> 'system', turn)) AS digest, count(*)::BIGINT AS messages FROM conversations GROUP BY 1",
    "retrieve_stored": f"WITH {CHUNKS}, {near('n', 5)} {ROWS}",
    "upsert_stored": """
WITH n AS (SELECT o_custkey AS c_custkey, round(sum(o_totalprice), 2) AS balance FROM orders GROUP BY 1)
SELECT c_custkey, round(c_acctbal, 2) AS balance FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n""",
    "note_run": "SELECT 's:' || doc_id::VARCHAR AS key, CASE WHEN length(text) % 11 = 0 THEN '' ELSE coalesce(lang, 'none') || ' ' || length(text)::VARCHAR END AS note, CASE WHEN length(text) % 11 = 0 THEN 3 ELSE 1 END::BIGINT AS tries, CASE WHEN length(text) % 11 = 0 THEN 'HTTP 503' END AS message FROM documents",
    "stored_results": f"""WITH {scoring.GOLDEN} SELECT i.question AS id, i.category, (SELECT round(recall, 6) FROM rec WHERE rec.question = i.question AND k = 5) AS r5, (SELECT round(recall, 6) FROM rec WHERE rec.question = i.question AND k = 20) AS r20, round(rr, 6) AS rr, (SELECT count(*) FROM benchmark)::BIGINT AS questions, (SELECT sum(item_id % 5) FROM benchmark)::BIGINT AS total FROM items i JOIN rrs USING (question)""",
    "tool_results": """WITH e AS (SELECT event_id, user_id::DOUBLE AS a, (event_id % 3)::DOUBLE AS b, event_id % 5 AS op, CASE WHEN event_id % 11 = 10 THEN 'Model called unknown tool "divine". Available: calculate' WHEN event_id % 7 = 6 THEN 'ERROR: Invalid input for tool "calculate". wrong-type:a, missing:b'
 WHEN event_id % 5 = 4 THEN 'ERROR: Invalid input for tool "calculate". not-allowed:operation' WHEN event_id % 5 = 3 AND event_id % 3 = 0 THEN 'ERROR executing tool "calculate": Division by zero' END AS error FROM events)
SELECT event_id, CASE WHEN error IS NULL THEN round(CASE op WHEN 0 THEN a + b WHEN 1 THEN a - b WHEN 2 THEN a * b ELSE a / b END, 6) END AS value, error FROM e""",
    "message_functions": """SELECT conv_id, turn, md5(text || role) AS blocks, CASE WHEN (conv_id + turn) % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS messages, CASE WHEN (conv_id + turn) % 3 = 0 THEN role ELSE 'user' END AS last_role, md5('    ' || replace(text, chr(10), chr(10) || '    ')) AS indented,
CASE WHEN (conv_id + turn) % 2 = 0 THEN 'none' ELSE role END AS reasoning, 'http://h/v1' AS url, role || ':' || turn::VARCHAR AS key FROM conversations""",
}
