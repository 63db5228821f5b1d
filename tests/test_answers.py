"""Structured answers, errors as values and batched providers, as literals."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from passagework import plans
from passagework.functions.answers import Field, executed, structured
from passagework.operators import providers

FORM = (Field("label", allowed=("yes", "no")), Field("score", "number"), Field("n", "integer", required=False), Field("ok", "boolean", required=False), Field("tags", "array<string>", required=False))


@pytest.mark.parametrize(
    ("text", "second", "value", "faults", "form"),
    [
        ('{"label": "yes", "score": 0.5, "n": 3, "ok": true, "tags": ["a", "b"], "other": 1}', None, ("yes", 0.5, 3, True, ["a", "b"]), [], 1),
        ('{"label": "maybe", "score": 1}', None, (None, 1.0, None, None, None), ["not-allowed:label"], 1),
        ('{"label": "no", "score": "1"}', '{"label": "no", "score": 1}', ("no", None, None, None, None), ["wrong-type:score"], 1),  # a broken form is not asked again
        ('{"score": null, "n": 1.5, "ok": "true", "tags": "a"}', None, (None, None, None, None, None), ["missing:label", "missing:score", "wrong-type:n", "wrong-type:ok", "wrong-type:tags"], 1),
        ("Sure! {", '{"label": "no", "score": -2e3}', ("no", -2000.0, None, None, None), [], 2),
        (" ", '{"label": "no"}', ("no", None, None, None, None), ["missing:score"], 2),
        ("not json", "{", (None,) * 5, ["json-parse"], 0),
        (None, None, (None,) * 5, ["empty content"], 0),
        ("[]", None, (None,) * 5, ["not-an-object"], 1),
        ("7", None, (None,) * 5, ["not-an-object"], 1),
    ],
)
def test_structured(spark, text, second, value, faults, form):
    rows = spark.createDataFrame([(text, second)], "text string, second string")
    s = rows.select(structured(F.col("text"), FORM, F.col("second")).alias("s")).collect()[0]["s"]
    assert (tuple(s["value"]), s["faults"], s["form"]) == (value, faults, form)


@pytest.mark.parametrize(
    ("tool", "sent", "value", "error"),
    [
        ("calculate", '{"operation": "divide", "a": 1, "b": 4}', 0.25, None),
        ("calculate", '{"operation": "divide", "a": 1, "b": 0}', None, 'ERROR executing tool "calculate": Division by zero'),
        ("calculate", '{"operation": "power", "a": 1, "b": 0}', None, 'ERROR: Invalid input for tool "calculate". not-allowed:operation'),
        ("calculate", '{"a": "x"}', None, 'ERROR: Invalid input for tool "calculate". missing:operation, wrong-type:a, missing:b'),
        ("calculate", "{", None, 'ERROR: Invalid input for tool "calculate". json-parse'),
        ("search", '{"operation": "add", "a": 1, "b": 0}', None, 'Model called unknown tool "search". Available: calculate'),
        (None, None, None, 'Model called unknown tool "". Available: calculate'),
    ],
)
def test_errors_are_values(spark, tool, sent, value, error):
    r = spark.createDataFrame([(tool, sent)], "tool string, sent string").select(executed(F.col("tool"), F.col("sent")).alias("r")).collect()[0]["r"]
    assert (r["value"], r["error"]) == (value, error)


@pytest.mark.parametrize("batch", [1, 32, 100])
def test_requests_keep_rows_in_order(spark, batch):
    rows = spark.range(0, 250, 1, 3).select(F.col("id"), F.when(F.col("id") % 50 == 7, None).otherwise(F.concat_ws(" ", F.lit("word"), F.col("id").cast("string"))).alias("text"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "19")  # requests go across Arrow batches
    try:
        got = providers.embedded(rows, "text", batch=batch).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    (want, _), = [providers.hashed_embedding()([f"word {i}" if i % 50 != 7 else "" for i in range(250)])]
    want = [v for _, v in sorted(want)]
    assert sorted(r["id"] for r in got) == list(range(250))
    assert all(r["embedding"] == pytest.approx(want[r["id"]]) and r["dimension"] == 64 for r in got)
    sizes = [r["request"]["size"] for r in got if r["request"]["first"]]
    assert sum(sizes) == 250 and max(sizes) == min(batch, 84) and sum(s < batch for s in sizes) <= 3  # three tasks of 83 or 84 rows
    assert sum(r["request"]["tokens"] for r in got if r["request"]["first"]) == 2 * 245


def test_a_provider_that_loses_an_answer_stops_the_task(spark):
    with pytest.raises(Exception, match="2 texts were sent, 1 vectors came back"):
        providers.embedded(spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1), "text", lambda texts: ([(0, [1.0])], 1)).collect()


def test_a_text_whose_counts_cancel_has_a_vector_of_unit_length():
    """'w0' and 'w133' fall on one dimension with opposite signs."""
    (found, _) = providers.hashed_embedding()(["w0 w133", "w0", "  \x1c"])
    v = {i: np.array(x) for i, x in found}
    assert abs(np.linalg.norm(v[0]) - 1) < 1e-6 and (v[0] == v[1]).all() and not v[2].any()


def test_embedded_texts_equal_their_sql_on_any_white_space(spark, tmp_path):
    blanks = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
    rows = [(i, f"a{x}b", "en") for i, x in enumerate(blanks + "\u200b\ufeff\x01")] + [(90, blanks, "en"), (91, "w0 w133", None), (92, None, "de"), (93, "", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = ["lang", "n", "unit", "wrong", "tokens", "cost_e9"]
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({plans.SQL['embedded_texts']})").fetchall()
    got = [tuple(r) for r in plans.QUERIES["embedded_texts"](spark, str(tmp_path)).select(columns).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
