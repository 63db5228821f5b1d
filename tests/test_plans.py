"""Every named plan against its SQL on the same tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from passagework import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(rows):
    def one(v):
        return "NaN" if isinstance(v, float) and math.isnan(v) else repr(round(v, 9)) if isinstance(v, float) else repr(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_plan_equals_sql(spark, sql, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = shown(tuple(r) for r in df.select(columns).collect())
    result = sql.execute(plans.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = shown(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())
    assert got == want


def test_answers_are_whole_texts(spark, tmp_path):
    long = "plain words and more of them " * 4
    rows = [(4, long + "[17] end"), (9, long + "there is no evidence here"), (14, long)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in plans.QUERIES["citation_ids_whole"](spark, str(tmp_path)).collect()] == [(4, 0, 17)]
    found = {r["doc_id"]: (r["ok"], r["abstained"], r["issues"]) for r in plans.QUERIES["output_guard_whole"](spark, str(tmp_path)).collect()}
    assert found == {4: (False, False, "cites-unconsulted-chunks:17"), 9: (True, True, ""), 14: (False, False, "answered-without-citation")}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
