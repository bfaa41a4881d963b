"""Every registered query with SQL against DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from plenum import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, (int, float)):
        return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v):.5f}"
    return repr(v)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = plans.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rel = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == theirs


def test_queries_without_sql_are_those_tested_elsewhere(spark):
    """Of the listing the files are known."""
    assert set(plans.queries()) - set(plans.oracle_sql()) == {"s11_listing"}
    listed = plans.queries()["s11_listing"](spark, DATA).collect()
    assert [(r.key.rsplit("/", 1)[1], r["size"]) for r in listed] == [("events.parquet", os.path.getsize(f"{DATA}/events.parquet"))]


@pytest.mark.parametrize("name", ["t12_strip_html", "k6_final_score", "c1_by_tokens", "c8_windows", "p1_speeches", "j8_overlap_match", "v3_filtered_top_k"])
def test_native_plans_hold_no_python(spark, name):
    plan = plans.queries()[name](spark, DATA)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow"))
