import datetime
import decimal

import duckdb
import pytest

from ferrule.plans import decision_support, decision_support_sql, exercises

TABLES = "region nation customer supplier part orders lineitem events".split()
D = "/root/testdata/sf0.01"
QUERIES = {**decision_support.QUERIES, **exercises.QUERIES}
ORACLES = {**decision_support_sql.ORACLES, **exercises.ORACLES}


def norm(v):
    if isinstance(v, decimal.Decimal | datetime.date):
        return str(v)
    return repr(round(v, 5)) if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, D)
    r = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(r.columns)
    got = rows(df.columns, [tuple(x) for x in df.collect()])
    assert got and got == rows(r.columns, r.fetchall())


@pytest.mark.parametrize("settings", [("1", "true", "-1"), ("3", "false", "-1"), ("8", "true", "10485760")])
@pytest.mark.parametrize("name", ["tpch_q5", "tpch_q16", "tpch_q21", "cte_join_agg"])
def test_same_for_any_plan(spark, duck, name, settings):
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    old = [spark.conf.get(k) for k in keys]
    try:
        for k, v in zip(keys, settings, strict=True):
            spark.conf.set(k, v)
        df = QUERIES[name](spark, D)
        r = duck.sql(ORACLES[name])
        assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows(r.columns, r.fetchall())
    finally:
        for k, v in zip(keys, old, strict=True):
            spark.conf.set(k, v)


def test_filters_and_columns_reach_the_scan(spark):
    from ferrule.operators.exchange import node_names, plan_text

    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # else the list is cut
    scans = lambda df, table: [x for x in plan_text(df).splitlines() if "FileScan" in x and f"{table}.parquet" in x]
    (q6,) = scans(decision_support.q6(spark, D), "lineitem")
    assert "o_orderkey" not in q6 and "l_returnflag" not in q6
    for q in (q6, scans(decision_support.q12(spark, D), "lineitem")[0], scans(decision_support.q14(spark, D), "lineitem")[0]):
        pushed = q[q.index("PushedFilters: [") :]
        assert "GreaterThanOrEqual(l_shipdate" in pushed and "LessThan(l_shipdate" in pushed
    assert "SortMergeJoin" not in node_names(decision_support.q19(spark, D))
    assert len(scans(decision_support.q20(spark, D), "lineitem")) == 1 and len(scans(decision_support.q2(spark, D), "lineitem")) == 1
