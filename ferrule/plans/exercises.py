"""Queries beside the decision-support set: sorted aggregate, CTE with a join, exchanges, custom source, statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions import asc, day, desc, money
from ferrule.operators.exchange import chain, shuffle
from ferrule.operators.joins import broadcast_if_small, join_with, not_in
from ferrule.sources.catalog import Catalog
from ferrule.sources.custom import int64_list


def agg_by_key_sorted(spark: SparkSession, d: str) -> DataFrame:
    return Catalog(spark, d).orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")).orderBy(asc("n"))


def cte_join_agg(spark: SparkSession, d: str) -> DataFrame:
    """Groups on a pair of a string and a double that a CTE has computed."""
    return spark.sql("""
        WITH typical AS (SELECT event_type, ROUND(AVG(value), 6) AS mean_value FROM {e} WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY event_type)
        SELECT e.event_type, t.mean_value, COUNT(*) AS n, COUNT(DISTINCT e.user_id) AS users
        FROM {e} AS e JOIN typical AS t ON e.event_type = t.event_type WHERE e.value IS NOT NULL
        GROUP BY e.event_type, t.mean_value ORDER BY e.event_type NULLS LAST
    """, e=Catalog(spark, d).events)


def chained_exchange(spark: SparkSession, d: str) -> DataFrame:
    li = Catalog(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", day("l_shipdate").alias("ship"))
    return chain(li, 1, 10, 5).groupBy("l_linenumber").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("s"))


def hash_exchange(spark: SparkSession, d: str) -> DataFrame:
    """Partitions that each key occupies: always one."""
    li = shuffle(Catalog(spark, d).lineitem.select("l_orderkey"), 10, "l_orderkey")
    return li.select("l_orderkey", F.spark_partition_id().alias("p")).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct("p").alias("places"))


def rr_exchange(spark: SparkSession, d: str) -> DataFrame:
    """Rows dealt evenly: only their number and sum are fixed."""
    li = shuffle(Catalog(spark, d).lineitem.select("l_orderkey"), 10)
    return li.agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("s"))


def custom_source_sort(spark: SparkSession, d: str) -> DataFrame:
    found = int64_list(spark, [1, 2, 3, 4, 5, 6]).where("numbers > 1")
    return shuffle(found, 10, "numbers").orderBy(F.col("numbers").desc_nulls_last())


def null_aware_anti(spark: SparkSession, d: str) -> DataFrame:
    t = Catalog(spark, d)
    bad = t.supplier.where("s_acctbal < 0").select("s_nationkey")
    return not_in(t.nation.select("n_nationkey", "n_name"), "n_nationkey", bad, "s_nationkey")


def _strategy(name: str | None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = Catalog(spark, d)
        return join_with(t.orders, t.customer, F.col("o_custkey") == F.col("c_custkey"), "inner", name).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum(money("o_totalprice")).cast("decimal(38,2)").alias("total"))

    return run


def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    o = Catalog(spark, d).orders
    return o.select(
        "o_orderkey", F.year("o_orderdate").cast("bigint").alias("y"), F.substring("o_orderpriority", 1, 1).alias("p"), F.add_months(day("o_orderdate"), 3).alias("due"),
        F.when(F.col("o_orderpriority").like("%HIGH"), "h").when(F.col("o_orderpriority").like("1-%"), "u").otherwise("o").alias("c"),
    )


def top_orders(spark: SparkSession, d: str) -> DataFrame:
    """Top-k: the limit is the feature; ties end at the key."""
    return Catalog(spark, d).orders.select("o_orderkey", money("o_totalprice").alias("total")).orderBy(desc("total"), asc("o_orderkey")).limit(20)


def sort_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Default order: ascending has nulls last."""
    e = Catalog(spark, d).events.select(F.when(F.col("event_type") == "click", F.lit(None)).otherwise(F.col("event_type")).alias("k"))
    return e.groupBy("k").agg(F.count("*").alias("n")).orderBy(asc("k"))


def full_outer(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a partner on either side: some customers have no order, and order keys above them no customer."""
    t = Catalog(spark, d)
    spent = t.orders.groupBy((F.col("o_custkey") * 2).alias("k")).agg(F.count("*").alias("n"))
    return t.customer.select("c_custkey").join(spent, F.col("c_custkey") == F.col("k"), "full")


def right_join(spark: SparkSession, d: str) -> DataFrame:
    t = Catalog(spark, d)
    rich = t.supplier.where("s_acctbal > 9000")
    return rich.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "right").groupBy("n_name").agg(F.count("s_suppkey").alias("n"), F.max("s_name").alias("last"))


def cross_join(spark: SparkSession, d: str) -> DataFrame:
    """The product of two tables of a few rows."""
    t = Catalog(spark, d)
    return t.region.select("r_name").crossJoin(t.nation.select("n_name"))


def theta_join(spark: SparkSession, d: str) -> DataFrame:
    """No equality: one side is a handful of rows and goes to all tasks."""
    t = Catalog(spark, d)
    bands = t.nation.select((F.col("n_nationkey") * 400).cast("double").alias("low"), ((F.col("n_nationkey") + 1) * 400).cast("double").alias("high"))
    return t.supplier.join(broadcast_if_small(bands), (F.col("s_acctbal") >= F.col("low")) & (F.col("s_acctbal") < F.col("high"))).groupBy("low").agg(F.count("*").alias("n"))


def windows(spark: SparkSession, d: str) -> DataFrame:
    """Ranks, offsets and running frames, null order spelt out."""
    e = Catalog(spark, d).events.withColumn("v", F.round("value", 4))
    by = Window.partitionBy("event_type").orderBy(F.col("v").asc_nulls_last(), "event_id")
    running = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return e.select(
        "event_id", F.row_number().over(by).alias("place"), F.rank().over(Window.partitionBy("event_type").orderBy(F.col("v").asc_nulls_last())).alias("rank"),
        F.lag("event_id").over(by).alias("before"), F.lead("event_id", 2).over(by).alias("after"),
        F.count("v").over(running).alias("so_far"), F.max("user_id").over(by.rowsBetween(-2, 2)).alias("near"), F.ntile(4).over(by).alias("quarter"),
    )


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """UNION, UNION ALL, INTERSECT, EXCEPT and their ALL forms, nulls equal to each other."""
    t = Catalog(spark, d)
    a = t.orders.select(F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey") % 50).alias("k"))
    b = t.customer.select(F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 70).alias("k"))
    kinds = {"union": a.union(b).distinct(), "union_all": a.unionAll(b), "intersect": a.intersect(b), "except": a.subtract(b), "intersect_all": a.intersectAll(b), "except_all": b.exceptAll(a)}
    out = None
    for name, df in kinds.items():
        one = df.groupBy("k").agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "k", "n")
        out = one if out is None else out.unionAll(one)
    return out


def distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    return Catalog(spark, d).lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


def grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """ROLLUP, CUBE and GROUPING SETS in one, told apart by their grouping ids."""
    li = Catalog(spark, d).lineitem
    parts = []
    for name, how in (("rollup", "ROLLUP (l_returnflag, l_linestatus)"), ("cube", "CUBE (l_returnflag, l_linestatus)"), ("sets", "GROUPING SETS ((l_returnflag), (l_linestatus), ())")):
        parts.append(f"SELECT '{name}' AS kind, l_returnflag, l_linestatus, CAST(GROUPING(l_returnflag) AS INT) AS g, COUNT(*) AS n, SUM(l_linenumber) AS s FROM {{li}} GROUP BY {how}")
    return spark.sql(" UNION ALL ".join(parts), li=li)


def filtered_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """FILTER clauses, also with DISTINCT; a filter that nothing passes gives null or 0."""
    return spark.sql("""
        SELECT o_orderstatus, COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, COUNT(DISTINCT o_custkey) FILTER (WHERE o_totalprice > 100000) AS large,
          MAX(o_orderkey) FILTER (WHERE o_totalprice < 0) AS none FROM {o} GROUP BY o_orderstatus
    """, o=Catalog(spark, d).orders)


def column_aliases(spark: SparkSession, d: str) -> DataFrame:
    """A derived table with a list of column names."""
    return spark.sql("SELECT n, COUNT(*) AS customers FROM (SELECT o_custkey, COUNT(*) FROM {o} GROUP BY o_custkey) AS per (k, n) GROUP BY n", o=Catalog(spark, d).orders)


def text_as_date(spark: SparkSession, d: str) -> DataFrame:
    """A date column against text, and arithmetic of constants that the optimizer folds."""
    return spark.sql("""
        SELECT COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS qty FROM {li}
        WHERE CAST(l_shipdate AS DATE) >= '1997-01-01' AND CAST(l_shipdate AS DATE) < '1998-01-01'
          AND CAST(l_discount AS DECIMAL(4,2)) BETWEEN 0.06 - 0.01 AND 0.06 + 0.01 AND l_linenumber < 1 + 3
    """, li=Catalog(spark, d).lineitem)


QUERIES = {
    "agg_by_key_sorted": agg_by_key_sorted, "cte_join_agg": cte_join_agg, "chained_exchange": chained_exchange, "hash_exchange": hash_exchange,
    "rr_exchange": rr_exchange, "custom_source_sort": custom_source_sort, "null_aware_anti": null_aware_anti, "join_planned": _strategy(None),
    "join_broadcast": _strategy("broadcast"), "join_shuffle_hash": _strategy("shuffle_hash"), "join_merge": _strategy("merge"),
    "scalar_functions": scalar_functions, "top_orders": top_orders, "sort_nulls": sort_nulls, "full_outer": full_outer,
    "right_join": right_join, "cross_join": cross_join, "theta_join": theta_join, "windows": windows, "set_operations": set_operations, "distinct_rows": distinct_rows,
    "grouping_sets": grouping_sets, "filtered_aggregates": filtered_aggregates, "column_aliases": column_aliases, "text_as_date": text_as_date,
}

_JOIN = "SELECT c_mktsegment, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"
ORACLES = {
    "agg_by_key_sorted": "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1",
    "cte_join_agg": """WITH t AS (SELECT event_type, ROUND(AVG(value), 6) AS mean_value FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY 1)
      SELECT e.event_type, mean_value, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users FROM events e JOIN t ON e.event_type = t.event_type WHERE value IS NOT NULL GROUP BY 1, 2""",
    "chained_exchange": "SELECT l_linenumber, COUNT(*) AS n, CAST(SUM(l_partkey) AS BIGINT) AS s FROM lineitem GROUP BY 1",
    "hash_exchange": "SELECT l_orderkey, COUNT(*) AS n, CAST(1 AS BIGINT) AS places FROM lineitem GROUP BY 1",
    "rr_exchange": "SELECT COUNT(*) AS n, CAST(SUM(l_orderkey) AS BIGINT) AS s FROM lineitem",
    "custom_source_sort": "SELECT CAST(v AS BIGINT) AS numbers FROM range(1, 7) AS t(v) WHERE v > 1",
    "null_aware_anti": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)",
    "join_planned": _JOIN, "join_broadcast": _JOIN, "join_shuffle_hash": _JOIN, "join_merge": _JOIN,
    "scalar_functions": """SELECT o_orderkey, CAST(YEAR(o_orderdate) AS BIGINT) AS y, SUBSTRING(o_orderpriority, 1, 1) AS p, CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS DATE) AS due,
      CASE WHEN o_orderpriority LIKE '%HIGH' THEN 'h' WHEN o_orderpriority LIKE '1-%' THEN 'u' ELSE 'o' END AS c FROM orders""",
    "top_orders": "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(15,2)) AS total FROM orders ORDER BY 2 DESC, 1 LIMIT 20",
    "sort_nulls": "SELECT CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS k, COUNT(*) AS n FROM events GROUP BY 1",
    "full_outer": "SELECT c_custkey, k, n FROM customer FULL JOIN (SELECT o_custkey * 2 AS k, COUNT(*) AS n FROM orders GROUP BY 1) AS o ON c_custkey = k",
    "right_join": "SELECT n_name, COUNT(s_suppkey) AS n, MAX(s_name) AS last FROM (SELECT * FROM supplier WHERE s_acctbal > 9000) AS s RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
    "cross_join": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "theta_join": "SELECT CAST(n_nationkey * 400 AS DOUBLE) AS low, COUNT(*) AS n FROM supplier JOIN nation ON s_acctbal >= n_nationkey * 400 AND s_acctbal < (n_nationkey + 1) * 400 GROUP BY 1",
    "windows": """WITH e AS (SELECT event_id, event_type, user_id, round(value, 4) AS v FROM events)
      SELECT event_id, CAST(row_number() OVER w AS INT) AS place, CAST(rank() OVER (PARTITION BY event_type ORDER BY v NULLS LAST) AS INT) AS rank, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS after,
        count(v) OVER (PARTITION BY event_type ORDER BY v NULLS LAST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far,
        max(user_id) OVER (PARTITION BY event_type ORDER BY v NULLS LAST, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near, CAST(ntile(4) OVER w AS INT) AS quarter
      FROM e WINDOW w AS (PARTITION BY event_type ORDER BY v NULLS LAST, event_id)""",
    "set_operations": """WITH a AS (SELECT CASE WHEN o_custkey % 7 <> 0 THEN o_custkey % 50 END AS k FROM orders), b AS (SELECT CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 70 END AS k FROM customer)
      SELECT 'union' AS kind, k, COUNT(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY k
      UNION ALL SELECT 'union_all', k, COUNT(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY k
      UNION ALL SELECT 'intersect', k, COUNT(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY k
      UNION ALL SELECT 'except', k, COUNT(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) GROUP BY k
      UNION ALL SELECT 'intersect_all', k, COUNT(*) FROM (SELECT * FROM a INTERSECT ALL SELECT * FROM b) GROUP BY k
      UNION ALL SELECT 'except_all', k, COUNT(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY k""",
    "distinct_rows": "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem",
    "grouping_sets": " UNION ALL ".join(f"SELECT '{name}' AS kind, l_returnflag, l_linestatus, CAST(GROUPING(l_returnflag) AS INT) AS g, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY {how}" for name, how in (("rollup", "ROLLUP (l_returnflag, l_linestatus)"), ("cube", "CUBE (l_returnflag, l_linestatus)"), ("sets", "GROUPING SETS ((l_returnflag), (l_linestatus), ())"))),
    "filtered_aggregates": """SELECT o_orderstatus, COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent, COUNT(DISTINCT o_custkey) FILTER (WHERE o_totalprice > 100000) AS large,
      MAX(o_orderkey) FILTER (WHERE o_totalprice < 0) AS none FROM orders GROUP BY o_orderstatus""",
    "column_aliases": "SELECT n, COUNT(*) AS customers FROM (SELECT o_custkey, COUNT(*) FROM orders GROUP BY o_custkey) AS per (k, n) GROUP BY n",
    "text_as_date": """SELECT COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS qty FROM lineitem WHERE CAST(l_shipdate AS DATE) >= '1997-01-01' AND CAST(l_shipdate AS DATE) < '1998-01-01'
      AND CAST(l_discount AS DECIMAL(4,2)) BETWEEN 0.05 AND 0.07 AND l_linenumber < 4""",
}
