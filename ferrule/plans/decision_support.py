"""The 22 decision-support queries over the driver's tables.

Columns and the partsupp table that these tables lack are replaced by others of the same kind; the shape of
each plan (joins, subqueries, aggregates) stays. Money is cast to decimal before arithmetic, so sums do not
depend on the order of rows. ``ORDER BY`` of the originals is kept where it is the visible result; rows are
compared as sets.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions import asc, day, desc, money, rate
from ferrule.script import run_script
from ferrule.sources.catalog import Catalog

SUM2, SUM4, SUM6 = "decimal(38,2)", "decimal(38,4)", "decimal(38,6)"


def _date(text: str) -> Column:
    return F.lit(datetime.date.fromisoformat(text))


def _lineitem(t: Catalog) -> DataFrame:
    """Line items with exact types; Catalyst prunes what a query leaves unused."""
    return t.lineitem.withColumns({
        "l_quantity": money("l_quantity"), "l_extendedprice": money("l_extendedprice"),
        "l_discount": rate("l_discount"), "l_tax": rate("l_tax"), "l_shipdate": day("l_shipdate"),
    })


def _orders(t: Catalog) -> DataFrame:
    return t.orders.withColumns({"o_orderdate": day("o_orderdate"), "o_totalprice": money("o_totalprice")})


def _partsupp(t: Catalog, parts: DataFrame | None = None, suppliers: DataFrame | None = None) -> DataFrame:
    """Stand-in for the missing table: one row per part and supplier seen in line items.

    With ``parts`` or ``suppliers``, only theirs; both are grouping keys, so line items of others go before the shuffle.
    """
    lines = t.lineitem
    if parts is not None:
        lines = lines.join(parts.select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    if suppliers is not None:
        lines = lines.join(suppliers.select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return lines.groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).agg(
        F.sum(F.col("l_linenumber").cast("bigint")).alias("ps_availqty"),
        F.min(money("l_extendedprice")).alias("ps_supplycost"),
    )


def _net() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def _total(c: Column, kind: str = SUM4) -> Column:
    return F.sum(c).cast(kind)


def q1(spark: SparkSession, d: str) -> DataFrame:
    li = _lineitem(Catalog(spark, d)).where(F.col("l_shipdate") <= _date("1998-09-02"))
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return (
        li.groupBy("l_returnflag", "l_linestatus")
        .agg(
            _total(F.col("l_quantity"), SUM2).alias("sum_qty"),
            _total(F.col("l_extendedprice"), SUM2).alias("sum_base_price"),
            _total(_net()).alias("sum_disc_price"),
            _total(_net() * (1 + F.col("l_tax")), SUM6).alias("sum_charge"),
            mean("l_quantity").alias("avg_qty"), mean("l_extendedprice").alias("avg_price"), mean("l_discount").alias("avg_disc"),
            F.count("*").alias("count_order"),
        )
        .orderBy(asc("l_returnflag"), asc("l_linestatus"))
    )


def q2(spark: SparkSession, d: str) -> DataFrame:
    t = Catalog(spark, d)
    near = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region.where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"))
    wanted = t.part.where("p_size = 15")  # the subquery is correlated by part, so it needs no other parts
    least = F.min("ps_supplycost").over(Window.partitionBy("ps_partkey"))
    offers = _partsupp(t, wanted, near).withColumn("least", least).where("ps_supplycost = least")
    return (
        offers.join(wanted.select("p_partkey"), F.col("ps_partkey") == F.col("p_partkey"))
        .join(near, F.col("ps_suppkey") == F.col("s_suppkey"))
        .select(money("s_acctbal").alias("s_acctbal"), "s_name", "n_name", "p_partkey")
        .orderBy(desc("s_acctbal"), asc("n_name"), asc("s_name"), asc("p_partkey"))
    )


def q3(spark: SparkSession, d: str) -> DataFrame:
    t = Catalog(spark, d)
    return (
        t.customer.where("c_mktsegment = 'BUILDING'")
        .join(_orders(t).where(F.col("o_orderdate") < _date("1998-03-15")), F.col("c_custkey") == F.col("o_custkey"))
        .join(_lineitem(t).where(F.col("l_shipdate") > _date("1998-03-15")), F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("l_orderkey", "o_orderdate")
        .agg(_total(_net()).alias("revenue"))
        .orderBy(desc("revenue"), asc("o_orderdate"))
    )


def q4(spark: SparkSession, d: str) -> DataFrame:
    t, start = Catalog(spark, d), _date("1997-07-01")
    late = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey")
    return (
        _orders(t).where((F.col("o_orderdate") >= start) & (F.col("o_orderdate") < F.add_months(start, 3)))
        .join(late, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
        .groupBy("o_orderpriority").agg(F.count("*").alias("order_count")).orderBy(asc("o_orderpriority"))
    )


def q5(spark: SparkSession, d: str) -> DataFrame:
    t = Catalog(spark, d)
    home = t.nation.join(t.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    orders = _orders(t).where(F.col("o_orderdate").between(_date("1997-01-01"), _date("1997-12-31")))
    return (
        _lineitem(t).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.supplier, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
        .join(home, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("n_name").agg(_total(_net()).alias("revenue")).orderBy(desc("revenue"))
    )


def q6(spark: SparkSession, d: str) -> DataFrame:
    li = _lineitem(Catalog(spark, d))
    return li.where(
        F.col("l_shipdate").between(_date("1997-01-01"), _date("1997-12-31"))
        & F.col("l_discount").between(F.lit("0.05").cast("decimal(4,2)"), F.lit("0.07").cast("decimal(4,2)"))
        & (F.col("l_quantity") < 24)
    ).agg(_total(F.col("l_extendedprice") * F.col("l_discount")).alias("revenue"))


def q7(spark: SparkSession, d: str) -> DataFrame:
    t = Catalog(spark, d)
    n1 = t.nation.select(F.col("n_nationkey").alias("k1"), F.col("n_name").alias("supp_nation"))
    n2 = t.nation.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("cust_nation"))
    a, b = "NATION_6", "NATION_7"
    pair = ((F.col("supp_nation") == a) & (F.col("cust_nation") == b)) | ((F.col("supp_nation") == b) & (F.col("cust_nation") == a))
    return (
        _lineitem(t).where(F.col("l_shipdate").between(_date("1995-01-01"), _date("1996-12-31")))
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(n1, F.col("s_nationkey") == F.col("k1"))
        .join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(n2, (F.col("c_nationkey") == F.col("k2")) & pair)
        .withColumn("l_year", F.year("l_shipdate").cast("bigint"))
        .groupBy("supp_nation", "cust_nation", "l_year").agg(_total(_net()).alias("revenue"))
        .orderBy(asc("supp_nation"), asc("cust_nation"), asc("l_year"))
    )


def q8(spark: SparkSession, d: str) -> DataFrame:
    t = Catalog(spark, d)
    near = t.nation.select(F.col("n_nationkey").alias("ck"), "n_regionkey").join(t.region.where("r_name = 'AMERICA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    seller = t.nation.select(F.col("n_nationkey").alias("sk"), F.col("n_name").alias("nation"))
    volume = (
        _lineitem(t).join(t.part.where("p_type = 'ECONOMY'"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(seller, F.col("s_nationkey") == F.col("sk"))
        .join(_orders(t).where(F.col("o_orderdate").between(_date("1995-01-01"), _date("1996-12-31"))), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(near, F.col("c_nationkey") == F.col("ck"))
        .select(F.year("o_orderdate").cast("bigint").alias("o_year"), _net().alias("volume"), "nation")
    )
    own = _total(F.when(F.col("nation") == "NATION_2", F.col("volume")).otherwise(F.lit(0))).cast("double")
    return volume.groupBy("o_year").agg(F.round(own / _total(F.col("volume")).cast("double"), 6).alias("mkt_share")).orderBy(asc("o_year"))


def q9(spark: SparkSession, d: str) -> DataFrame:
    t = Catalog(spark, d)
    wanted = t.part.where("p_name LIKE '%gear%'")
    return (
        _lineitem(t).join(wanted, F.col("l_partkey") == F.col("p_partkey"))
        .join(_partsupp(t, wanted), (F.col("l_partkey") == F.col("ps_partkey")) & (F.col("l_suppkey") == F.col("ps_suppkey")))
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(_orders(t), F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("amount", (_net() - F.col("ps_supplycost") * F.col("l_quantity")).cast(SUM4))
        .groupBy(F.col("n_name").alias("nation"), F.year("o_orderdate").cast("bigint").alias("o_year"))
        .agg(_total(F.col("amount")).alias("sum_profit")).orderBy(asc("nation"), desc("o_year"))
    )


def q10(spark: SparkSession, d: str) -> DataFrame:
    t, start = Catalog(spark, d), _date("1997-10-01")
    return (
        _lineitem(t).where("l_returnflag = 'R'")
        .join(_orders(t).where((F.col("o_orderdate") >= start) & (F.col("o_orderdate") < F.add_months(start, 3))), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer.withColumn("c_acctbal", money("c_acctbal")), F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("c_custkey", "c_name", "c_acctbal", "n_name").agg(_total(_net()).alias("revenue")).orderBy(desc("revenue"))
    )


def q11(spark: SparkSession, d: str) -> DataFrame:
    t = Catalog(spark, d)
    near = t.supplier.join(t.nation.where("n_name = 'NATION_7'"), F.col("s_nationkey") == F.col("n_nationkey"))
    worth = _total(F.col("ps_supplycost") * F.col("ps_availqty"), SUM2)
    held = _partsupp(t, suppliers=near).groupBy("ps_partkey").agg(worth.alias("worth"))
    floor = held.agg((_total(F.col("worth"), SUM2).cast("double") * 0.001).alias("floor"))  # one row; it reuses the exchange of ``held``
    return held.join(F.broadcast(floor), F.col("worth").cast("double") > F.col("floor")).select("ps_partkey", "worth").orderBy(desc("worth"))


def q12(spark: SparkSession, d: str) -> DataFrame:
    t = Catalog(spark, d)
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return (
        _lineitem(t).where(F.col("l_returnflag").isin("A", "R") & F.col("l_shipdate").between(_date("1997-01-01"), _date("1997-12-31")))
        .join(_orders(t), (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate")))
        .groupBy("l_returnflag")
        .agg(F.sum(F.when(urgent, 1).otherwise(0)).alias("high_line_count"), F.sum(F.when(urgent, 0).otherwise(1)).alias("low_line_count"))
        .orderBy(asc("l_returnflag"))
    )


def q13(spark: SparkSession, d: str) -> DataFrame:
    t = Catalog(spark, d)
    on = (F.col("c_custkey") == F.col("o_custkey")) & ~F.col("o_orderpriority").like("1%URGENT%") & (F.col("o_orderstatus") == "O")
    per = t.customer.join(t.orders, on, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("c_count"))
    return per.groupBy("c_count").agg(F.count("*").alias("custdist")).orderBy(desc("custdist"), desc("c_count"))


def q14(spark: SparkSession, d: str) -> DataFrame:
    t = Catalog(spark, d)
    joined = _lineitem(t).where(F.col("l_shipdate").between(_date("1997-09-01"), _date("1997-09-30"))).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    promo = _total(F.when(F.col("p_type").like("PROMO%"), _net()).otherwise(F.lit(0))).cast("double")
    return joined.agg(F.round(100.0 * promo / _total(_net()).cast("double"), 6).alias("promo_revenue"))


def q15(spark: SparkSession, d: str) -> DataFrame:
    """Runs as a script: views, query, drops. Its views have names of their own and are gone afterwards."""
    t = Catalog(spark, d)
    t.lineitem.createOrReplaceTempView("q15_lineitem")
    t.supplier.createOrReplaceTempView("q15_supplier")
    return run_script(spark, """
        CREATE VIEW quarter_revenue (supplier_no, total_revenue) AS
          SELECT l_suppkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DECIMAL(38,4))
          FROM q15_lineitem
          WHERE CAST(l_shipdate AS DATE) >= DATE '1996-01-01' AND CAST(l_shipdate AS DATE) < DATE '1996-01-01' + INTERVAL '3' MONTH
          GROUP BY l_suppkey;
        SELECT s.s_suppkey, s.s_name, r.total_revenue FROM q15_supplier s JOIN quarter_revenue r ON s.s_suppkey = r.supplier_no
          WHERE r.total_revenue = (SELECT MAX(total_revenue) FROM quarter_revenue) ORDER BY s.s_suppkey NULLS LAST;
        DROP VIEW quarter_revenue; DROP VIEW q15_lineitem; DROP VIEW q15_supplier
    """, result=1)


def q16(spark: SparkSession, d: str) -> DataFrame:
    t = Catalog(spark, d)
    wanted = t.part.where("p_brand <> 'Brand#4' AND p_type NOT LIKE 'MED%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)")
    return spark.sql("""
        SELECT p.p_brand, p.p_type, p.p_size, COUNT(DISTINCT ps.ps_suppkey) AS supplier_cnt
        FROM {ps} AS ps JOIN {part} AS p ON p.p_partkey = ps.ps_partkey
        WHERE ps.ps_suppkey NOT IN (SELECT s.s_suppkey FROM {supplier} AS s WHERE s.s_acctbal < 0)
        GROUP BY p.p_brand, p.p_type, p.p_size
        ORDER BY supplier_cnt DESC NULLS FIRST, p.p_brand NULLS LAST, p.p_type NULLS LAST, p.p_size NULLS LAST
    """, ps=_partsupp(t, wanted), part=wanted, supplier=t.supplier)


def q17(spark: SparkSession, d: str) -> DataFrame:
    t = Catalog(spark, d)
    wanted = _lineitem(t).join(t.part.where("p_brand = 'Brand#23'").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    limit = wanted.groupBy(F.col("l_partkey").alias("k")).agg((0.5 * F.avg(F.col("l_quantity").cast("double"))).alias("limit"))
    return wanted.join(limit, (F.col("l_partkey") == F.col("k")) & (F.col("l_quantity").cast("double") < F.col("limit"))).agg(F.round(_total(F.col("l_extendedprice"), SUM2).cast("double") / 7.0, 4).alias("avg_yearly"))


def q18(spark: SparkSession, d: str) -> DataFrame:
    t = Catalog(spark, d)
    li = _lineitem(t)
    large = li.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias("q")).where("q > 300").select("k")
    return (
        _orders(t).join(large, F.col("o_orderkey") == F.col("k"), "left_semi")
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(li, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy("c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice").agg(_total(F.col("l_quantity"), SUM2).alias("sum_qty"))
        .orderBy(desc("o_totalprice"), asc("o_orderdate"))
    )


def q19(spark: SparkSession, d: str) -> DataFrame:
    t = Catalog(spark, d)

    def arm(brand: str, types: list[str], low: int, size: int) -> Column:
        return (F.col("p_brand") == brand) & F.col("p_type").isin(*types) & F.col("l_quantity").between(low, low + 10) & F.col("p_size").between(1, size)

    either = arm("Brand#12", ["PROMO", "SMALL", "ECONOMY"], 1, 15) | arm("Brand#23", ["MEDIUM", "STANDARD", "PROMO"], 10, 20) | arm("Brand#24", ["LARGE", "ECONOMY", "STANDARD"], 20, 25)
    return (
        _lineitem(t).where(F.col("l_returnflag").isin("A", "R"))
        .join(t.part, (F.col("l_partkey") == F.col("p_partkey")) & either).agg(_total(_net()).alias("revenue"))
    )


def q20(spark: SparkSession, d: str) -> DataFrame:
    t = Catalog(spark, d)
    wanted = t.part.where("p_name LIKE 'cold%'")  # "used" is correlated by part, so it needs no other parts
    lines = _lineitem(t).join(wanted, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    sold = F.sum(F.when(F.col("l_shipdate").between(_date("1997-01-01"), _date("1997-12-31")), F.col("l_quantity")))  # null if none
    both = lines.groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).agg(F.sum(F.col("l_linenumber").cast("bigint")).alias("ps_availqty"), (0.5 * sold.cast("double")).alias("half"))
    stocked = both.where(F.col("ps_availqty").cast("double") > F.col("half"))
    return t.supplier.join(stocked, F.col("s_suppkey") == F.col("ps_suppkey"), "left_semi").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_name", "n_name").orderBy(asc("s_name"))


def q21(spark: SparkSession, d: str) -> DataFrame:
    t = Catalog(spark, d)
    l1 = t.lineitem.select(F.col("l_orderkey").alias("ok"), F.col("l_suppkey").alias("sk"), "l_returnflag").where("l_returnflag = 'R'")
    other = t.lineitem.select("l_orderkey", "l_suppkey", F.col("l_returnflag").alias("flag"))
    apart = (F.col("ok") == F.col("l_orderkey")) & (F.col("sk") != F.col("l_suppkey"))
    return (
        l1.join(other, apart, "left_semi").join(other.where("flag = 'R'"), apart, "left_anti")
        .join(t.orders.where("o_orderstatus = 'F'"), F.col("ok") == F.col("o_orderkey"), "left_semi")
        .join(t.supplier, F.col("sk") == F.col("s_suppkey"))
        .groupBy("s_name").agg(F.count("*").alias("numwait")).orderBy(desc("numwait"), asc("s_name"))
    )


def q22(spark: SparkSession, d: str) -> DataFrame:
    t = Catalog(spark, d)
    own = t.customer.select("c_custkey", F.substring("c_mktsegment", 1, 2).alias("cntrycode"), money("c_acctbal").alias("c_acctbal")).where(F.col("cntrycode").isin("AU", "BU", "FU", "HO", "MA"))
    mean = own.where("c_acctbal > 0").agg(F.avg(F.col("c_acctbal").cast("double")).alias("mean"))  # one row
    idle = t.orders.where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return (
        own.join(F.broadcast(mean), F.col("c_acctbal").cast("double") > F.col("mean"))
        .join(idle, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
        .groupBy("cntrycode").agg(F.count("*").alias("numcust"), _total(F.col("c_acctbal"), SUM2).alias("totacctbal")).orderBy(asc("cntrycode"))
    )


QUERIES = {f"tpch_q{n}": globals()[f"q{n}"] for n in range(1, 23)}
