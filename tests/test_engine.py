import pytest
from pyspark.sql import functions as F

from ferrule.errors import classify
from ferrule.functions import asc, desc, geo_mean, register_functions
from ferrule.operators import exchange, joins
from ferrule.script import run_script, split_statements
from ferrule.session import Hooks
from ferrule.sources.catalog import Catalog, read_table
from ferrule.sources.custom import failing, int64_list
from ferrule.sources.schemas import table_schema
from ferrule.sources.sinks import convert_table, write_table


def test_exchanges_keep_rows_and_keys(spark):
    df = spark.range(150).select((F.col("id") % 10).alias("k"))
    assert exchange.chain(df, 1, 10, 5).count() == 150
    dealt = exchange.shuffle(df, 7, "k")
    assert dealt.rdd.getNumPartitions() == 7
    assert dealt.select("k", F.spark_partition_id().alias("p")).distinct().count() == 10
    assert all(r["n"] % 15 == 0 for r in exchange.rows_per_partition(dealt).collect())
    assert [x.kind for x in exchange.exchanges(dealt)] == ["hash"]
    assert [x.kind for x in exchange.exchanges(exchange.shuffle(df, 3))] == ["round_robin"]
    assert exchange.gather(df).rdd.getNumPartitions() == 1
    with pytest.raises(ValueError):
        exchange.shuffle(df, 0)


def test_strategies(spark):
    a = spark.range(100).withColumnRenamed("id", "x")
    b = spark.range(50).withColumnRenamed("id", "y")
    for s, node in (("broadcast", "BroadcastHashJoin"), ("shuffle_hash", "ShuffledHashJoin"), ("merge", "SortMergeJoin")):
        j = joins.join_with(a, b, F.col("x") == F.col("y"), strategy=s)
        assert node in exchange.node_names(j) and j.count() == 50
    with pytest.raises(ValueError):
        joins.join_with(a, b, F.col("x") == F.col("y"), strategy="none")
    assert "ResolvedHint" not in joins.broadcast_if_small(a, 1)._jdf.queryExecution().analyzed().toString()


def test_not_in_is_null_aware(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    assert joins.not_in(a, "k", spark.createDataFrame([(1,)], "v int"), "v").collect()[0]["k"] == 2
    assert joins.not_in(a, "k", spark.createDataFrame([(1,), (None,)], "v int"), "v").count() == 0
    assert joins.anti(a, spark.createDataFrame([(1,), (None,)], "k int"), ["k"]).count() == 1
    assert joins.semi(a, spark.createDataFrame([(1,), (1,)], "k int"), ["k"]).count() == 1


def test_custom_source(spark):
    got = [r[0] for r in exchange.shuffle(int64_list(spark, [1, 2, 3, 4, 5, 6], 3).where("numbers > 1"), 10).orderBy(F.col("numbers").desc_nulls_last()).collect()]
    assert got == [6, 5, 4, 3, 2]
    assert int64_list(spark, []).count() == 0


def test_errors_reach_the_driver(spark):
    df = exchange.shuffle(exchange.shuffle(failing(int64_list(spark, [1]), "something failed"), 3), 2, "numbers")
    with pytest.raises(Exception, match="something failed") as e:
        df.orderBy("numbers").collect()
    assert classify(e.value).kind in ("execution", "external")
    for text, kind in (("SELEC 1", "sql"), ("SELECT nope FROM range(1)", "schema"), ("SELECT * FROM no_such", "plan"), ("SELECT 1/0", "arithmetic")):
        with pytest.raises(Exception) as e:
            spark.sql(text).collect()
        assert classify(e.value).kind == kind
    with pytest.raises(Exception) as e:
        spark.read.parquet("/no/such/path").collect()
    assert classify(e.value).kind == "object_store"


def test_an_error_crosses_three_exchanges_as_it_is(spark):
    df = failing(int64_list(spark, [1]), "something failed")
    for size in (1, 2, 3):
        df = exchange.shuffle(df.withColumn(f"p{size}", F.spark_partition_id()), size)  # keeps the exchanges apart
    assert [x.kind for x in exchange.exchanges(df)] == ["round_robin", "round_robin", "single"]
    with pytest.raises(Exception) as e:
        df.collect()
    assert classify(e.value).root == "something failed"


def test_prefer_hash_join(spark):
    from ferrule.session import join_preference

    a, b = spark.range(10_000).withColumnRenamed("id", "x"), spark.range(100_000).withColumnRenamed("id", "y")
    for hash_first, node in ((True, "ShuffledHashJoin"), (False, "SortMergeJoin")):
        settings = {**join_preference(hash_first), "spark.sql.autoBroadcastJoinThreshold": "70000"}
        old = {k: spark.conf.get(k) for k in settings}
        try:
            for k, v in settings.items():
                spark.conf.set(k, v)
            j = a.join(b, F.col("x") == F.col("y"))
            assert j.count() == 10_000 and node in exchange.node_names(j)
        finally:
            for k, v in old.items():
                spark.conf.set(k, v)


def test_sorted_tables_join_without_exchange(spark, tmp_path):
    from ferrule.sources.sinks import write_sorted_table

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = (write_sorted_table(spark.range(1000).select((F.col("id") * k).alias("id"), F.lit(k).alias(f"v{k}")), f"sorted{k}", str(tmp_path / f"s{k}"), ["id"], 4) for k in (2, 3))
        joined = a.join(b, "id")
        assert joined.count() == 333 + 1 and exchange.exchanges(joined) == []
        assert exchange.exchanges(a.groupBy("id").count()) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for k in (2, 3):
            spark.sql(f"DROP TABLE IF EXISTS sorted{k}")


def test_register_all_tables_of_a_directory(spark, small, tmp_path):
    names = Catalog(spark, small).register()
    assert {"region", "nation", "lineitem", "documents"} <= set(names)
    assert spark.sql("SELECT COUNT(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey").collect()[0]["n"] == 25
    for n in names:
        spark.catalog.dropTempView(n)
    for f in ("b.csv", "a.csv", "_x.csv", "c.txt"):
        (tmp_path / f).write_text("k\n1\n")
    assert Catalog(spark, str(tmp_path), "csv").register() == ["a", "b"] and spark.table("a").count() == 1


def test_glob_restricts_a_listing(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for f in ("x.csv", "y.txt"):
        (tmp_path / "d" / f).write_text("k\n1\n")
    assert read_table(spark, str(tmp_path / "d"), "csv", glob="*.csv").count() == 1


def test_views_of_a_query_are_gone(spark, small):
    from ferrule.plans import decision_support

    before = {v.name for v in spark.catalog.listTables()}
    assert decision_support.q15(spark, small).count() >= 1
    assert {v.name for v in spark.catalog.listTables()} == before


def test_script(spark):
    text = "CREATE VIEW v (a, b) AS SELECT id, 'x;y' FROM range(3); -- a; comment\n SELECT SUM(a) AS s FROM v;; DROP VIEW v;"
    assert len(split_statements(text)) == 3
    assert run_script(spark, text).collect()[0]["s"] == 3
    assert run_script(spark, text, result=1).collect()[0]["s"] == 3
    assert not spark.catalog.tableExists("v")


def test_null_order(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "k int")
    assert [r[0] for r in df.orderBy(asc("k")).collect()] == [1, 2, None]
    assert [r[0] for r in df.orderBy(desc("k")).collect()] == [None, 2, 1]


def test_double_quotes_are_identifiers(spark):
    assert spark.sql('SELECT "id" AS x FROM range(2)').agg(F.sum("x")).collect()[0][0] == 1


def test_hooks_and_functions(spark):
    Hooks().on_session(register_functions).apply(spark)
    assert spark.sql("SELECT net_price(CAST(10 AS DOUBLE), CAST(0.5 AS DOUBLE)) AS p").collect()[0]["p"] == 5.0
    assert abs(spark.sql("SELECT * FROM VALUES (1), (100), (-3) AS t(x)").agg(geo_mean("x").alias("g")).collect()[0]["g"] - 10) < 1e-9
    assert "Python" not in exchange.plan_text(spark.sql("SELECT net_price(CAST(id AS DOUBLE), 0.5D) FROM range(2)"))
    assert abs(spark.sql("SELECT geo_mean(CAST(x AS DOUBLE)) AS g FROM VALUES (1), (100) AS t(x)").collect()[0]["g"] - 10) < 1e-9


def test_formats_round_trip(spark, tmp_path):
    tbl = tmp_path / "region.tbl"
    tbl.write_text("1|EUROPE|far|\n0|ASIA||\n")
    back = read_table(spark, str(tbl), "tbl", table_schema("region"))
    assert back.columns == ["r_regionkey", "r_name", "r_comment"] and back.count() == 2
    for fmt in ("parquet", "csv"):
        convert_table(spark, "region", str(tbl), str(tmp_path / f"r.{fmt}"), fmt, partitions=2, sort=True)
        got = read_table(spark, str(tmp_path / f"r.{fmt}"), fmt, table_schema("region") if fmt == "csv" else None).orderBy("r_regionkey").collect()
        assert [(r[0], r[1]) for r in got] == [(0, "ASIA"), (1, "EUROPE")]
    for codec in ("none", "snappy", "gzip", "lz4", "zstd"):
        write_table(back, str(tmp_path / f"c-{codec}"), compression=codec)
    for bad in ("brotli", "lzo", "what"):
        with pytest.raises(ValueError):
            write_table(back, str(tmp_path / "x"), compression=bad)
    with pytest.raises(ValueError):
        read_table(spark, str(tbl), "orc")
    with pytest.raises(ValueError):
        read_table(spark, str(tbl), "tbl")
    with pytest.raises(ValueError):
        table_schema("nope")


def test_catalog(spark, small):
    c = Catalog(spark, small)
    c.register(["region", "nation"])
    assert spark.sql("SELECT COUNT(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey").collect()[0]["n"] == 25
    assert c.in_memory("region", 3).rdd.getNumPartitions() == 3
    c.region.unpersist()


def test_streaming_counts_equal_batch(spark, small, tmp_path):
    from ferrule.streaming import read_stream, windowed_counts

    events = Catalog(spark, small).events
    events.write.parquet(str(tmp_path / "e"))
    q = windowed_counts(read_stream(spark, str(tmp_path / "e"), events)).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("counts").agg(F.sum("n")).collect()[0][0] == events.count()
    assert windowed_counts(events).agg(F.sum("n")).collect()[0][0] == events.count()
