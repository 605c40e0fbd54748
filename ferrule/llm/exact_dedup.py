"""Exact deduplication by a log-structured merge index of digests, in DataFrame operations alone.

A memtable combines the digests of the rows that a task has seen: smallest id and number of rows. Flushed memtables
form a run: a table bucketed by digest, each bucket one file sorted by it, with Bloom filters and min/max statistics
in the files. When a level has FANOUT runs they are compacted into one run of the next level: sorted buckets merge by
a full outer merge join, without a shuffle, to the smallest id and the sum of the rows. The corpus is flushed in
several runs, so levels fill and merge; what stays at the end is merged once more.

Before the index is probed, a filter of the digests that count several rows decides: a document that it does not
know is alone for certain and no run is read for it. The filter has FILTER_ROWS rows of 4 KB at most, whatever the corpus
(fuller filters let more documents through, none is lost). Documents that pass probe the index, and their texts are
compared byte for byte (smallest = largest text of a digest, combined in the tasks before the exchange, so no group
meets in one task). Digests that fail, which would be a collision, are regrouped by their texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.common import new_path, partitions, removed, stored

SPACES = "[\\x20\\x09-\\x0D]+"
#: Flushes of the corpus, and runs of one level that are compacted.
FLUSHES, FANOUT = 4, 2
#: Rows of 32,768 bits each: 2 MB in all.
FILTER_ROWS = 512
FILTER_BITS = FILTER_ROWS * 32768
#: A digest with more than 1 / HOT of all rows is broadcast; there are fewer than HOT of these.
HOT = 1000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


class MergeIndex:
    """Runs of (digest, keep_id, group_size) by level, in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, filter_ndv: int = 200_000) -> None:
        self._spark, self._fanout, self._ndv = spark, max(2, fanout), filter_ndv
        self._buckets = partitions(spark)
        self.levels: list[list[tuple[str, str]]] = []  # (table, path) of each run

    def _write(self, df: DataFrame) -> tuple[str, str]:
        """A run: bucketed and sorted, a file a bucket."""
        path, name = new_path(self._spark, "run"), f"ferrule_run_{uuid.uuid4().hex}"
        (
            df.write.bucketBy(self._buckets, "digest").sortBy("digest").option("path", path)
            .option("parquet.bloom.filter.enabled#digest", "true").option("parquet.bloom.filter.expected.ndv#digest", str(self._ndv))
            .option("parquet.bloom.filter.adaptive.enabled", "true").saveAsTable(name)
        )
        return name, path

    def _drop(self, run: tuple[str, str]) -> None:
        self._spark.sql(f"DROP TABLE {run[0]}")
        removed(self._spark, run[1])

    def add(self, entries: DataFrame) -> None:
        """Flushes memtables of rows (digest binary, doc_id long) as one run; full levels are compacted."""
        memtables = entries.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        self._place(self._write(memtables.repartition(self._buckets, "digest")), 0)

    def _place(self, run: tuple[str, str], level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self._fanout:
            runs, self.levels[level] = self.levels[level], []
            self._place(self._compacted(runs), level + 1)

    def merged(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Two runs as one: sorted buckets are merged where they lie."""
        a, b = (df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns]) for p, df in (("a", left), ("b", right)))
        zero = F.lit(0).cast("long")
        return a.join(b.hint("merge"), F.col("a_digest") == F.col("b_digest"), "full").select(
            F.coalesce("a_digest", "b_digest").alias("digest"), F.least("a_keep_id", "b_keep_id").alias("keep_id"),
            (F.coalesce("a_group_size", zero) + F.coalesce("b_group_size", zero)).alias("group_size"),
        )

    def _compacted(self, runs: list[tuple[str, str]]) -> tuple[str, str]:
        while len(runs) > 1:
            a, b, *rest = runs
            both = self._write(self.merged(self._spark.table(a[0]), self._spark.table(b[0])))
            for run in (a, b):
                self._drop(run)
            runs = [*rest, both]
        return runs[0]

    def compact(self) -> DataFrame:
        """All levels merged into one run, the newest and smallest first."""
        runs = [r for level in self.levels for r in reversed(level)]
        if not runs:
            return self._spark.createDataFrame([], "digest binary, keep_id long, group_size long")
        self.levels = [[self._compacted(runs)]]
        return self.table()

    def table(self) -> DataFrame:
        """The run that ``compact`` has left."""
        return self._spark.table(self.levels[0][0][0])

    def lookup(self, digest: bytes) -> DataFrame:
        """The row of one digest, of all runs: bucketing leaves one file of each, and statistics and Bloom filters
        spare its row groups if they lack the digest."""
        found = None
        for name, _ in (r for level in self.levels for r in level):
            own = self._spark.table(name).where(F.col("digest") == F.lit(digest))
            found = own if found is None else found.unionByName(own)
        return found.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def filter_of(digests: DataFrame) -> DataFrame:
    """(slot, bits) of the digests: FILTER_ROWS rows at most."""
    at = digests.select(F.pmod(F.xxhash64("digest"), F.lit(FILTER_BITS)).alias("at"))
    return at.groupBy(F.floor(F.col("at") / 32768).cast("int").alias("slot")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits"))


def probed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (with a digest) with a column ``maybe``: false if the digest is not in the filter for certain."""
    at = F.pmod(F.xxhash64("digest"), F.lit(FILTER_BITS))
    with_slot = rows.withColumn("__at", (at % 32768).cast("int")).withColumn("__slot", F.floor(at / 32768).cast("int"))
    joined = with_slot.join(F.broadcast(known), F.col("__slot") == F.col("slot"), "left")  # FILTER_ROWS rows
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("__at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.expr("shiftright(byte, __at % 8) & 1 = 1"), F.lit(False))
    return joined.withColumn("byte", byte).withColumn("maybe", hit).select(*rows.columns, "maybe")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", flushes: int = FLUSHES, digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after each run of [\\x20\\x09-\\x0D] became one space; null counts as empty.
    Rows repeated with one id and text count each, and each is reported kept if that id is the smallest. A null id is
    larger than any other: keep_id is null, and the rows kept, only if all rows of a text have none. Other columns are
    ignored. An empty table gives an empty result. ``digest`` replaces the index key (tests).
    """
    spark = docs.sparkSession
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), normalised(docs[text_col]).alias("norm"))
    sha = lambda c: F.unhex(F.sha2(c, 256))
    key = digest or sha
    entries = stored(own.select(key(F.col("norm")).alias("digest"), "doc_id", F.pmod(F.spark_partition_id(), F.lit(flushes)).alias("flush")), "entries")
    index = MergeIndex(spark)
    for k in range(flushes):
        index.add(entries.where(F.col("flush") == k).select("digest", "doc_id"))
    level = index.compact()

    known = stored(filter_of(level.where("group_size > 1")), "filter")
    hits = probed(own.withColumn("digest", key(F.col("norm"))), known).where("maybe")
    bad = hits.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).where("a <> b").select("digest")
    collided = bool(bad.limit(1).collect())

    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    if digest is None and not collided:
        sha_of = F.lower(F.hex("digest")).alias("text_sha256")
        found = probed(entries.select("digest", "doc_id"), known)
        alone = found.where("NOT maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha_of)
        level = level.withColumnRenamed("digest", "key")
        common = F.broadcast(level.where(F.col("group_size") * HOT > entries.count()))  # fewer than HOT rows, or than the table
        columns = ["doc_id", "keep_id", "group_size", kept, sha_of]
        maybe = found.where("maybe").join(common, F.col("digest") == F.col("key"), "left")
        rest = maybe.where("key IS NULL").select("digest", "doc_id").join(level, F.col("digest") == F.col("key"))
        return alone.unionByName(maybe.where("key IS NOT NULL").select(*columns)).unionByName(rest.select(*columns))
    # group by the texts themselves where a digest has several
    bad = bad.distinct()
    full = own.withColumn("digest", key(F.col("norm"))).withColumn("text_sha256", F.lower(F.hex(sha(F.col("norm")))))
    apart = full.join(bad, "digest", "left_semi")
    groups = apart.groupBy("digest", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    columns = ["doc_id", "keep_id", "group_size", kept, "text_sha256"]
    rest = full.join(bad, "digest", "left_anti").select("doc_id", "digest", "text_sha256").join(level, "digest").select(*columns)
    return rest.unionByName(apart.join(groups, ["digest", "norm"]).select(*columns))
