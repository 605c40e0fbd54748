"""Writers: parquet with a checked codec, csv, and the converter between table formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.sources.catalog import read_table
from ferrule.sources.schemas import table_schema

CODECS = ("none", "snappy", "gzip", "lz4", "zstd")
#: Known to the format, but no writer is on the stock class path.
UNAVAILABLE = ("brotli", "lzo", "lz0")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", compression: str = "zstd", mode: str = "overwrite") -> None:
    if fmt == "parquet":
        if compression in UNAVAILABLE:
            raise ValueError(f"codec {compression!r} has no writer in a stock Spark; use one of {', '.join(CODECS)}")
        if compression not in CODECS:
            raise ValueError(f"unknown codec {compression!r}; use one of {', '.join(CODECS)}")
        df.write.mode(mode).option("compression", compression).parquet(path)
    elif fmt == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported output format {fmt!r}; use parquet or csv")


def write_sorted_table(df: DataFrame, name: str, path: str, keys: list[str], buckets: int, compression: str = "zstd") -> DataFrame:
    """A catalog table at ``path`` with a declared distribution and order: a file for each bucket of ``keys``, sorted by them.

    Joins and groupings of such tables by these keys need no exchange.
    """
    dealt = df.repartition(buckets, *keys)
    dealt.write.mode("overwrite").option("compression", compression).option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def convert_table(spark: SparkSession, name: str, source: str, target: str, fmt: str = "parquet", compression: str = "zstd", partitions: int | None = None, sort: bool = False) -> None:
    """Pipe-delimited file(s) of a fixed-schema table to csv or parquet.

    ``partitions`` deals the rows out anew; ``sort`` orders by the first column, nulls last. A sort is a
    range exchange of its own, so the deal before it is left out.
    """
    df = read_table(spark, source, "tbl", table_schema(name))
    if sort:
        key = F.col(df.columns[0]).asc_nulls_last()
        df = df.repartitionByRange(partitions, key).sortWithinPartitions(key) if partitions else df.orderBy(key)
    elif partitions:
        df = df.repartition(partitions)
    write_table(df, target, fmt, compression)
