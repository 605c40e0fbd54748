"""Tables of a directory as DataFrames and views: parquet, csv, tbl."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ferrule.sources.schemas import PLACEHOLDER, TABLES, table_schema

FORMATS = ("parquet", "csv", "tbl")


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, glob: str | None = None) -> DataFrame:
    """A file or directory as a DataFrame.

    parquet infers its schema; csv (header, comma) and tbl (pipe, no header, trailing empty column)
    take ``schema`` or infer none. ``glob`` restricts a directory listing to matching file names.
    """
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if fmt == "parquet":
        return (reader.schema(schema) if schema else reader).parquet(path)
    if fmt == "csv":
        reader = reader.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if fmt == "tbl":
        if not schema:
            raise ValueError("tbl files carry no names: give a schema")
        return reader.option("sep", "|").schema(f"{schema}, {PLACEHOLDER} string").csv(path).drop(PLACEHOLDER)
    raise ValueError(f"unsupported format {fmt!r}; use one of {', '.join(FORMATS)}")


class Catalog:
    """Lazily opened tables of one directory; attribute access gives DataFrames."""

    def __init__(self, spark: SparkSession, directory: str, fmt: str = "parquet", schemas: dict[str, str] | None = None) -> None:
        if fmt not in FORMATS:
            raise ValueError(f"unsupported format {fmt!r}; use one of {', '.join(FORMATS)}")
        self._spark, self._dir, self._fmt = spark, directory.rstrip("/"), fmt
        self._schemas = schemas if schemas is not None else ({} if fmt == "parquet" else dict(TABLES))
        self._open: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._open:
            self._open[name] = read_table(self._spark, f"{self._dir}/{name}.{self._fmt}", self._fmt, self._schemas.get(name))
        return self._open[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)

    def names(self) -> list[str]:
        """The tables of the directory: its files and folders of this format, by whatever store holds them."""
        path = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._dir)
        found = path.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        files = [f.getPath().getName() for f in found]
        return sorted(f.removesuffix(f".{self._fmt}") for f in files if f.endswith(f".{self._fmt}") and not f.startswith((".", "_")))

    def register(self, names: Iterable[str] | None = None) -> list[str]:
        """Makes the tables, or all of the directory, temp views of their own names; gives the names."""
        names = list(self.names() if names is None else names)
        for name in names:
            self.table(name).createOrReplaceTempView(name)
        return names

    def in_memory(self, name: str, partitions: int) -> DataFrame:
        """The table dealt into ``partitions`` and held by the executors (spilling to their disks)."""
        df = self.table(name).repartition(partitions).cache()
        df.count()
        self._open[name] = df
        return df


__all__ = ["FORMATS", "Catalog", "read_table", "table_schema"]
