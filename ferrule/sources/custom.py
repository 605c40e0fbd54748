"""A user-defined leaf source, and an operator that fails: extension and error-path fixtures."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Slice(InputPartition):
    def __init__(self, values: list[int]) -> None:
        self.values = values


class _ListReader(DataSourceReader):
    def __init__(self, values: list[int], slices: int) -> None:
        self._values, self._slices = values, max(1, slices)

    def partitions(self) -> list[InputPartition]:
        size = -(-len(self._values) // self._slices) or 1
        return [_Slice(self._values[i : i + size]) for i in range(0, len(self._values), size)] or [_Slice([])]

    def read(self, partition: InputPartition) -> Iterator[tuple[int]]:
        for v in partition.values:
            yield (v,)


class Int64ListSource(DataSource):
    """``format("int64_list")``: option ``values`` is a comma-separated list, ``slices`` the partition count."""

    @classmethod
    def name(cls) -> str:
        return "int64_list"

    def schema(self) -> str:
        return "numbers bigint"

    def reader(self, schema) -> DataSourceReader:
        given = [int(x) for x in self.options.get("values", "").split(",") if x.strip()]
        return _ListReader(given, int(self.options.get("slices", "1")))


def int64_list(spark: SparkSession, values: list[int], slices: int = 1) -> DataFrame:
    spark.dataSource.register(Int64ListSource)
    return spark.read.format("int64_list").option("values", ",".join(map(str, values))).option("slices", slices).load()


def failing(df: DataFrame, message: str) -> DataFrame:
    """The same schema; running it raises ``message`` on an executor."""

    def fail(batches):
        raise RuntimeError(message)
        yield from batches

    return df.mapInArrow(fail, df.schema)
