"""Column helpers: decimals as the fixed schemas have them, dates, default null order, registered functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: str | Column) -> Column:
    return _col(c).cast("decimal(15,2)")


def rate(c: str | Column) -> Column:
    """Discounts and taxes: narrow, so that products of three stay exact."""
    return _col(c).cast("decimal(4,2)")


def day(c: str | Column) -> Column:
    return _col(c).cast("date")


def asc(c: str | Column) -> Column:
    """Ascending with nulls last, the engine's default."""
    return _col(c).asc_nulls_last()


def desc(c: str | Column) -> Column:
    """Descending with nulls first, the engine's default."""
    return _col(c).desc_nulls_first()


def geo_mean(c: str | Column) -> Column:
    """Geometric mean of the positive values, combined in the tasks; null if there is none."""
    return F.exp(F.avg(F.when(_col(c) > 0, F.ln(_col(c)))))


def register_functions(spark: SparkSession) -> None:
    """A session hook: ``net_price(price, discount)`` (scalar, an expression that the optimizer inlines) and
    ``geo_mean(x)`` (a Python aggregate, which takes a group to one place; ``geo_mean`` above does not) for SQL text."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION net_price(price DOUBLE, discount DOUBLE) RETURNS DOUBLE RETURN price * (1 - discount)")

    def grouped(x: pd.Series) -> float:
        x = x[x > 0]
        return float(np.exp(np.log(x).mean())) if len(x) else float("nan")

    spark.udf.register("geo_mean", F.pandas_udf(grouped, DoubleType()))
