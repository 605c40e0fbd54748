"""Join helpers whose semantics need care, and a checked broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRATEGIES = {"broadcast": "BROADCAST", "shuffle_hash": "SHUFFLE_HASH", "merge": "MERGE", "nested_loop": "SHUFFLE_REPLICATE_NL"}


def join_with(left: DataFrame, right: DataFrame, on, how: str = "inner", strategy: str | None = None) -> DataFrame:
    """A join whose right side carries a strategy hint; None leaves the choice to the planner."""
    if strategy is None:
        return left.join(right, on, how)
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; use one of {', '.join(STRATEGIES)}")
    return left.join(right.hint(STRATEGIES[strategy]), on, how)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit_bytes: int = 64 << 20) -> DataFrame:
    """A broadcast hint only if the estimated size allows; else the planner shuffles."""
    return F.broadcast(df) if plan_bytes(df) <= limit_bytes else df


def semi(left: DataFrame, right: DataFrame, on: Column | list[str]) -> DataFrame:
    """EXISTS; a residual condition may be part of ``on``."""
    return left.join(right, on, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: Column | list[str]) -> DataFrame:
    """NOT EXISTS. For NOT IN over a nullable subquery use ``not_in``."""
    return left.join(right, on, "left_anti")


def not_in(left: DataFrame, key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Null-aware anti join: a null in the subquery leaves no row."""
    return left.sparkSession.sql(
        f"SELECT * FROM {{l}} AS l WHERE l.`{key}` NOT IN (SELECT r.`{right_key}` FROM {{r}} AS r)", l=left, r=right
    )
