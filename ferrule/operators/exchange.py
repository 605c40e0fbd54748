"""Explicit data distribution and its inspection."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shuffle(df: DataFrame, n: int, *keys: str | Column) -> DataFrame:
    """Keys: rows of one key meet in one of ``n`` partitions. No keys: rows are dealt evenly."""
    if n < 1:
        raise ValueError(f"partition count must be positive, got {n}")
    return df.repartition(n, *keys) if keys else df.repartition(n)


def gather(df: DataFrame) -> DataFrame:
    """All rows in one partition: for a small final result only."""
    return df.coalesce(1)


def chain(df: DataFrame, *sizes: int) -> DataFrame:
    """Exchanges one after another; the optimizer keeps the last, the rows stay the same."""
    for n in sizes:
        df = shuffle(df, n)
    return df


def rows_per_partition(df: DataFrame) -> DataFrame:
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Exchange:
    kind: str  # hash, range, single, round_robin, broadcast
    detail: str


_KINDS = (("hashpartitioning", "hash"), ("rangepartitioning", "range"), ("SinglePartition", "single"), ("RoundRobinPartitioning", "round_robin"), ("BroadcastMode", "broadcast"))


def exchanges(df: DataFrame) -> list[Exchange]:
    """The stage boundaries of the physical plan, top down; empty if it is one stage."""
    found = []
    for line in plan_text(df).splitlines():
        body = re.sub(r"^[\s:+\-*()\d]*", "", line)
        if re.match(r"(Broadcast)?Exchange\b", body):
            found.append(Exchange(next((k for mark, k in _KINDS if mark in body), "other"), re.sub(r"#\d+L?", "", body)))
    return found


def plan_text(df: DataFrame) -> str:
    """The physical plan; of one that has run, the final form alone."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def node_names(df: DataFrame) -> list[str]:
    """Names of the physical operators, top down."""
    names = []
    for line in plan_text(df).splitlines():
        if m := re.match(r"[\s:+\-*()\d]*([A-Z]\w+)", line):
            names.append(m[1])
    return names
