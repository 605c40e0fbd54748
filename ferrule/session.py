"""Session factory with presets and extension hooks."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession

#: What the engine relies on. Everything else is left to the cluster.
PRESETS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

Builder = SparkSession.Builder
Hook = Callable[[SparkSession], None]


class Hooks:
    """Extension points, applied in order of registration.

    ``on_builder`` sees the builder before the session exists (jars, ``spark.sql.extensions``);
    ``on_session`` sees the session (functions, data sources, views, settings).
    """

    def __init__(self) -> None:
        self._builder: list[Callable[[Builder], Builder]] = []
        self._session: list[Hook] = []

    def on_builder(self, f: Callable[[Builder], Builder]) -> "Hooks":
        self._builder.append(f)
        return self

    def on_session(self, f: Hook) -> "Hooks":
        self._session.append(f)
        return self

    def build(self, builder: Builder) -> SparkSession:
        for f in self._builder:
            builder = f(builder)
        return self.apply(builder.getOrCreate())

    def apply(self, spark: SparkSession) -> SparkSession:
        for f in self._session:
            f(spark)
        return spark


def join_preference(hash_first: bool) -> dict[str, str]:
    """Settings by which joins that shuffle prefer a hash table or a merge. A hash join needs partitions that fit into
    memory: the second setting is the size up to which adaptive execution takes a partition to fit."""
    return {"spark.sql.join.preferSortMergeJoin": str(not hash_first).lower(), "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m" if hash_first else "0"}


def start_session(
    app: str = "ferrule",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
    hooks: Hooks | Iterable[Hook] | None = None,
    prefer_hash_join: bool | None = None,
) -> SparkSession:
    """A session with PRESETS, then ``conf``, then the hooks. ``master=None`` leaves it to spark-submit.

    ``prefer_hash_join``: of joins that shuffle both sides, whether hash joins come before merge joins where they can;
    None leaves Spark's default, merge joins.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(PRESETS)
    if prefer_hash_join is not None:
        settings.update(join_preference(prefer_hash_join))
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in (settings | (conf or {})).items():
        builder = builder.config(k, v)
    if not isinstance(hooks, Hooks):
        own = Hooks()
        for f in hooks or ():
            own.on_session(f)
        hooks = own
    return hooks.build(builder)
