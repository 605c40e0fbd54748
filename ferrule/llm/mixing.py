"""Mixing sources to target weights, block by block.

The words of a source, in the order of ids, are packed into blocks of ``block_words`` words (the last one may be
short). A source's target over the words it has, in blocks, is its quota of slots. The slots of all sources fill
output shards: the sources' counts of each shard are multinomial draws that are conditioned on the quotas (drawn
down a binary tree over the shards, each node seeded by its place, so any shard can be drawn alone). Slot j of a
source reads block P(j): a pseudorandom permutation of the source's block numbers, a fresh one for each time the
source is gone through. Slots join blocks by (source, block).

The word offset of a document in its source is a prefix sum in two levels: within chunks of the id order, and over
the chunks' sums, so a source of a third of all rows is spread over as many tasks as there are chunks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.llm.common import in_batches, partitions, stored

WEIGHTS, SCALE, REPEAT = (5.0, 2.0, 1.0), 1.5, 2.0
BLOCK_WORDS, SHARD_SLOTS, SEED = 64, 4096, 20240607


@dataclass(frozen=True)
class Source:
    index: int
    name: str | None
    size: int
    target: float
    blocks: int
    slots: int


def words(text: Column) -> Column:
    """Number of runs of [^\\x20\\x09-\\x0D]."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, scale: float = SCALE, repeat: float = REPEAT) -> list[float]:
    """Shares of ``scale`` times all sizes by weight; a target stops at ``repeat`` times its source's size and the
    excess is shared by weight again until none is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, rest = [0.0] * len(sizes), set(range(len(sizes))), scale * sum(sizes)
    while open_:
        total = sum(w[i] for i in sorted(open_))
        over = [i for i in sorted(open_) if rest * w[i] / total > repeat * sizes[i]]
        if not over:
            for i in open_:
                out[i] = rest * w[i] / total
            break
        for i in over:
            out[i] = repeat * sizes[i]
            open_.discard(i)
        rest = max(0.0, rest - sum(out[i] for i in over))
    return out


def _slots(size: int, target: float, block: int, key: int) -> tuple[int, int]:
    """(blocks, slots) whose words come nearest to the target."""
    n = -(-size // block)
    if not size:
        return 0, 0
    rounds = int(target // size)
    rest = target - rounds * size
    last = size - (n - 1) * block
    place = int(inverse(np.array([n - 1]), n, key, rounds)[0])  # when the short block comes
    taken = lambda m: m * block - (block - last if m > place else 0)
    near = min(range(max(0, int(rest // block) - 1), min(n, int(rest // block) + 3) + 1), key=lambda m: (abs(taken(m) - rest), m))
    return n, rounds * n + near


def _rounds(x: np.ndarray, bits: int, key: int, epoch: np.ndarray, back: bool) -> np.ndarray:
    half = np.uint64(bits // 2)
    mask = np.uint64((1 << (bits // 2)) - 1)
    left, right = x >> half, x & mask
    for r in range(5, -1, -1) if back else range(6):
        src = left if back else right
        h = (src + np.uint64(key & (2**63 - 1))) * np.uint64(0x9E3779B97F4A7C15) + epoch * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9 * (r + 1) % 2**64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        if back:
            left, right = right ^ (h & mask), left
        else:
            left, right = right, left ^ (h & mask)
    return (left << half) | right


def _walk(x: np.ndarray, n: int, key: int, epoch, back: bool) -> np.ndarray:
    """A Feistel network on the next power of four, walked until it is back below n."""
    x = np.asarray(x).astype(np.uint64)
    epoch = np.broadcast_to(np.asarray(epoch, np.uint64), x.shape)
    if n <= 1:
        return np.zeros(x.shape, np.int64)
    bits = max(2, 2 * math.ceil((n - 1).bit_length() / 2))
    out = _rounds(x, bits, key, epoch, back)
    while (far := out >= np.uint64(n)).any():
        out[far] = _rounds(out[far], bits, key, epoch[far], back)
    return out.astype(np.int64)


def permute(j: np.ndarray, n: int, key: int, epoch) -> np.ndarray:
    return _walk(j, n, key, epoch, False)


def inverse(b: np.ndarray, n: int, key: int, epoch) -> np.ndarray:
    return _walk(b, n, key, epoch, True)


def source_key(name: str | None, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(repr((name, seed)).encode(), digest_size=8).digest(), "little")


def shard_counts(quota: np.ndarray, total: int, shard: int, shard_slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in a shard, and in all shards before it: a walk down the tree of halves."""
    lo, hi = 0, -(-total // shard_slots)
    have, before = quota.copy(), np.zeros_like(quota)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = np.array(_left(seed, lo, hi, tuple(have.tolist()), (mid - lo) * shard_slots), np.int64)
        if shard < mid:
            have, hi = left, mid
        else:
            before, have, lo = before + left, have - left, mid
    return have, before


@lru_cache(maxsize=128)
def _left(seed: int, lo: int, hi: int, have: tuple[int, ...], n: int) -> list[int]:
    """The draw at one node of the tree; neighbouring shards share most of theirs."""
    return _draw(np.random.default_rng([seed, lo, hi]), np.array(have, np.int64), n).tolist()


def _draw(rng: np.random.Generator, have: np.ndarray, n: int) -> np.ndarray:
    """n slots out of ``have`` without replacement: a multinomial conditioned on the totals."""
    out, rest, todo = np.zeros_like(have), int(have.sum()), int(n)
    for i, k in enumerate(have.tolist()):
        rest -= k
        out[i] = hypergeometric(rng, k, rest, todo)
        todo -= int(out[i])
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n out of good + bad are good, for numbers of any size: one uniform number through the distribution's
    inverse. The probabilities follow from their ratios, from the mode out to 12 deviations and 40 more (all but about
    10^-30 of the mass)."""
    lo, hi, total = max(0, n - bad), min(good, n), good + bad
    if lo >= hi:
        return lo
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (total + 2)))
    reach = int(12 * math.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1)))) + 40
    up = np.arange(mode, min(hi, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(lo, mode - reach), -1, dtype=np.float64)
    rise = np.exp(np.cumsum(np.log((good - up) * (n - up) / ((up + 1) * (bad - n + up + 1)))))
    fall = np.exp(np.cumsum(np.log(down * (bad - n + down) / ((good - down + 1) * (n - down + 1)))))
    mass = np.cumsum(np.concatenate([fall[::-1], [1.0], rise]))
    return mode - len(fall) + min(int(np.searchsorted(mass, rng.random() * mass[-1], side="right")), len(mass) - 1)


class Mix:
    """A planned mix over ``docs``: ``sources``, ``pieces``, ``slots``, ``taken``, ``texts``."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED, weights=WEIGHTS, scale: float = SCALE, repeat: float = REPEAT) -> None:
        self.spark: SparkSession = docs.sparkSession
        self.block, self.shard_slots, self.seed = block_words, shard_slots, seed
        self._docs, self._names = docs, (id_col, text_col, source_col)
        own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), words(docs[text_col]).alias("size"), self._hash(docs).alias("h"))
        chunks = max(partitions(self.spark), 16)
        self._sizes = stored(own.repartitionByRange(chunks, "doc_id", "size", "h").withColumn("chunk", F.spark_partition_id()), "sizes")
        totals = self._sizes.groupBy("source").agg(F.sum("size").alias("size")).collect()  # one row a source
        named = sorted(((r["source"], r["size"]) for r in totals), key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
        goals = targets([s for _, s in named], weights, scale, repeat)
        self.sources = [Source(i, name, size, goal, *_slots(size, goal, block_words, source_key(name, seed))) for i, ((name, size), goal) in enumerate(zip(named, goals, strict=True))]

    def _hash(self, docs: DataFrame) -> Column:
        return F.xxhash64(docs[self._names[1]].cast("string"))

    def source_table(self) -> DataFrame:
        rows = [(s.index, s.name, s.size, float(s.target)) for s in self.sources]
        return self.spark.createDataFrame(rows, "source_index int, source string, source_size long, target double")

    def documents(self) -> DataFrame:
        """(doc_id, source_index, source_size, target, size, start, h): start is the document's first word in its source,
        h a hash of its text."""
        within = Window.partitionBy("chunk", "source").orderBy("doc_id", "size", "h").rowsBetween(Window.unboundedPreceding, -1)
        over = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        sums = self._sizes.groupBy("chunk", "source").agg(F.sum("size").alias("s")).select("chunk", "source", F.coalesce(F.sum("s").over(over), F.lit(0)).alias("base"))
        local = self._sizes.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
        s, t = sums.alias("s"), self.source_table().alias("t")
        joined = local.join(s, (local["chunk"] == F.col("s.chunk")) & local["source"].eqNullSafe(F.col("s.source")))
        joined = joined.join(F.broadcast(t), local["source"].eqNullSafe(F.col("t.source")))  # one row a source
        return joined.select(local["doc_id"], "source_index", "source_size", "target", local["size"], (F.col("base") + F.col("ahead")).alias("start"), local["h"])

    def pieces(self) -> DataFrame:
        """Documents cut at the block borders: block, first word within the document, number of words. A document
        without words has one row with nulls."""
        b = self.block
        first, last = F.floor(F.col("start") / b).cast("long"), F.floor((F.col("start") + F.col("size") - 1) / b).cast("long")
        each = self.documents().withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
        lo = F.greatest(F.col("start"), F.col("block") * b)
        hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b)
        return each.withColumn("word", lo - F.col("start")).withColumn("n", hi - lo)

    def slots(self) -> DataFrame:
        """(shard, slot, source_index, block, epoch): the whole mix by numbers."""
        quota = np.array([s.slots for s in self.sources], np.int64)
        blocks, keys = [s.blocks for s in self.sources], [source_key(s.name, self.seed) for s in self.sources]
        total, per, seed = int(quota.sum()), self.shard_slots, self.seed
        shards = -(-total // per)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    count, before = shard_counts(quota, total, shard, per, seed)
                    src = np.repeat(np.arange(len(count)), count)
                    j = np.concatenate([np.arange(a, a + c) for a, c in zip(before, count, strict=True)]) if len(count) else np.zeros(0, np.int64)
                    block, epoch = np.zeros(len(j), np.int64), np.zeros(len(j), np.int64)
                    for i in np.flatnonzero(count):
                        own = src == i
                        epoch[own] = j[own] // blocks[i]
                        block[own] = permute(j[own] % blocks[i], blocks[i], keys[i], epoch[own])
                    order = np.random.default_rng([seed, shard, 1]).permutation(len(j))  # sources interleave
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), shard)), pa.array(np.arange(len(j))), pa.array(src[order].astype(np.int32)), pa.array(block[order]), pa.array(epoch[order].astype(np.int32))], names=["shard", "slot", "source_index", "block", "epoch"])

        # the planner's size of this table is that of the range: joins with it carry a hint, lest it be broadcast
        n = max(1, min(partitions(self.spark), shards))
        return in_batches(self.spark.range(0, shards, 1, n), run, "shard long, slot long, source_index int, block long, epoch int")

    def drawn(self) -> DataFrame:
        """Pieces with the slots that read them: blocks joined by index."""
        return self.pieces().join(self.slots().hint("merge"), ["source_index", "block"])

    def taken(self) -> DataFrame:
        """One row a document: doc_id, size, source_size, target, taken."""
        uses = self.slots().groupBy("source_index", "block").agg(F.count("*").alias("times"))
        joined = self.pieces().join(uses.hint("merge"), ["source_index", "block"], "left")
        by = ["doc_id", "source_index", "start", "size", "source_size", "target"]
        whole = joined.where("size > 0").groupBy(*by).agg(F.sum(F.col("n") * F.coalesce("times", F.lit(0))).cast("long").alias("taken")).drop("start")
        empty = self.documents().where("size = 0").select(*[c for c in by if c != "start"], F.lit(0).cast("long").alias("taken"))
        return whole.unionByName(empty).select("doc_id", "size", "source_size", "target", "taken")

    def texts(self) -> DataFrame:
        """The documents as the mix takes them: a row for each time that the mix goes through a document, its text the
        words drawn in that round (the text itself if all are). Documents not drawn have no row. Rows that share an id
        (or have none) are documents of their own: they are told apart by source, text and number."""
        id_col, text_col, source_col = self._names
        by = ["doc_id", "source_index", "h", "start"]
        rounds = self.drawn().groupBy(*by, "epoch", "size").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("cut"))
        cut = rounds.select(*by, F.when(F.aggregate("cut", F.lit(0).cast("long"), lambda a, x: a + x["n"]) < F.col("size"), F.col("cut")).alias("__cut"))
        docs = self._docs
        columns = docs.columns
        if self._sizes.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
            joined = docs.join(cut.select(F.col("doc_id").alias("__id"), "__cut").hint("merge"), docs[id_col] == F.col("__id"))
        else:
            number = F.dense_rank().over(Window.partitionBy("doc_id", "source_index", "h").orderBy("start"))
            names = self.source_table().select("source_index", F.col("source").alias("__source"))
            right = cut.withColumn("__copy", number).join(F.broadcast(names), "source_index").select(F.col("doc_id").alias("__id"), "__source", F.col("h").alias("__h"), "__copy", "__cut")
            keys = [docs[id_col].cast("long"), docs[source_col].cast("string"), self._hash(docs)]
            left = docs.withColumn("__hash", keys[2]).withColumn("__number", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))))
            same = left[id_col].cast("long").eqNullSafe(F.col("__id")) & left[source_col].cast("string").eqNullSafe(F.col("__source"))
            joined = left.join(right.hint("merge"), same & (F.col("__hash") == F.col("__h")) & (F.col("__number") == F.col("__copy")))
        split = F.filter(F.split(F.col(text_col), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
        drawn_words = F.flatten(F.transform("__cut", lambda c: F.slice("__words", (c["word"] + 1).cast("int"), c["n"].cast("int"))))
        part = joined.withColumn("__words", F.when(F.col("__cut").isNotNull(), split))
        out = part.withColumn(text_col, F.when(F.col("__cut").isNull(), F.col(text_col)).otherwise(F.array_join(drawn_words, " ")))
        return out.select(*columns)


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken.

    Null text has size 0 and is never taken; null sources are one source, the last. Rows repeated with one id are
    documents of their own, null ids come first. An empty table gives an empty result. Other columns are ignored. The same rows give
    the same mix, however they are partitioned.
    """
    return Mix(docs, **options).taken()
