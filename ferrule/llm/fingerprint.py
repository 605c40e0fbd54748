"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph (a line) is hashed into a wide vector; a document's fingerprint is the sum of its paragraphs' vectors,
lane by lane, modulo a power of two. So it does not depend on their order, and a paragraph is inserted or deleted
by adding or subtracting its vector. The vector has two parts:

* ``ID_LANES`` lanes modulo 2^64, the digest of the paragraph's bytes: equality of multisets of paragraphs;
* ``LIKE_LANES`` lanes modulo 2^32: each feature of the paragraph adds +1 or -1 to one lane. A feature is a word with
  the two before it in the paragraph; the k-th of equal features in a paragraph is a feature of its own. A word of more than ``LONG`` bytes (text without
  spaces) counts as a row of pieces, cut where its content says so.

Likeness is the share of features in common (twice those over the sum of both). A lane that k features meet is a sum of k
signs, whose mean absolute value over all lanes tells k; so the lanes of two fingerprints and of their difference give
both numbers of features and that of those that differ. Absolute values, not squares: a paragraph that one text repeats
many times sets a few lanes far apart and does not outweigh the others.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import LOWER, hash_spans, mix, partitions, word_spans

ID_LANES, LIKE_LANES = 8, 256
ROWS_PER_SHARD, MOST_SHARDS = 1024, 20_000
#: Rows whose ids are looked at, a shard, for even shards; results do not depend on them.
LOOKED_AT = 20
#: A piece of a longer word has 4 characters on average; one of more than PIECE bytes is cut every 16 characters.
LONG, PIECE = 48, 64
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


class Fingerprints:
    """Fingerprints of some documents: ``ident`` uint64 (n, ID_LANES), ``like`` uint32 (n, LIKE_LANES)."""

    def __init__(self, ident: np.ndarray, like: np.ndarray) -> None:
        self.ident, self.like = ident, like

    def __add__(self, other: "Fingerprints") -> "Fingerprints":
        return Fingerprints(self.ident + other.ident, self.like + other.like)

    def __sub__(self, other: "Fingerprints") -> "Fingerprints":
        return Fingerprints(self.ident - other.ident, self.like - other.like)

    def strings(self) -> list[str]:
        return [base64.b64encode(a.astype("<u8").tobytes() + b.astype("<u4").tobytes()).decode() for a, b in zip(self.ident, self.like, strict=True)]

    def take(self, rows) -> "Fingerprints":
        return Fingerprints(self.ident[rows], self.like[rows])


def parse(strings: list[str]) -> Fingerprints:
    raw = [base64.b64decode(s) for s in strings]
    cut = 8 * ID_LANES
    return Fingerprints(np.array([np.frombuffer(r[:cut], "<u8") for r in raw], np.uint64).reshape(-1, ID_LANES), np.array([np.frombuffer(r[cut:], "<u4") for r in raw], np.uint32).reshape(-1, LIKE_LANES))


@lru_cache(maxsize=1)
def _signs() -> tuple[np.ndarray, np.ndarray]:
    """Mean absolute values of sums of a Poisson number of signs, by the mean of that number."""
    mean = np.concatenate([np.linspace(0, 1, 101), np.geomspace(1.02, 1e4, 500)])
    angle = (np.arange(6000) + 0.5) * (np.pi / 6000)
    value = mean * np.array([(np.exp(m * (np.cos(angle) - 1)) * (1 + np.cos(angle))).mean() for m in mean])
    return value, mean


def _features(lanes: np.ndarray) -> np.ndarray:
    """Features a lane of each row, from its mean absolute value."""
    v = np.abs(lanes.view(np.int32).astype(np.float64)).mean(1)
    value, mean = _signs()
    return np.where(v < value[-1], np.interp(v, value, mean), v * v * (np.pi / 2))


def likeness(a: Fingerprints, b: Fingerprints) -> np.ndarray:
    """Estimated share of features in common, 0 to 1; 1 where the fingerprints are equal."""
    total = _features(a.like) + _features(b.like)
    near = np.where(total > 0, 1 - _features(a.like - b.like) / np.where(total > 0, total, 1), 0.0)
    return np.where((a.ident == b.ident).all(1) & (a.like == b.like).all(1), 1.0, np.clip(near, 0.0, 1.0))


def pieces(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans, those of more than LONG bytes cut before characters that follow certain four bytes of the span."""
    new_starts, new_ends = [], []
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        word = raw[starts[k] : ends[k]]
        first = (word & 0xC0) != 0x80  # of a character
        u = word.astype(np.uint64)
        h = np.zeros(len(word), np.uint64)
        h[4:] = mix(u[:-4] << np.uint64(24) | u[1:-3] << np.uint64(16) | u[2:-2] << np.uint64(8) | u[3:-1])
        cut = first & (h & np.uint64(3) == 1)
        cut[:4] = False
        cut[0] = True
        at = np.append(np.flatnonzero(cut), len(word))
        for i in np.flatnonzero(np.diff(at) > PIECE).tolist():
            chars = np.flatnonzero(first[at[i] : at[i + 1]])
            cut[at[i] + chars[::16]] = True
        at = np.flatnonzero(cut) + starts[k]
        new_starts.append(at)
        new_ends.append(np.append(at[1:], ends[k]))
    if not new_starts:
        return starts, ends
    short = ends - starts <= LONG
    return np.sort(np.concatenate([starts[short], *new_starts])), np.sort(np.concatenate([ends[short], *new_ends]))


def _word_features(raw: np.ndarray, off: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words with the two before them, and their paragraphs (which begin at ``first``)."""
    starts, ends, _ = word_spans(raw, off)
    starts, ends = pieces(raw, starts, ends)
    w = hash_spans(raw, starts, ends)
    line = np.searchsorted(first, starts, side="right") - 1
    one, two = np.zeros_like(w), np.zeros_like(w)
    same = line[1:] == line[:-1]
    one[1:] = np.where(same, w[:-1], 0)
    two[2:] = np.where(same[1:] & same[:-1], w[:-2], 0)
    return mix((w * _A + one) * _B + two), line


def fingerprints(texts: list[str]) -> Fingerprints:
    """Of whole texts; an empty text is one empty paragraph."""
    n = len(texts)
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
    digests, counts = [], np.zeros(n, np.int64)
    for i, r in enumerate(raws):
        lines = r.split(b"\n")
        counts[i] = len(lines)
        digests += [hashlib.blake2b(x, digest_size=8 * ID_LANES).digest() for x in lines]
    vectors = np.frombuffer(b"".join(digests), "<u8").reshape(-1, ID_LANES)
    ident = np.add.reduceat(vectors, np.cumsum(counts) - counts, axis=0) if n else vectors
    raw = np.frombuffer(b"".join(raws), np.uint8)
    like = np.zeros((n, LIKE_LANES), np.uint32)
    if len(raw):
        raw = LOWER[raw]
        first = np.unique(np.concatenate([[0], np.flatnonzero(raw == 10) + 1, off[1:-1]]))  # where paragraphs begin
        f, line = _word_features(raw, off, first)
        order = np.lexsort((f, line))
        f, line = f[order], line[order]
        fresh = np.ones(len(f), bool)
        fresh[1:] = (f[1:] != f[:-1]) | (line[1:] != line[:-1])
        at = np.arange(len(f))
        f = mix(f + (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64) * _A)
        doc = np.searchsorted(off, first[line], side="right") - 1
        lane = doc * LIKE_LANES + (f & np.uint64(LIKE_LANES - 1)).astype(np.int64)
        sums = np.bincount(lane, weights=np.where(f >> np.uint64(63), 1.0, -1.0), minlength=n * LIKE_LANES)
        like = sums.astype(np.int64).astype(np.uint32).reshape(n, LIKE_LANES)
    return Fingerprints(ident.astype(np.uint64), like)


_PAIR = np.dtype([("id", np.int64), ("h", np.int64)])


def _pairs(ids, hashes) -> np.ndarray:
    out = np.zeros(len(ids), _PAIR)
    out["id"], out["h"] = ids, hashes
    return out


def with_next(docs: DataFrame, rows_per_shard: int | None = None) -> DataFrame:
    """Rows (shard, peek, doc_id, h, text) dealt so that each task holds a range of (doc_id, h) and the row below it.

    Shards are ranges between rows of a bounded look at the ids. The largest row of a shard is sent to the next shard above
    as well, as the one to peek at, and the largest of all to the lowest shard. Texts move once. A null id is less
    than any other.
    """
    spark = docs.sparkSession
    n = docs.count()
    keys = docs.select("doc_id", "h")
    shards = max(1, min(MOST_SHARDS, n // (rows_per_shard or ROWS_PER_SHARD)))
    part = min(1.0, LOOKED_AT * shards / max(1, n))
    looked = keys.where((F.pmod(F.xxhash64("doc_id", "h"), F.lit(1 << 20)) < part * (1 << 20)) & F.col("doc_id").isNotNull()).distinct().collect()  # about LOOKED_AT rows a shard
    seen = np.sort(_pairs([r[0] for r in looked], [r[1] for r in looked]), order=("id", "h"))
    bounds = np.unique(seen[np.linspace(0, len(seen), shards + 1).astype(int)[1:-1]]) if len(seen) else seen

    def placed(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        v = _pairs(ids.fillna(-(2**63)).astype(np.int64), np.where(ids.isna(), -(2**63), hashes))
        return pd.Series(np.searchsorted(bounds, v).astype(np.int32))

    sharded = docs.withColumn("shard", F.pandas_udf(placed, "int")("doc_id", "h"))
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")
    tops = sorted(sharded.groupBy("shard").agg(F.max(key).alias("top")).select("shard", "top.doc_id", "top.h").collect())  # one row a shard
    above = [(s, i, h, tops[(k + 1) % len(tops)][0]) for k, (s, i, h) in enumerate(tops)]
    peeked = spark.createDataFrame(above, "of int, top_id long, top_h long, above int")
    marked = sharded.join(F.broadcast(peeked), (F.col("shard") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top_id")) & (F.col("h") == F.col("top_h")), "left")
    places = F.when(F.col("above").isNull(), F.array("shard")).otherwise(F.array("shard", "above"))
    dealt = marked.select(F.posexplode(places).alias("peek", "shard"), "doc_id", "h", "text")
    order = ["shard", "peek", F.col("doc_id").desc_nulls_last(), F.col("h").desc(), F.col("text").desc()]
    n = max(partitions(spark), -(-len(tops) // 4))
    place = F.floor(F.col("shard") * n / (len(bounds) + 1)).cast("int")  # neighbouring shards, so that tasks are even
    return dealt.repartitionById(n, place).sortWithinPartitions(*order)


def edited(text: str, following: str) -> str:
    """The last third gives way to the first as many code points of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one of the next smaller id; after the smallest comes the largest. Rows of one id
    follow each other in the order of a hash of their texts. Null texts count as empty; null ids come after the smallest
    id; a single document follows itself. Other columns are ignored; an empty table gives an empty result.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("h", F.when(F.col("doc_id").isNull(), -(2**63)).otherwise(F.xxhash64("text")))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def block(ids: list[int], texts: list[str]) -> pa.RecordBatch:
        """All but the last text, whose only use is to follow."""
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        own_f = fingerprints(texts)
        new_f = fingerprints(changed)
        head, tail = own_f.take(slice(0, -1)), own_f.take(slice(1, None))
        cols = [ids, [len(t) for t in texts[:-1]], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], head.strings(), new_f.strings(), likeness(head, new_f), likeness(head, tail)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, texts, size, done = None, [], [], 0, False
        for batch in batches:
            for s, p, i, t in zip(*(batch.column(c).to_pylist() for c in ("shard", "peek", "doc_id", "text")), strict=True):
                if s != shard:
                    shard, ids, texts, size, done = s, [], [], 0, False
                if done:
                    continue
                texts.append(t)
                size += len(t)
                if p:  # the row after the shard's last
                    done = True
                    if len(texts) > 1:
                        yield block(ids, texts)
                    continue
                if size >= 1 << 20 and len(texts) > 1:
                    yield block(ids, texts)
                    ids, texts, size = [], [t], len(t)
                ids.append(i)

    return with_next(own).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
