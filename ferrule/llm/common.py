"""Shared storage, text batches and vectorised word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Unset, a local session gets a temporary one; anywhere else that is an error, as no other folder is known
    to be shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="ferrule-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/ferrule-{what}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def stored(df: DataFrame, what: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, lost executors cost a reread."""
    spark = df.sparkSession
    path = new_path(spark, what)
    writer = df.write
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def removed(spark: SparkSession, path: str) -> None:
    """Deletes what ``new_path`` named, once nothing reads it any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` has written, once nothing reads them any more."""
    for t in tables:
        removed(t.sparkSession, t.stored_at)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Run) -> Run:
    """``run`` for mapInArrow, after which the worker gives freed memory back: it is kept idle beside later stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
            trim(0)

    return wrapped


#: Bytes of a batch that Spark hands to a Python worker, about; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def in_batches(df: DataFrame, run: Run, ddl: str) -> DataFrame:
    """``df.mapInArrow`` with ``run`` made tidy, in batches of about BATCH_BYTES: both sides of the pipe hold a batch, and
    Spark's own limits are 10,000 rows and 64 MB.

    Spark reads the limit when the job runs, so it is set in the session and stays there; one that is lower is kept.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(tidy(run), ddl)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; a longer text is a slice of its own."""
    n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    if not len(n):
        return
    group = (np.cumsum(n) - n) // limit
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(n)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the n + 1 offsets. Null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    texts = pa.concat_arrays([texts])
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


#: [\x20\x09-\x0D]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
#: Words of more bytes are hashed one by one.
LONG_WORD = 192


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of non-space bytes, none crossing a text; and words before each text."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    solid = ~SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = off[:-1][(off[:-1] < len(raw))]
    first[inner] |= solid[inner]
    cut = inner[inner > 0]
    last[cut - 1] |= solid[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``raw`` on as one word; zeros follow the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray(len(raw) + 1, np.uint64, padded.data, strides=(1,))


#: The first k bytes of a word of eight.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, its length included: eight bytes a step."""
    n = ends - starts
    h = n.astype(np.uint64) * _Q
    if not len(n):
        return h
    words = eights(raw)
    h ^= words[starts] & FIRST[np.minimum(n, 8)]
    h *= _P
    h ^= h >> np.uint64(29)
    rest = np.flatnonzero((n > 8) & (n <= LONG_WORD))
    at, left = starts[rest] + 8, n[rest] - 8
    while len(rest):
        v = h[rest] ^ (words[at] & FIRST[np.minimum(left, 8)])
        v *= _P
        v ^= v >> np.uint64(29)
        h[rest] = v
        on = left > 8
        rest, at, left = rest[on], at[on] + 8, left[on] - 8
    for k in np.flatnonzero(n > LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]].tobytes())
    return mix(h)


def same_spans(raw: np.ndarray, starts: np.ndarray, other: np.ndarray, at: np.ndarray, n: np.ndarray) -> bool:
    """Whether n bytes from each start are those of ``other`` at the places ``at``."""
    a, b = eights(raw), eights(other)
    while len(n):
        if ((a[starts] ^ b[at]) & FIRST[np.minimum(n, 8)]).any():
            return False
        on = n > 8
        if on.all() and len(n) < 64:  # a few long ones
            return all(np.array_equal(raw[s : s + k], other[t : t + k]) for s, t, k in zip(starts.tolist(), at.tolist(), n.tolist(), strict=True))
        starts, at, n = starts[on] + 8, at[on] + 8, n[on] - 8
    return True


def shingles(words: np.ndarray, before: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of runs of ``width`` words of each text, and n + 1 offsets.

    A text of fewer words has its whole sequence as one shingle; a text without words has none.
    """
    out, sizes = [], np.zeros(len(before), np.int64)
    if len(words) >= width:
        roll = words[: len(words) - width + 1].copy()
        for j in range(1, width):
            roll = roll * _P + words[j : len(words) - width + 1 + j]
        roll = mix(roll)
    else:
        roll = words[:0]
    for i in range(len(before) - 1):
        a, b = int(before[i]), int(before[i + 1])
        if b - a >= width:
            v = np.unique(roll[a : b - width + 1])
        elif b > a:
            v = np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes(), seed=b - a)], np.uint64)
        else:
            v = words[:0]
        out.append(v)
        sizes[i + 1] = len(v)
    return (np.concatenate(out) if out else words[:0]), np.cumsum(sizes)
