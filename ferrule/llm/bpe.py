"""Byte-level BPE encoding and decoding as a reduction over a monoid.

A text is a sequence of segments; the ids of two neighbouring segments join into the ids of both. ``encode``
splits a text in halves down to leaves, encodes these alone, and joins up the tree; ``join`` re-encodes a
window around the seam only. Decoding concatenates up the same kind of tree.

Why a window is enough. The split pattern has places where a match always ends, whatever stands around them:
between a non-space and a white-space character (white space only ever starts a match or is all of it), between
a letter and a non-letter that follows it, between a digit and a non-digit that follows it. (Only places with
an ASCII character on the right, and for the last two on the left, are used, so no Unicode version matters.)
A match that ends at such a place does not look past it, and what follows one depends on the text to its right
alone. So tokens left of the last such place before the seam, and right of the first one after it, are those of
the whole text. The window grows, doubling, until it has both; in a text without such places it becomes the
whole of both segments, which is right as well.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from ferrule.llm.common import in_batches, text_slices

#: Such places of the known pattern; another pattern needs its own.
SETTLED = re.compile(r"(?<=[A-Za-z])(?=[\x00-\x7f])(?![A-Za-z])|(?<=[0-9])(?=[\x00-\x7f])(?![0-9])|(?<=\S)(?=[ \t\n\r])")
LEAF_CHARS = 4096
LEAF_IDS = 4096


class TreeBpe:
    """``encode``/``decode`` by tree reduction. ``leaf`` gives the ids of a short text encoded alone."""

    def __init__(self, leaf: Callable[[str], list[int]], token: Callable[[int], bytes], leaf_chars: int = LEAF_CHARS, window: int = 32, settled: re.Pattern = SETTLED) -> None:
        self._leaf, self._token, self._size, self._window, self._settled = leaf, token, max(1, leaf_chars), max(1, window), settled

    def encode(self, text: str) -> list[int]:
        return self._tree(text, 0, len(text))

    def _tree(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self._size:
            return self._leaf(text[lo:hi])
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self._tree(text, lo, mid), self._tree(text, mid, hi))

    def join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of text[lo:hi] from those of text[lo:mid] and text[mid:hi]."""
        w = self._window
        while True:
            a, b = max(lo, mid - w), min(hi, mid + w)
            p = q = None
            for m in self._settled.finditer(text, a, min(mid + 1, hi)):
                if lo < m.start() <= mid:
                    p = m.start()
            if p == mid:
                return left + right
            if m := self._settled.search(text, mid, min(b + 1, hi)):
                q = m.start()
            if p is None and a == lo:
                p = lo
            if q is None and b == hi:
                q = hi
            if p is not None and q is not None:
                break
            w *= 2
        keep, drop = self._last(left, len(text[p:mid].encode())), self._first(right, len(text[mid:q].encode()))
        return left[:keep] + self._leaf(text[p:q]) + right[drop:]

    def _last(self, ids: list[int], n: int) -> int:
        """Ids before the last ``n`` bytes."""
        k = len(ids)
        while n > 0:
            k -= 1
            n -= len(self._token(ids[k]))
        assert n == 0, "a token crosses a settled place"
        return k

    def _first(self, ids: list[int], n: int) -> int:
        k = 0
        while n > 0:
            n -= len(self._token(ids[k]))
            k += 1
        assert n == 0, "a token crosses a settled place"
        return k

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self._token, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(maxsize=4)
def load(path: str, pattern: str, leaf_chars: int = LEAF_CHARS, settled: str | None = None) -> TreeBpe:
    """The codec of a rank file; one for each worker process. ``settled`` matches (without width) places where a match of
    ``pattern`` always ends; it is known for the vocabularies' own pattern alone."""
    import tiktoken

    if settled is None and pattern != public_tokenizers.PATTERN:
        raise ValueError("give the places where a match of this pattern always ends")

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    return TreeBpe(enc.encode_ordinary, tokens.__getitem__, leaf_chars, settled=re.compile(settled) if settled else SETTLED)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS, keep_ids: bool = True, settled: str | None = None) -> DataFrame:
    """Each document with its ids (unless ``keep_ids`` is false), their digest and that of the decoded bytes.

    Columns: id_col, n_tokens long, ids_sha256 string (ids as little-endian unsigned 32-bit integers),
    decoded_sha256 string, ids array<int>. Null and empty texts have no ids; null ids of documents stay null; ``settled``: see load. Every row gives one row, repeated
    ones too; other columns are ignored. One pass, no shuffle; memory holds one text and its ids.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        fields.append(("ids", pa.list_(pa.int32())))
        ddl += ", ids array<int>"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path, pattern, leaf_chars, settled)
        for batch in batches:
            for part in text_slices(batch, limit=1 << 20):
                n, first, second, kept = [], [], [], []
                for text in part.column(1).to_pylist():
                    ids = codec.encode(text or "")
                    n.append(len(ids))
                    first.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                    second.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                    if keep_ids:
                        kept.append(ids)
                cols = [part.column(0), n, first, second] + ([kept] if keep_ids else [])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, list) else c.cast(t) for c, (_, t) in zip(cols, fields, strict=True)], schema=schema)

    out = in_batches(own, run, ddl)
    return out.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else out
