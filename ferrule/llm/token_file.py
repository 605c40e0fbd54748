"""Token ids on disk as entropy-shaped wavelet matrices.

A shard holds the ids of consecutive documents as one wavelet matrix whose shape is that of a Huffman code of its ids: an
id of code length L has a bit in the first L planes alone, so the planes hold about the ids' entropy. Each plane
stably moves the ids with a 0 before those with a 1. Codes are dealt so that at each plane the codes that end come
last: the ids that go on are a prefix, and no place needs a correction. With a count of ones for each block of BLOCK bits
a plane answers rank, and by search over these counts select; so access to any range of ids, counting, and the place
of an occurrence need one step a plane, from the file as it is. ``Shard`` takes bytes or a memory map; to read one
document it touches the document's end and, a plane, the blocks of its ids. The bytes of a shard are one row of a
Parquet table in the shared folder, whose committer drops what a lost executor left unfinished.

Layout, little-endian, each part padded to 8 bytes: magic ``WMX2``, planes u32, ids u64, documents u64, distinct ids u64;
document ids i64[]; whether these are null u8[]; ends of documents u64[]; codes that end at each plane u32[]; distinct
ids in the order of their codes u32[], how often each u32[]; for each plane zeros u64, bits packed low first in whole
blocks, ones before each block u32[].
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import LOWER, hash_spans, partitions, same_spans, stored, text_buffer, text_slices, tidy, word_spans

MAGIC, BLOCK = b"WMX2", 512
SHARD_TOKENS = 2 << 20
ROWS_PER_TASK = 8192
#: Ids read back at a time.
SPAN = 1 << 19
END = 2
_ONE = np.uint64(1)
#: Words that one worker remembers (about 100 bytes each).
CACHE_WORDS = 600_000
#: a-z; and ASCII punctuation other than an apostrophe.
LETTER, MARK = np.zeros(256, bool), np.zeros(256, bool)
LETTER[97:123] = True
MARK[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = True


def _pad(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 8)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths of positive counts in descending order, ascending; at least 1. Counts are lifted to
    1 / 65536 of their sum, so that no code is longer than 32."""
    w = np.maximum(counts, -(-int(counts.sum()) >> 16)).tolist()[::-1]
    m = len(w)
    if m < 2:
        return np.ones(m, np.int64)
    parent = [0] * (2 * m - 1)
    leaf, inner = 0, m  # two queues: leaves by weight, and inner nodes, which come in the order of theirs
    for new in range(m, 2 * m - 1):
        total = 0
        for _ in (0, 1):
            if leaf < m and (inner >= new or w[leaf] <= w[inner]):
                k, leaf = leaf, leaf + 1
            else:
                k, inner = inner, inner + 1
            parent[k] = new
            total += w[k]
        w.append(total)
    depth = [0] * (2 * m - 1)
    for k in range(2 * m - 3, -1, -1):
        depth[k] = depth[parent[k]] + 1
    return np.sort(np.array(depth[:m], np.int64))


def codes(ending: np.ndarray) -> np.ndarray:
    """Codes, aligned to the left of ``len(ending)`` bits, of the leaves by plane; ``ending``: leaves at each plane."""
    out, inner = [], np.zeros(1, np.uint32)
    for k, leaves in enumerate(ending.tolist()):
        bit = np.uint32(1 << (len(ending) - 1 - k))
        nodes = np.concatenate([inner, inner | bit])
        cut = len(nodes) - leaves
        out.append(nodes[cut:])
        inner = nodes[:cut]
    return np.concatenate(out) if out else inner[:0]


def build(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, null_ids: np.ndarray | None = None) -> bytes:
    """A shard's bytes."""
    n = len(ids)
    counts = np.bincount(ids) if n else np.zeros(0, np.int64)
    by = np.flatnonzero(counts)
    by = by[np.argsort(-counts[by], kind="stable")]
    sizes = code_lengths(counts[by])
    planes = int(sizes[-1]) if n else 0
    ending = np.bincount(sizes, minlength=planes + 1)[1:] if n else np.zeros(0, np.int64)
    code = np.zeros(len(counts), np.uint32)
    code[by] = codes(ending)
    x = code[ids] if n else code
    null = np.zeros(len(doc_ids), np.uint8) if null_ids is None else null_ids.astype(np.uint8)
    out = [MAGIC, struct.pack("<IQQQ", planes, n, len(doc_ids), len(by))]
    out += [_pad(a.tobytes()) for a in (np.asarray(doc_ids, "<i8"), null, np.cumsum(lengths).astype("<u8"), ending.astype("<u4"), by.astype("<u4"), counts[by].astype("<u4"))]
    done = np.searchsorted(sizes, np.arange(1, planes + 1), side="right")  # codes of at most so many bits
    gone = np.concatenate([[0], np.cumsum(counts[by])])[done]
    for k in range(planes):
        one = ((x >> np.uint32(planes - 1 - k)) & np.uint32(1)).astype(bool)
        zero = ~one
        packed = np.zeros(-(-len(x) // BLOCK) * BLOCK // 8, np.uint8)
        p = np.packbits(one, bitorder="little")
        packed[: len(p)] = p
        ones = np.bitwise_count(packed.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32)
        left = np.compress(zero, x)
        out += [struct.pack("<Q", len(left)), packed.tobytes(), _pad((np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4").tobytes())]
        x = np.concatenate([left, np.compress(one, x)])[: n - gone[k]]
    return b"".join(out)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges in a row."""
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(at))
    return at


class Shard:
    """A shard read from its bytes or a memory map of them; nothing is decoded ahead of use."""

    def __init__(self, data) -> None:
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a shard file")
        self.planes, self.n, docs, distinct = struct.unpack_from("<IQQQ", data, 4)
        at = 32

        def part(kind: str, count: int) -> np.ndarray:
            nonlocal at
            v = np.frombuffer(data, kind, count, at)
            at += -(-v.nbytes // 8) * 8
            return v

        self.doc_ids, self.null_ids, self.ends = part("<i8", docs), part("u1", docs), part("<u8", docs)
        self._ending, self._symbols, self._counts = part("<u4", self.planes).astype(np.int64), part("<u4", distinct), part("<u4", distinct)
        self._zeros, self._words, self._ones, self._sizes, self._cum, self._tails = [], [], [], [self.n], {}, {}
        leaves = np.cumsum(self._ending)
        gone = np.concatenate([[0], np.cumsum(self._counts, dtype=np.int64)])
        for k in range(self.planes):
            blocks = -(-self._sizes[k] // BLOCK)
            self._zeros.append(int(part("<u8", 1)[0]))
            self._words.append(part("<u8", blocks * BLOCK // 64))
            self._ones.append(part("<u4", blocks))
            self._sizes.append(self.n - int(gone[leaves[k]]))
        self._first = leaves - self._ending  # of the leaves that end at a plane
        self._code: np.ndarray | None = None

    def __len__(self) -> int:
        return self.n

    def _before(self, k: int, word: np.ndarray) -> np.ndarray:
        """Ones of plane k before each of some 64-bit words."""
        words = self._words[k]
        if k not in self._cum and 8 * len(word) > len(words):  # many places: the counts before all words, once
            ones = np.bitwise_count(words)
            self._cum[k] = np.cumsum(ones, dtype=np.int64) - ones
        if k in self._cum:
            return self._cum[k][word]
        block = word // (BLOCK // 64)
        near = (block * (BLOCK // 64))[:, None] + np.arange(BLOCK // 64)
        return self._ones[k][block] + np.where(near < word[:, None], np.bitwise_count(words[near]), 0).sum(axis=1, dtype=np.int64)

    def _rank1(self, k: int, i: int) -> int:
        """Ones among the first i bits of plane k."""
        if not i:
            return 0
        word, bits = (i - 1) >> 6, (i - 1) & 63
        return int(self._before(k, np.array([word]))[0]) + (int(self._words[k][word]) & ((2 << bits) - 1)).bit_count()

    def _select(self, k: int, bit: int, j: int) -> int:
        """The place of the j-th (from 0) bit of that value in plane k."""
        ones = self._ones[k].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        at = int(np.searchsorted(before, j, side="right")) - 1
        j -= int(before[at])
        bits = np.unpackbits(self._words[k][at * (BLOCK // 64) : (at + 1) * (BLOCK // 64)].view(np.uint8), bitorder="little")
        return at * BLOCK + int(np.flatnonzero(bits == bit)[j])

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The ids from place lo to before place hi.

        Places of one range are two ranges a plane further on, by the ranks of its ends; ranges that touch are one. The
        way back up puts the ids where the planes' bits took them from.
        """
        hi = self.n if hi is None else hi
        if not 0 <= lo <= hi <= self.n:
            raise IndexError((lo, hi))
        starts, sizes = np.array([lo]), np.array([hi - lo])
        down: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(self.planes):
            if not sizes.any():
                break
            one = self._read(k, starts, sizes)
            before = self._ranks(k, starts)
            ones = np.add.reduceat(one, np.cumsum(sizes) - sizes, dtype=np.int64)
            starts, sizes = np.concatenate([starts - before, self._zeros[k] + before]), np.concatenate([sizes - ones, ones])
            on = np.clip(self._sizes[k + 1] - starts, 0, sizes)  # places of codes that do not end here, always first
            last = np.flatnonzero(sizes > on)
            ended = self._ended(k, _spread(np.maximum(starts[last] - self._sizes[k + 1], 0), (sizes - on)[last])) if len(last) else self._symbols[:0]
            down.append((one, ended))
            some = np.flatnonzero(on)
            starts, sizes = starts[some], on[some]
            if len(some) > 1:
                new = np.flatnonzero(np.concatenate([[True], starts[1:] != starts[:-1] + sizes[:-1]]))
                starts, sizes = starts[new], np.add.reduceat(sizes, new)
        out = np.zeros(0, np.uint32)
        while down:
            one, ended = down.pop()
            out = np.concatenate([out, ended])
            at = np.flatnonzero(one == 0)
            own = np.empty(len(one), np.uint32)
            own[at] = out[: len(at)]
            own[np.flatnonzero(one)] = out[len(at) :]
            out = own
        return out

    def _read(self, k: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The bits of ranges of plane k in a row, as truth values."""
        words = self._words[k]
        if len(starts) == 1:
            a, b = int(starts[0]), int(starts[0] + sizes[0])
            return np.unpackbits(words[a >> 6 : (b + 63) >> 6].view(np.uint8), bitorder="little")[a & 63 :][: b - a].view(bool)
        at = _spread(starts, sizes)
        if 8 * len(at) > self._sizes[k]:
            return np.unpackbits(words.view(np.uint8), bitorder="little")[at].view(bool)
        return ((words[at >> 6] >> (at & 63).astype(np.uint64)) & _ONE).astype(bool)

    def _ranks(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones before each of some places of plane k."""
        word = at >> 6
        return self._before(k, word) + np.bitwise_count(self._words[k][word] & ((_ONE << (at & 63).astype(np.uint64)) - _ONE))

    def _ended(self, k: int, place: np.ndarray) -> np.ndarray:
        """The ids at places among those whose codes end at plane k."""
        a = self._first[k]
        symbols, counts = self._symbols[a : a + self._ending[k]], self._counts[a : a + self._ending[k]]
        if k not in self._tails and 8 * len(place) > self._sizes[k] - self._sizes[k + 1]:
            self._tails[k] = np.repeat(symbols, counts)
        if k in self._tails:
            return self._tails[k][place]
        return symbols[np.searchsorted(np.cumsum(counts, dtype=np.int64), place, side="right")]

    def access(self, i: int) -> int:
        """The i-th id."""
        return int(self.ids(i, i + 1)[0])

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document; the rest stays unread."""
        return self.ids(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))

    def _bits(self, token: int) -> list[int] | None:
        where = np.flatnonzero(self._symbols == token)
        if not len(where):
            return None
        if self._code is None:
            self._code = codes(self._ending)
        code, size = int(self._code[where[0]]), int(np.searchsorted(self._first, where[0], side="right"))
        return [code >> (self.planes - 1 - k) & 1 for k in range(size)]

    def _range(self, bits: list[int], i: int) -> tuple[int, int]:
        """Where the first i ids' occurrences of a code are after its last plane."""
        lo, hi = 0, i
        for k, b in enumerate(bits):
            x, y = self._rank1(k, lo), self._rank1(k, hi)
            lo, hi = (self._zeros[k] + x, self._zeros[k] + y) if b else (lo - x, hi - y)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """How often a token is among the first i ids."""
        bits = self._bits(token)
        if bits is None:
            return 0
        lo, hi = self._range(bits, i)
        return hi - lo

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        return self.rank(token, self.n if hi is None else hi) - self.rank(token, lo)

    def select(self, token: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of a token: up the planes of its code."""
        bits = self._bits(token)
        lo, hi = self._range(bits, self.n) if bits else (0, 0)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for p in range(len(bits) - 1, -1, -1):
            at = self._select(p, bits[p], at - self._zeros[p] if bits[p] else at)
        return at


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space, each distinct word encoded once.

    Texts are cut at ASCII white space, and between an ASCII letter and ASCII punctuation other than an apostrophe;
    A-Z are lower-cased. No piece of this tokenizer's pattern spans such a cut and its normaliser composes nothing
    across it, so the ids of the parts in a row are those of the text. A word of a-z alone is one piece which the
    normaliser leaves as it is, so only the model sees it. The strings of the file's added tokens get their ids, as in
    the library's plain call.

    Words are looked up by 64-bit hashes, and each hit is compared by its bytes; texts with a word that fails go whole
    through the library.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self._tok, self._bare, self._plain = (Tokenizer.from_file(path) for _ in range(3))
        self._tok.encode_special_tokens = True  # their strings are found before words are cut
        added = self._tok.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that are not plain strings")
        self._added = {t.content.encode(): k for k, t in enumerate(added.values(), 1)}
        self._by_entry = {k: w for w, k in self._added.items()}
        self._added_ids = list(added)
        self._strings = re.compile(b"|".join(map(re.escape, sorted(self._added, key=len, reverse=True)))) if added else None
        self._bare.normalizer, self._bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        vocab = self._tok.get_vocab()
        self._ends = np.zeros(max(vocab.values()) + 1, bool)
        self._ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        """Entry 0 is END, then the added tokens; entry k has the ids ``_arena[_start[k]:][:_len[k]]``."""
        self._keys, self._entries = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # of known words, ascending by hash
        self._start, self._len, self._arena = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.uint32)
        self._used = 1 + len(self._added_ids)
        self._len[: self._used], self._start[: self._used] = 1, np.arange(self._used)
        self._arena[: self._used] = [END, *self._added_ids]
        self._spelt, self._letters, self._word_at, self._word_len = 0, np.zeros(4096, np.uint8), np.zeros(1024, np.int64), np.zeros(1024, np.int64)

    def _look(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        if not len(self._keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self._keys, hashes), len(self._keys) - 1)
        return np.where(self._keys[at] == hashes, self._entries[at], -1)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        order, flat, sizes, rest = [], [], [], []
        alpha = [i for i, w in enumerate(words) if w.isalpha()]
        for tok, todo in ((self._bare, [i for i in alpha if words[i].isascii()]), (self._tok, [i for i in alpha if not words[i].isascii()])):
            for a in range(0, len(todo), 256):
                part = todo[a : a + 256]
                ids = np.array(tok.encode_batch_fast([" ".join([words[i] for i in part])], add_special_tokens=False)[0].ids, np.uint32)
                cut = np.flatnonzero(self._ends[ids])
                if len(cut) == len(part) and cut[-1] == len(ids) - 1:  # one piece a word
                    order += part
                    flat.append(ids)
                    sizes.append(np.diff(cut, prepend=-1))
                else:
                    rest += part
        rest += [i for i, w in enumerate(words) if not w.isalpha()]
        for i, e in zip(rest, self._tok.encode_batch_fast([words[i] for i in rest], add_special_tokens=False), strict=True):
            order.append(i)
            flat.append(np.array(e.ids, np.uint32))
            sizes.append(np.array([len(flat[-1])]))
        ids, size = np.concatenate(flat), np.concatenate(sizes)
        n = len(self._keys) + 1 + len(self._added_ids)
        end = n + len(words)
        while end > len(self._start):
            self._start, self._len, self._word_at, self._word_len = (np.resize(v, 2 * len(v)) for v in (self._start, self._len, self._word_at, self._word_len))
        while self._used + len(ids) > len(self._arena):
            self._arena = np.resize(self._arena, 2 * len(self._arena))
        self._start[n:end] = self._used + np.cumsum(size) - size
        self._len[n:end] = size
        self._arena[self._used : self._used + len(ids)] = ids
        self._used += len(ids)
        keys = hashes[order]
        by = np.argsort(keys)
        at = np.searchsorted(self._keys, keys[by])
        self._keys, self._entries = np.insert(self._keys, at, keys[by]), np.insert(self._entries, at, n + by)
        spelt = [words[i].encode() for i in order]
        size = np.array([len(w) for w in spelt])
        joined = np.frombuffer(b"".join(spelt), np.uint8)
        while self._spelt + len(joined) > len(self._letters):
            self._letters = np.resize(self._letters, 2 * len(self._letters))
        self._letters[self._spelt : self._spelt + len(joined)] = joined
        self._word_at[n:end] = self._spelt + np.cumsum(size) - size
        self._word_len[n:end] = size
        self._spelt += len(joined)

    def _same(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, found: np.ndarray) -> bool:
        """Whether the spans read as the words of their entries."""
        size = ends - starts
        if not np.array_equal(size, self._word_len[found]):
            return False
        return same_spans(raw, starts, self._letters[: self._spelt], self._word_at[found], size)

    def _find_added(self, raw: np.ndarray, off: np.ndarray) -> tuple[list[int], list[int]]:
        """Places of the added tokens' strings, none across texts, and their entries."""
        places, entries = [], []
        if self._strings is not None and self._strings.search(data := raw.tobytes()):
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                for m in self._strings.finditer(data, a, b):
                    places.append(m.start())
                    entries.append(self._added[m[0]])
        return places, entries

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, END after each, and the number of each."""
        raw, off = text_buffer(texts)
        places, entries = self._find_added(raw, off)
        raw = LOWER[raw]
        for a, entry in zip(places, entries, strict=True):
            raw[a : a + len(self._by_entry[entry])] = 32
        starts, ends, before = word_spans(raw, off)
        if len(raw) > 1:
            first, last = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
            first[starts], last[ends - 1] = True, True
            cut = LETTER[raw[:-1]] & MARK[raw[1:]] & ~first[1:]
            first[1:] |= cut
            last[:-1] |= cut
            starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
            before = np.searchsorted(starts, off)
        which, distinct = pd.factorize(hash_spans(raw, starts, ends))
        at = np.zeros(len(distinct), np.int64)
        if len(distinct):
            if len(self._keys) + len(distinct) > CACHE_WORDS:
                self._clear()
            at = self._look(distinct)
            if len(new := np.flatnonzero(at < 0)):
                seen = np.zeros(len(distinct), np.int64)
                seen[which] = np.arange(len(which))
                data = raw.tobytes()
                spans = zip(starts[seen[new]].tolist(), ends[seen[new]].tolist(), strict=True)
                self._learn(distinct[new], [data[a:b].decode() for a, b in spans])
                at[new] = self._look(distinct[new])
        found = at[which]
        if not self._same(raw, starts, ends, found):  # two words of one hash
            each = [[*e.ids, END] for e in self._plain.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.array([i for ids in each for i in ids], np.uint32), np.array([len(ids) for ids in each])
        if places:
            found = np.insert(found, np.searchsorted(starts, places), entries)
            before = before + np.searchsorted(places, off)
        docs = len(off) - 1
        stops = before[1:] + np.arange(docs)
        word = np.zeros(len(found) + docs, np.int64)  # entry 0, END, after each text
        own = np.ones(len(word), bool)
        own[stops] = False
        word[own] = found
        size = self._len[word]
        total = np.cumsum(size, dtype=np.int64)
        step = (self._start[word] - (total - size)).astype(np.int32)
        src = np.repeat(step, size)
        src += np.arange(len(src), dtype=np.int32)
        return self._arena[src], np.diff(total[stops], prepend=0)


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Encodes whole texts (null: empty), END after each, and writes shards in ascending order of ids.

    Rows (task, part, ahead, n_tokens, n_docs, data): by (task, part) the shards are in order; ``ahead`` is the ids of
    the task's earlier shards; a shard ends with a document, at ``shard_tokens`` ids or soon after. Null ids come
    first; rows of one id follow each other in the order of a hash of their texts, by which they may lie in several
    tasks.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    n = max(partitions(spark), min(20_000, own.count() // rows_per_task))
    order = ["doc_id", F.xxhash64("text")]
    dealt = own.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    schema = pa.schema([("task", pa.int32()), ("part", pa.int32()), ("ahead", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, part, ahead = _encoder(path), TaskContext.get().partitionId(), 0, 0
        held: list = []

        def flush() -> pa.RecordBatch:
            nonlocal part, ahead
            ids = np.concatenate([h[0] for h in held])
            doc_ids, null, sizes = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
            row = pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([part], pa.int32()), pa.array([ahead]), pa.array([len(ids)]), pa.array([len(doc_ids)]), pa.array([build(ids, doc_ids, sizes, null)], pa.binary())], schema=schema)
            held.clear()
            part, ahead = part + 1, ahead + len(ids)
            return row

        for batch in batches:
            for piece in text_slices(batch):
                ids, sizes = enc.encode(piece.column(1))
                null = piece.column(0).is_null()
                held.append((ids, pc.fill_null(piece.column(0), 0).to_numpy(zero_copy_only=False), null.to_numpy(zero_copy_only=False), sizes))
                if sum(len(h[0]) for h in held) >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    return stored(dealt.mapInArrow(tidy(run), "task int, part int, ahead long, n_tokens long, n_docs long, data binary"), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """Documents of the shards as read back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = shards.sparkSession
    sums = shards.groupBy("task").agg(F.sum("n_tokens").alias("n")).orderBy("task").collect()  # one row a task that wrote
    base, bases = 0, []
    for r in sums:
        bases.append((r["task"], base))
        base += r["n"]
    offsets = spark.createDataFrame(bases, "task int, base long")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data in zip(batch.column(0), batch.column(1), strict=True):
                shard = Shard(data.as_py())
                ends = shard.ends.astype(np.int64)
                starts, crc, done = np.concatenate([[0], ends[:-1]]), np.zeros(len(ends), np.int64), 0
                while done < len(ends):  # documents of about SPAN ids at a time
                    to = max(done + 1, int(np.searchsorted(ends, starts[done] + SPAN, side="right")))
                    base, ids = starts[done], shard.ids(int(starts[done]), int(ends[to - 1])).astype("<u4")
                    crc[done:to] = [zlib.crc32(ids[a - base : b - base]) for a, b in zip(starts[done:to], ends[done:to], strict=True)]
                    done = to
                doc_ids = pa.array(shard.doc_ids, mask=shard.null_ids.astype(bool))
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(first.as_py() + starts), pa.array(ends - starts), pa.array(crc)], schema=schema)

    joined = shards.select("task", "ahead", "data").join(F.broadcast(offsets), "task")  # one row a task that wrote
    return joined.select((F.col("base") + F.col("ahead")).alias("start"), "data").mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, **options) -> DataFrame:
    """Writes the shards of ``docs`` and reads their documents back. An empty table gives an empty result; other
    columns are ignored; repeated rows are documents of their own; null ids come first and stay null."""
    return read_shards(write_shards(docs, path, **options))
