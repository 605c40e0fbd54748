"""Language identification: a bidirectional gated recurrent network over bytes, trained here in numpy.

A text's UTF-8 bytes are read in segments of SEGMENT bytes, all of them, to the end. In each segment one gated
recurrent network runs forwards and one backwards; both states at a byte give it a distribution over the languages.
A document's probabilities are the mean over its bytes that are not white space; the largest is the score.

Training: backpropagation through time over segments drawn from a bounded, language-balanced sample of labelled
documents (``docs_per_lang`` documents, ``segments_per_doc`` segments of each, at places spread over the whole
text), with Adam. Documents whose crc32 of the id modulo 5 is 0 are held out. Only text goes into a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.common import SPACE, in_batches, text_buffer, text_slices

SEGMENT, HIDDEN, STEPS, BATCH, RATE, SEED = 64, 8, 420, 192, 0.02, 11
DOCS_PER_LANG, SEGMENTS_PER_DOC = 400, 4
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class ByteGru:
    """Parameters by name; index 0 of the first axis is the forward network, 1 the backward one."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        h, n = hidden, len(langs)
        self.langs, self.hidden = langs, hidden
        self.p = {
            "x": rng.normal(0, 0.3, (2, 256, 3 * h)),  # update gate, reset gate, candidate
            "u": rng.normal(0, 1 / np.sqrt(h), (2, h, 2 * h)),
            "c": rng.normal(0, 1 / np.sqrt(h), (2, h, h)),
            "o": rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, n)),
            "b": np.zeros(n),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, seg: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """seg: (n, T) bytes. States (T, n, 2 hidden) by position, and what the way back needs."""
        p, h = self.p, self.hidden
        n, t = seg.shape
        states = np.zeros((t, n, 2 * h), np.float32)
        tape: list = []
        for d in (0, 1):
            s = np.zeros((n, h), np.float32)
            for i in range(t) if d == 0 else range(t - 1, -1, -1):
                x = p["x"][d][seg[:, i]]
                g = _sigmoid(x[:, : 2 * h] + s @ p["u"][d])
                z, r = g[:, :h], g[:, h:]
                rs = r * s
                c = np.tanh(x[:, 2 * h :] + rs @ p["c"][d])
                new = s + z * (c - s)
                if keep:
                    tape.append((d, i, s, z, r, rs, c))
                s = new
                states[i, :, d * h : (d + 1) * h] = s
        return states, tape

    def positions(self, states: np.ndarray) -> np.ndarray:
        """Distributions over the languages at each position."""
        v = states @ self.p["o"] + self.p["b"]
        v -= v.max(axis=-1, keepdims=True)
        np.exp(v, out=v)
        v /= v.sum(axis=-1, keepdims=True)
        return v

    def gradients(self, seg: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all positions, and its gradients by backpropagation through time."""
        p, h = self.p, self.hidden
        n, t = seg.shape
        states, tape = self.forward(seg, True)
        prob = self.positions(states)
        loss = -float(np.log(prob[:, np.arange(n), label] + 1e-9).mean())
        d_out = prob
        d_out[:, np.arange(n), label] -= 1
        d_out /= n * t
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["o"] = np.tensordot(states, d_out, ((0, 1), (0, 1)))
        g["b"] = d_out.sum((0, 1))
        d_states = d_out @ p["o"].T
        carry = [np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)]
        for d, i, s, z, r, rs, c in reversed(tape):
            ds = carry[d] + d_states[i, :, d * h : (d + 1) * h]
            dz = ds * (c - s) * z * (1 - z)
            dc = ds * z * (1 - c * c)
            drs = dc @ p["c"][d].T
            dr = drs * s * r * (1 - r)
            dg = np.concatenate([dz, dr], axis=1)
            carry[d] = ds * (1 - z) + drs * r + dg @ p["u"][d].T
            g["u"][d] += s.T @ dg
            g["c"][d] += rs.T @ dc
            np.add.at(g["x"][d], seg[:, i], np.concatenate([dg, dc], axis=1))
        return loss, g

    def fit(self, seg: np.ndarray, label: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> float:
        rng = np.random.default_rng(seed)
        pools = [np.flatnonzero(label == k) for k in range(len(self.langs))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        loss = 0.0
        for step in range(1, steps + 1):
            which = rng.integers(0, len(pools), batch)
            rows = np.array([pools[k][rng.integers(len(pools[k]))] for k in which])
            loss, g = self.gradients(seg[rows], label[rows])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            lr = rate * min(1.0, 5.0 / max(norm, 1e-9)) * (1 - 0.9 * step / steps)
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
                self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss

    def sums(self, seg: np.ndarray, solid: np.ndarray) -> np.ndarray:
        """(n, languages): distributions of segments (n, T) summed over the positions where ``solid`` is true.

        All is done element by element, segments along the last axis: rounding in a matrix product or a reduction may
        depend on a row's place and the number of rows, and a segment must get the same bits in any company.
        """
        p, h = self.p, self.hidden
        (n, t), langs = seg.shape, len(self.langs)
        places, solid = np.ascontiguousarray(seg.T, np.intp), np.ascontiguousarray(solid.T, np.float32)
        outer = np.empty((t, langs, n), np.float32)
        outer[:] = p["b"][:, None]
        tables = [np.ascontiguousarray(v.T) for v in p["x"]]
        u, c, o = p["u"][..., None], p["c"][..., None], p["o"].reshape(2, h, langs, 1)
        x, s, rs = np.empty((2, 3 * h, n), np.float32), np.zeros((2, h, n), np.float32), np.empty((2, h, n), np.float32)
        g, z, r, new = x[:, : 2 * h], x[:, :h], x[:, h : 2 * h], x[:, 2 * h :]
        wide, narrow, vote = np.empty((2, 2 * h, n), np.float32), np.empty((2, h, n), np.float32), np.empty((langs, n), np.float32)
        for i in range(t):  # both networks, the backward one at the mirrored place
            for d, j in enumerate((i, t - 1 - i)):
                np.take(tables[d], places[j], axis=1, out=x[d], mode="clip")
            for k in range(h):
                g += np.multiply(u[:, k], s[:, k, None], out=wide)
            _sigmoid(g)
            np.multiply(r, s, out=rs)
            for k in range(h):
                new += np.multiply(c[:, k], rs[:, k, None], out=narrow)
            np.tanh(new, out=new)
            new -= s
            new *= z
            s += new
            for d, j in enumerate((i, t - 1 - i)):
                for k in range(h):
                    outer[j] += np.multiply(o[d, k], s[d, k], out=vote)
        out = np.zeros((langs, n), np.float32)
        for v, own in zip(outer, solid, strict=True):
            top, total = v[0].copy(), np.zeros(n, np.float32)
            for row in v:
                np.maximum(top, row, out=top)
            v -= top
            np.exp(v, out=v)
            for row in v:
                total += row
            v *= np.divide(own, total, out=total)
            out += v
        return out.T

    def documents(self, raw: np.ndarray, off: np.ndarray, rows: int = 4096) -> np.ndarray:
        """(documents, languages): mean distribution over the bytes that are not white space. The same for a document
        whatever others are beside it."""
        docs = len(off) - 1
        size = np.diff(off)
        segs = -(-size // SEGMENT)
        doc = np.repeat(np.arange(docs), segs)
        first = np.repeat(off[:-1], segs) + SEGMENT * (np.arange(segs.sum()) - np.repeat(np.cumsum(segs) - segs, segs))
        end = off[1:][doc]
        padded = np.concatenate([raw, np.zeros(SEGMENT, np.uint8)])
        out, weight = np.zeros((docs, len(self.langs))), np.zeros(docs)
        for a in range(0, len(doc), rows):
            at = first[a : a + rows, None] + np.arange(SEGMENT)
            inside = at < end[a : a + rows, None]
            seg = np.where(inside, padded[np.minimum(at, len(raw))], 0)
            solid = inside & ~SPACE[seg]
            np.add.at(out, doc[a : a + rows], self.sums(seg, solid))
            np.add.at(weight, doc[a : a + rows], solid.sum(1))
        return out / np.maximum(weight, 1)[:, None]


def sample(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, segments_per_doc: int = SEGMENTS_PER_DOC) -> list[tuple[str, bytes, int]]:
    """Labelled segments for training: about ``docs_per_lang`` documents of each language (chosen by a hash of
    their ids, at most twice that many), not held out, ``segments_per_doc`` segments of each over its whole text.
    Equal rows count once."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return []
    spread = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)).cast("double") / float(1 << 20)
    limit = F.element_at(F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, docs_per_lang / n)))]), F.col("lang"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, segs, keys = [], [], []
            for i, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                step = max(1, (len(raw) - SEGMENT) / max(1, segments_per_doc - 1))
                for k in range(segments_per_doc):
                    a = min(int(k * step), max(0, len(raw) - SEGMENT))
                    if k == 0 or a > 0:
                        langs.append(lang)
                        segs.append(raw[a : a + SEGMENT].ljust(SEGMENT, b"\0"))
                        keys.append(i * segments_per_doc + k)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(segs, pa.binary()), pa.array(keys, pa.int64())], names=["lang", "seg", "key"])

    segments = in_batches(known.where(spread < limit).select("doc_id", "lang", "text"), cut, "lang string, seg binary, key long").distinct()
    most = 2 * docs_per_lang * segments_per_doc
    first = segments.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("key", "seg"))).where(F.col("place") <= most)
    return sorted((r["lang"], bytes(r["seg"]), r["key"]) for r in first.collect())


def train(samples: list[tuple[str, bytes, int]], steps: int = STEPS) -> ByteGru | None:
    samples = sorted(samples, key=lambda x: (x[0], x[2], x[1]))
    langs = sorted({x for x, *_ in samples})
    if not langs:
        return None
    net = ByteGru(langs)
    seg = np.frombuffer(b"".join(s for _, s, _ in samples), np.uint8).reshape(-1, SEGMENT)
    net.fit(seg, np.array([langs.index(x) for x, *_ in samples]), steps)
    return net


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(docs: DataFrame, net: ByteGru | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for rows (doc_id, text). One pass, no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text", 1 << 20):
                raw, off = text_buffer(part.column(2))
                ascii_letter = np.concatenate([[0], np.cumsum((raw | 32) - np.uint8(97) < 26)])
                letters = np.diff(ascii_letter[off]) > 0
                for i in np.flatnonzero(~letters):
                    letters[i] = has_letter(raw[off[i] : off[i + 1]].tobytes().decode())
                n = len(off) - 1
                if net is None:
                    best, score = [UNKNOWN] * n, np.zeros(n)
                else:
                    prob = net.documents(raw, off)
                    top = prob.argmax(1)
                    best = [net.langs[k] if ok else UNKNOWN for k, ok in zip(top, letters, strict=True)]
                    score = np.where(letters, np.clip(prob[np.arange(n), top], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(best, pa.string()), pa.array(score)], schema=schema)

    return in_batches(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score.

    lang_pred is a language of the training labels; ``und`` with score 0 if the text is null, has no letter, or no
    row is labelled. A null id is never held out (held_out is null). Other columns are ignored; an empty table gives
    an empty result. Reruns on the same rows agree.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    return predict(own, train(sample(own)))
