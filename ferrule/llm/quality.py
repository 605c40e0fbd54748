"""Quality by ordinal regression: a cumulative-link model on graded ratings.

Grades: 0 toxic, 1 neither toxic nor good, 2 good (of the labels toxic and quality). A document is a set of hashed
features: its words (runs of letters, digits and bytes above 127, A-Z lower-cased) and the levels of a few measures
of its form (shares of punctuation, capitals, repeated words, digits ...). One weight a feature, shared by all
grades, gives a score s; ordered thresholds t1 < t2 cut it: P(grade >= k) = sigmoid(s - tk). From these follow the
expected grade and the tail probability P(grade >= 2), by which documents are selected.

The fit uses at most ``sample_docs`` labelled documents, those with the smallest hashes of their ids. Words seen in fewer
than MIN_DOCS of them, or with no grade whose chi-square with the word reaches ASSOCIATION, have no weight, nor any
beyond the MOST_FEATURES most associated; they are counted where the documents are, so the driver gets MOST_FEATURES
numbers a document at most. Every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import LOWER, SPACE, discard, hash_spans, stored, text_buffer, text_slices

BUCKETS, SAMPLE_DOCS, MIN_DOCS, STEPS, PENALTY, GRADES = 1 << 18, 12_000, 3, 250, 5e-4, 3
#: Chi-square of a word with a grade, below which the word is taken for noise.
ASSOCIATION = 20.0
MOST_FEATURES = 8192
FORMS = 1024  # buckets of measures of form, ahead of those of words
KEEP_AT = 0.5

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: Levels of a share.
_LEVELS = np.array([0.0, 0.01, 0.02, 0.04, 0.06, 0.08, 0.11, 0.15, 0.2, 0.3, 0.45, 0.6, 0.8])


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of each text, one after the other, and n + 1 offsets."""
    docs = len(off) - 1
    if not len(raw):
        form = np.zeros((docs, 0), np.int64)
        starts = ends = np.zeros(0, np.int64)
        before = np.zeros(docs + 1, np.int64)
        h = np.zeros(0, np.uint64)
    else:
        word = _WORD[raw]
        edge = np.zeros(len(raw), bool)
        edge[off[:-1][off[:-1] < len(raw)]] = True
        first = word & (np.concatenate([[True], ~word[:-1]]) | edge)
        last = word & np.concatenate([~word[1:] | edge[1:], [True]])
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        before = np.searchsorted(starts, off)
        h = hash_spans(LOWER[raw], starts, ends)

        def per_doc(mask: np.ndarray) -> np.ndarray:
            c = np.concatenate([[0], np.cumsum(mask)])
            return np.diff(c[off]).astype(float)

        def per_word(mask: np.ndarray) -> np.ndarray:
            c = np.concatenate([[0], np.cumsum(mask)])
            return np.diff(c[before]).astype(float)

        chars, words = np.maximum(np.diff(off), 1), np.maximum(np.diff(before), 1)
        again = np.concatenate([[False], h[1:] == h[:-1]]) if len(h) else np.zeros(0, bool)
        letters = np.maximum(per_doc(word & ~_DIGIT[raw]), 1)
        punct = ~word & ~SPACE[raw]
        pairs = np.concatenate([[False], punct[1:] & punct[:-1]])
        shares = [per_doc(punct) / chars, per_doc(pairs) / chars, per_doc(_UPPER[raw]) / letters, per_doc(_DIGIT[raw]) / chars, per_word(again) / words, per_doc(raw == 124) / words, per_doc(raw == 10) / words]
        form = np.stack([np.searchsorted(_LEVELS, s, side="right") + 32 * k for k, s in enumerate(shares)], axis=1)
    word_ids = (h % np.uint64(BUCKETS - FORMS)).astype(np.int64) + FORMS
    out, sizes = [], np.zeros(docs + 1, np.int64)
    for i in range(docs):
        v = np.concatenate([form[i], np.unique(word_ids[before[i] : before[i + 1]])])
        out.append(v)
        sizes[i + 1] = len(v)
    return (np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)), np.cumsum(sizes)


class Ordinal:
    """Weights (BUCKETS,), bias folded into the thresholds (GRADES - 1,), which stay in order."""

    def __init__(self, grades: int = GRADES) -> None:
        self.w = np.zeros(BUCKETS, np.float32)
        self.first, self.gaps = -1.0, np.full(grades - 2, 0.5)  # gaps in logs

    @property
    def thresholds(self) -> np.ndarray:
        return self.first + np.concatenate([[0.0], np.cumsum(np.exp(self.gaps))])

    def scores(self, idx: np.ndarray, off: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0.0], np.cumsum(self.w[idx], dtype=np.float64)])
        return np.diff(c[off])

    def tails(self, s: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1 / (1 + np.exp(-np.clip(s[:, None] - self.thresholds, -40, 40)))

    def fit(self, idx: np.ndarray, off: np.ndarray, grade: np.ndarray, known: np.ndarray, steps: int = STEPS) -> None:
        """Weights of the ``known`` features, by gradient ascent on the balanced likelihood."""
        n = len(grade)
        doc = np.repeat(np.arange(n), np.diff(off))
        place = np.full(BUCKETS, -1)
        place[known] = np.arange(len(known))
        use = place[idx] >= 0
        col, doc = place[idx][use], doc[use]
        share = np.bincount(grade, minlength=len(self.gaps) + 2) / n
        balance = (1 / np.maximum(share, 1e-9))[grade] ** 0.5
        balance /= balance.mean()
        w = np.zeros(len(known))
        theta = np.concatenate([[self.first], self.gaps])
        m, v = np.zeros(len(w) + len(theta)), np.zeros(len(w) + len(theta))
        for step in range(1, steps + 1):
            t = theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:]))])
            s = np.bincount(doc, weights=w[col], minlength=n)
            p = 1 / (1 + np.exp(-np.clip(s[:, None] - t, -40, 40)))  # P(grade >= k)
            upper = np.where(grade > 0, p[np.arange(n), np.maximum(grade - 1, 0)], 1.0)
            lower = np.where(grade < len(t), p[np.arange(n), np.minimum(grade, len(t) - 1)], 0.0)
            like = np.maximum(upper - lower, 1e-9)
            du, dl = upper * (1 - upper) / like, lower * (1 - lower) / like  # of the log-likelihood by s - t
            ds = balance * (du - dl) / n
            dt = np.zeros(len(t))
            np.add.at(dt, np.maximum(grade - 1, 0), np.where(grade > 0, -balance * du / n, 0))
            np.add.at(dt, np.minimum(grade, len(t) - 1), np.where(grade < len(t), balance * dl / n, 0))
            g = -np.concatenate([np.bincount(col, weights=ds[doc], minlength=len(w)) - PENALTY * w, [dt.sum()], [dt[k + 1 :].sum() * np.exp(theta[1 + k]) for k in range(len(theta) - 1)]])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = 0.1 * (1 - 0.8 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
            w -= move[: len(w)]
            theta -= move[len(w) :]
        self.w[known] = w
        self.first, self.gaps = float(theta[0]), theta[1:]


def selected(seen: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Features worth a weight. ``seen``: documents of each grade with each feature; ``total``: documents of each grade."""
    n, each = total.sum(), seen.sum(0)
    chi = np.zeros(seen.shape[1])
    for own, size in zip(seen, total, strict=True):
        p = size / max(n, 1)
        spread = each * p * (1 - p) * (1 - each / max(n, 1))
        chi = np.maximum(chi, (own - each * p) ** 2 / np.maximum(spread, 1e-9) * (spread > 0))
    use = ((each >= MIN_DOCS) & (chi >= ASSOCIATION)) | ((np.arange(len(chi)) < FORMS) & (each > 0))
    rank = np.where(np.arange(len(chi)) < FORMS, np.inf, chi)
    known = np.flatnonzero(use)
    return np.sort(known[np.argsort(-rank[known], kind="stable")[:MOST_FEATURES]])


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of labels (doc_id, quality, toxic); rows without both are left out, of several the lowest grade counts."""
    of = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min(of).alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Ordinal | None:
    rated = grades(labels)
    n = rated.count()
    if not n:
        return None
    chosen = rated.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample_docs)  # the documented bound of the fit
    chosen = stored(chosen, "rated")
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "grade")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                idx, off = features(*text_buffer(part.column(1)))
                sets = [idx[a:b].astype("<i4").tobytes() for a, b in zip(off, off[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2).cast(pa.int32()), pa.array(sets, pa.binary())], names=["doc_id", "grade", "set"])

    sets = rows.mapInArrow(run, "doc_id long, grade int, set binary").groupBy("doc_id", "grade").agg(F.min("set").alias("set"))  # one row an id
    sets = stored(sets, "features")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((GRADES, BUCKETS), np.int64)
        for batch in batches:
            for g, raw in zip(batch.column("grade").to_pylist(), batch.column("set"), strict=True):
                seen[g, np.frombuffer(raw.as_buffer(), "<i4")] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen.ravel()[at])], names=["at", "n"])

    counts = sets.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # GRADES * BUCKETS rows at most
    seen = np.zeros(GRADES * BUCKETS, np.int64)
    seen[counts.column("at").to_numpy()] = counts.column("n").to_numpy()
    total = np.zeros(GRADES, np.int64)
    for r in sets.groupBy("grade").count().collect():
        total[r["grade"]] = r["count"]
    if not total.sum():
        return None
    known = selected(seen.reshape(GRADES, BUCKETS), total)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = np.zeros(BUCKETS, bool)
        use[known] = True
        for batch in batches:
            own = [np.frombuffer(raw.as_buffer(), "<i4") for raw in batch.column("set")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array([v[use[v]].tobytes() for v in own], pa.binary())], names=["doc_id", "grade", "set"])

    got = sorted((r["doc_id"], r["grade"], bytes(r["set"])) for r in sets.mapInArrow(keep, "doc_id long, grade int, set binary").collect())
    discard(sets, chosen)
    few = [np.frombuffer(s, "<i4") for _, _, s in got]
    model = Ordinal()
    model.fit(np.concatenate(few).astype(np.int64), np.concatenate([[0], np.cumsum([len(s) for s in few])]), np.array([g for _, g, _ in got]), known)
    return model


def grade(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """One row for each row of ``docs``: doc_id, expected_grade, p_toxic, p_good, kept (p_good >= keep_at).

    Null text counts as empty. Without labels the grades are null and every document is kept. Of rows that share a
    labelled id one is learned from, and each is graded by its own text; a null id is never learned from. Other columns
    are ignored; an empty table gives an empty result.
    """
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    model = train(own, labels.select(labels["doc_id"].cast("long").alias("doc_id"), "quality", "toxic"))
    schema = pa.schema([("doc_id", pa.int64()), ("expected_grade", pa.float64()), ("p_toxic", pa.float64()), ("p_good", pa.float64()), ("kept", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                n = part.num_rows
                if model is None:
                    nothing = pa.nulls(n, pa.float64())
                    yield pa.RecordBatch.from_arrays([part.column(0), nothing, nothing, nothing, pa.array([True] * n)], schema=schema)
                    continue
                tails = model.tails(model.scores(*features(*text_buffer(part.column(1)))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tails.sum(1)), pa.array(1 - tails[:, 0]), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= keep_at)], schema=schema)

    return own.mapInArrow(run, "doc_id long, expected_grade double, p_toxic double, p_good double, kept boolean")
