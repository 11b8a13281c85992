"""Toxicity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm._common import ship
from barloom.llm.cotraining import sample
from barloom.llm.decontamination import words_of

ship(__name__)

#: Labelled documents that the model is fitted on at most (about; rows of documents, drawn by hash).
LABELLED = 12_000
#: Hash bins of the features, and how many of them the model keeps.
BINS, KEPT = 1 << 22, 8_192
#: Sampled documents that have to show a feature.
LEAST = 5
#: Standard deviations by which its toxic documents have to differ from chance.
DISTINCT = 4.0
#: Severity: 0 for documents that are not toxic, then as many grades of toxic ones.
GRADES = 3
#: Words whose features a worker remembers.
REMEMBERED = 200_000


def bins_of(word: bytes) -> list[int]:
    """A word, and its beginnings, which inflected and compound forms share."""
    return [zlib.crc32(word) % BINS, *(zlib.crc32(word[:n] + b"\0%d" % n) % BINS for n in (4, 5, 6) if len(word) > n)]


def counts_of(data: bytes) -> tuple[dict[int, int], int]:
    """How often each feature occurs in a whole text, and its number of words."""
    out: Counter = Counter()
    words = words_of(data)
    for word, n in Counter(words).items():
        for b in bins_of(word):
            out[b] += n
    return out, len(words)


class Ordinal:
    """P(severity >= k) = sigmoid(w.x - theta_k): one set of weights for all ordered thresholds."""

    def __init__(self, weights: np.ndarray, thetas: np.ndarray):
        self.weights, self.thetas = weights, thetas

    def at_least(self, margins: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(0.5 * (margins[:, None] - self.thetas[None, :])))

    @classmethod
    def fit(cls, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n: int, l2: float = 5e-6, steps: int = 400, rate: float = 0.3) -> Ordinal:
        """Full-batch Adam on the mean likelihood of sparse rows; thresholds are a first one and logarithms of the gaps."""
        k = GRADES
        prior = np.array([np.clip((grades >= j).mean(), 1e-3, 1 - 1e-3) for j in range(1, k + 1)])
        start = np.log(1 / prior - 1)
        params = np.concatenate([np.zeros(n), [start[0]], np.log(np.maximum(np.diff(start), 0.05))])
        m, v, m_all = np.zeros_like(params), np.zeros_like(params), len(grades)
        for t in range(1, steps + 1):
            w, gaps = params[:n], np.exp(params[n + 1 :])
            thetas = params[n] + np.concatenate(([0.0], np.cumsum(gaps)))
            s = np.bincount(rows, values * w[cols], minlength=m_all)
            a = 0.5 * (1 + np.tanh(0.5 * (s[:, None] - thetas[None, :])))
            wide = np.concatenate([np.ones((m_all, 1)), a, np.zeros((m_all, 1))], axis=1)
            at = np.arange(m_all)
            low, high = wide[at, grades], wide[at, grades + 1]
            p = np.maximum(low - high, 1e-12)
            ds = low + high - 1  # of the negative log likelihood
            grad_t = np.zeros((m_all, k + 2))
            grad_t[at, grades] += low * (1 - low) / p
            grad_t[at, grades + 1] -= high * (1 - high) / p
            g_theta = grad_t[:, 1 : k + 1].mean(axis=0)
            tail = np.cumsum(g_theta[::-1])[::-1]
            grad = np.concatenate([np.bincount(cols, values * ds[rows], minlength=n) / m_all + l2 * w, [tail[0]], tail[1:] * gaps])
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            params = params - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return cls(params[:n], params[n] + np.concatenate(([0.0], np.cumsum(np.exp(params[n + 1 :])))))


def severity_grades(toxic: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Ordered grades from a 0/1 label: 0 if not toxic; the toxic ones in equal parts by the strength of the words in them that mark toxic texts."""
    out = np.zeros(len(toxic), dtype=np.int64)
    bad = np.flatnonzero(toxic == 1)
    cuts = np.quantile(marked[bad], np.arange(1, GRADES) / GRADES) if len(bad) else []
    out[bad] = 1 + np.searchsorted(cuts, marked[bad], side="right")
    return out


def strength(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Value of a feature: its logarithmic count, damped by the length of the text."""
    return np.log1p(counts) / np.sqrt(1 + words / 100)


def fit_rows(toxic: np.ndarray, words: np.ndarray, rows: np.ndarray, cols: np.ndarray, counts: np.ndarray, kept: int = KEPT) -> dict[str, np.ndarray]:
    """Model from sampled documents: the features that tell the classes apart best, their weights and the thresholds."""
    if len({*toxic.tolist()}) < 2:
        return {}
    values = strength(counts, words[rows])
    n1, n0 = (toxic == 1).sum(), (toxic == 0).sum()
    d1, d0 = np.bincount(cols, toxic[rows] == 1, minlength=BINS), np.bincount(cols, toxic[rows] == 0, minlength=BINS)
    odds = np.log((d1 + 0.5) / (n1 + 1)) - np.log((d0 + 0.5) / (n0 + 1))
    chance = (d1 + d0) * n1 / (n1 + n0)
    worth = np.abs(d1 - chance) / np.sqrt(np.maximum(chance, 1e-9)) * (d1 + d0 >= LEAST)
    worth[worth < DISTINCT] = 0
    chosen = np.sort(np.argsort(-worth, kind="stable")[: min(kept, int((worth > 0).sum()))])
    place = np.full(BINS, -1)
    place[chosen] = np.arange(len(chosen))
    used = place[cols] >= 0
    rows, cols, values = rows[used], place[cols[used]], values[used]
    markers = odds[chosen] > np.log(8)
    marked = np.bincount(rows, values * markers[cols], minlength=len(words))
    grades = severity_grades(toxic, marked)
    model = Ordinal.fit(rows, cols, values, grades, len(chosen))
    return {"bins": chosen.astype(np.float64), "weights": model.weights, "thetas": model.thetas}


ROW = "id long, toxic int, words long, bins array<int>, counts array<int>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, toxic, texts = (c.to_pylist() for c in batch.columns)
        found = [counts_of(t or b"") for t in texts]
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(toxic, pa.int32()), pa.array([n for _, n in found], pa.int64()),
            pa.array([list(c) for c, _ in found], pa.list_(pa.int32())), pa.array([list(c.values()) for c, _ in found], pa.list_(pa.int32())),
        ], names=["id", "toxic", "words", "bins", "counts"])


def _fit(kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        ids, toxic, words, bins, counts = (pa.chunked_array([b.column(i) for b in batches]).combine_chunks() for i in range(5))
        toxic, words = toxic.to_numpy(), words.to_numpy().astype(np.float64)
        order = sorted(range(len(toxic)), key=lambda i: (zlib.crc32(repr(ids[i].as_py()).encode()), toxic[i], words[i]))
        rank = np.argsort(order)
        rows = np.repeat(rank, np.diff(bins.offsets.to_numpy()))
        again = np.argsort(rows, kind="stable")  # the same sums in whatever order the rows come
        cols, n = bins.flatten().to_numpy()[again], counts.flatten().to_numpy()[again].astype(np.float64)
        model = fit_rows(toxic[order], words[order], rows[again], cols, n, kept)
        yield pa.RecordBatch.from_arrays([pa.array(list(model), pa.string()), pa.array([w.tolist() for w in model.values()], pa.list_(pa.float64()))], names=["name", "weights"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", labelled: int = LABELLED, kept: int = KEPT) -> dict[str, np.ndarray]:
    """The model, fitted on about ``labelled`` rows of labelled documents: only their feature rows meet in one task."""
    drawn = sample(docs, labels, label, labelled, 0, (), F.max)
    rows = drawn.where(F.col("_label").isNotNull()).select(F.col("doc_id").cast("long"), "_label", F.col("text").cast("binary"))
    model = rows.mapInArrow(_features, ROW).repartition(1).mapInArrow(_fit(kept), "name string, weights array<double>").collect()
    return {r.name: np.array(r.weights) for r in model}


class Scorer:
    """Margins of texts; what features a word has is worked out once."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.by_bin = dict(zip(model["bins"].astype(int).tolist(), model["weights"].tolist(), strict=True))
        self.ordinal = Ordinal(model["weights"], model["thetas"])
        self.known: dict[bytes, tuple[int, ...]] = {}

    def margin(self, data: bytes) -> float:
        words = words_of(data)
        known, found = self.known, Counter()
        if len(known) > REMEMBERED:
            known.clear()
        for word, n in Counter(words).items():
            bins = known.get(word)
            if bins is None:
                bins = known[word] = tuple(b for b in bins_of(word) if b in self.by_bin)
            for b in bins:
                found[b] += n
        counts = np.fromiter(found.values(), dtype=np.float64, count=len(found))
        weights = np.fromiter(map(self.by_bin.__getitem__, found), dtype=np.float64, count=len(found))
        return float(strength(counts, np.float64(len(words))) @ weights)


RESULT = T.StructType([
    T.StructField("doc_id", T.LongType()), *(T.StructField(f"p_{k}", T.DoubleType()) for k in range(1, GRADES + 1)),
    T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType()),
])


def _score(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(broadcast.value) if broadcast.value else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            p = scorer.ordinal.at_least(np.array([scorer.margin(t or b"") for t in texts])) if scorer else np.zeros((len(texts), GRADES))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *(pa.array(p[:, k]) for k in range(GRADES)), pa.array(p.sum(axis=1)),
                pa.array((p >= 0.5).sum(axis=1).astype(np.int32)), pa.array(p[:, 0] >= 0.5),
            ], names=RESULT.names)

    return run


def severity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, p_1..p_3 (probabilities of at least that grade), severity (the expected grade), grade and toxic.

    Labels are 0 or 1; the grades of toxic documents are their thirds by the strength of words that mark toxic ones.
    Null and empty texts have no features and get what the thresholds alone say; repeated rows and ids are scored row by row; labels that contradict
    each other count as toxic; without labels of both classes every severity is 0; an empty table gives an empty result; other
    columns are not read.
    """
    model = fit(docs, labels, **options)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), RESULT)
