"""Quality classifier by co-training: a view of the text and a view of the metadata teach each other."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm._common import fresh, ship, staged

ship(__name__)

#: Labelled documents, and documents of the pool without labels, that the models are fitted on at most (about; chosen by hash).
LABELLED, POOL = 8_000, 8_000
#: Every FOLD-th labelled document is held out to calibrate the views and to weigh them.
FOLD = 4
ROUNDS, CONFIDENT, GROWTH = 3, 0.98, 0.2
SHAPES, WORDS = 192, 256
MARKS = b"!|%$#*&.,?<{_:;'\"()-/"
SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))
STATS = len(MARKS) + 17


def text_view(data: bytes) -> np.ndarray:
    """Shares of character classes and marks, repetition of words and lines, lengths, and hashed word shapes and words of a whole text."""
    out = np.zeros(STATS + SHAPES + WORDS, dtype=np.float32)
    if not data:
        return out
    codes = np.frombuffer(data, dtype=np.uint8)
    counts = np.bincount(codes, minlength=256) / len(codes)
    words, lines = data.split(), data.split(b"\n")
    if not words:
        return out
    tally, rows = Counter(words), Counter(lines)
    longest = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    out[: len(MARKS)] = np.sqrt(counts[list(MARKS)])
    out[len(MARKS) : STATS] = [
        counts[65:91].sum(), counts[97:123].sum(), counts[128:].sum(), counts[48:58].sum(), counts[32], np.sqrt(counts[10]),
        np.log1p(len(codes)) / 10, np.log1p(len(words)) / 10, longest.mean() / 10, np.log1p(longest.max()) / 5, len(tally) / len(words),
        max(tally.values()) / len(words), len(rows) / len(lines), sum(len(k) * (v - 1) for k, v in rows.items()) / len(codes),
        np.log1p(len(codes) / len(lines)) / 10, sum(v for v in tally.values() if v > 1) / len(words), 1.0 / len(words),
    ]
    forms = np.frombuffer(data.translate(SHAPE), dtype=np.uint8)
    forms = forms[np.concatenate(([True], forms[1:] != forms[:-1]))]
    for at, width, found in ((STATS, SHAPES, Counter(forms.tobytes().split())), (STATS + SHAPES, WORDS, Counter(data.lower().split()))):
        bins = np.fromiter((zlib.crc32(k) % width for k in found), dtype=np.int64, count=len(found))
        sums = np.bincount(bins, np.fromiter(found.values(), dtype=np.float64, count=len(found)), minlength=width)
        out[at : at + width] = np.sqrt(sums / max(1.0, sums.sum()))
    return out


LANGS, SOURCES, LENGTHS = 16, 64, 24


def meta_view(values: Sequence) -> np.ndarray:
    """Hashed language and source and the order of magnitude of the stated length; null is a value of its own."""
    lang, source, n_chars = values
    out = np.zeros(LANGS + SOURCES + LENGTHS + 1, dtype=np.float32)
    out[zlib.crc32(repr(lang).encode()) % LANGS] = 1
    out[LANGS + zlib.crc32(repr(source).encode()) % SOURCES] = 1
    out[LANGS + SOURCES + (0 if n_chars is None else min(LENGTHS - 1, 1 + int(max(0, n_chars)).bit_length()))] = 1
    out[-1] = 0 if n_chars is None else np.log1p(max(0, n_chars)) / 10
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -60, 60)))


def logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last weight is the intercept, which is not shrunk."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float64)
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    ridge[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-4:
            break
    return w


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def cotrain(
    views: Sequence[np.ndarray], y: np.ndarray, rounds: int = ROUNDS, confident: float = CONFIDENT, growth: float = GROWTH, l2: float = 1.0,
) -> dict[str, np.ndarray]:
    """Fit two views on rows whose label is 0, 1 or missing (negative).

    Every round both views are fitted and calibrated on the held-out labelled rows.  Each gives the other those rows of the
    pool that the other does not have yet and of which it is confident, the surest of each class first, as labels: at most a
    ``growth`` share of the pool in a round, divided between the classes as among the labelled rows.
    At the end the calibrated margins are weighed by a regression on the held-out rows.
    """
    known = np.flatnonzero(y >= 0)
    held, train, pool = known[::FOLD], np.setdiff1d(known, known[::FOLD]), np.flatnonzero(y < 0)
    if not len({*y[train].tolist()}) == 2 or not len({*y[held].tolist()}) == 2:
        return {}
    given: list[dict[int, int]] = [{} for _ in views]  # pseudo-labels that each view was given
    grown = [[0, 0]]
    for turn in range(rounds + 1):
        weights, scales = [], []
        for x, own in zip(views, given, strict=True):
            rows = np.concatenate([train, np.fromiter(own, dtype=np.int64, count=len(own))])
            labels = np.concatenate([y[train], np.fromiter(own.values(), dtype=y.dtype, count=len(own))])
            w = logistic(x[rows], labels, l2)
            weights.append(w)
            scales.append(logistic(margin(x[held], w)[:, None], y[held], 0.1))
        if turn == rounds or not len(pool):
            break
        for k, (x, w, s) in enumerate(zip(views, weights, scales, strict=True)):
            other = given[1 - k]
            new = pool[~np.isin(pool, np.fromiter(other, dtype=np.int64, count=len(other)))]
            p = sigmoid(margin(margin(x[new], w)[:, None], s))
            for kind, prior in enumerate((1 - y[train].mean(), y[train].mean())):
                sure = np.flatnonzero((p if kind else 1 - p) >= confident)
                best = sure[np.argsort(-np.abs(p[sure] - 0.5), kind="stable")][: max(1, round(growth * len(pool) * prior))]
                other.update(dict.fromkeys(new[best].tolist(), kind))
        grown.append([len(g) for g in given])
    margins = np.stack([margin(margin(x[held], w)[:, None], s) for x, w, s in zip(views, weights, scales, strict=True)], axis=1)
    return {"text": weights[0], "meta": weights[1], "text_scale": scales[0], "meta_scale": scales[1], "both": logistic(margins, y[held], 0.1), "given": np.array(grown, dtype=np.float64).T.ravel()}


def score(model: dict[str, np.ndarray], text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Calibrated probabilities of good quality: by the text, by the metadata, and by both."""
    if not model:
        return (np.ones(len(text)),) * 3
    a, b = (margin(margin(x, model[v])[:, None], model[f"{v}_scale"]) for x, v in ((text, "text"), (meta, "meta")))
    return sigmoid(a), sigmoid(b), sigmoid(margin(np.stack([a, b], axis=1), model["both"]))


FEATURES = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("text", T.BinaryType()), T.StructField("meta", T.BinaryType()),
])


def _view_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels, texts, *meta = (c.to_pylist() for c in batch.columns)
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array([text_view(t or b"").tobytes() for t in texts], pa.binary()),
            pa.array([meta_view(m).tobytes() for m in zip(*meta, strict=True)], pa.binary()),
        ], names=FEATURES.names)


def _fit(options: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, text, meta = [], [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            labels += [-1 if v is None else v for v in batch.column(1).to_pylist()]
            text += batch.column(2).to_pylist()
            meta += batch.column(3).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(repr(ids[i]).encode()), text[i], meta[i], labels[i]))
        views = [np.stack([np.frombuffer(v[i], dtype=np.float32) for i in order]) if order else np.zeros((0, 1), np.float32) for v in (text, meta)]
        model = cotrain(views, np.array([labels[i] for i in order], dtype=np.int64), **options)
        yield pa.RecordBatch.from_arrays([pa.array(list(model), pa.string()), pa.array([w.tolist() for w in model.values()], pa.list_(pa.float64()))], names=["name", "weights"])

    return run


META = ("lang", "source", "n_chars")


def _copies(share: Column, seed: str) -> Column:
    """How many of ``count`` equal rows a sample takes: share * count, with the fraction decided by a hash."""
    wanted = share * F.col("count")
    drawn = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "_key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(wanted) + (drawn < wanted - F.floor(wanted)).cast("long")).cast("int")


def sample(docs: DataFrame, labels: DataFrame, label: str, labelled: int, pool: int, meta: Sequence[str] = META, contradicting=F.min) -> DataFrame:
    """(doc_id, _label, text, metadata) of about ``labelled`` rows of documents with a label and ``pool`` rows without, all if there are no more.

    Both shares are of rows of ``docs``, and they are drawn apart; labels of unknown documents count for nothing.  Rows are told apart by id and content,
    so those that share an id, or have none, are drawn one by one; of equal rows the share of their number is taken.  ``contradicting`` picks one of
    several labels of an id.  Contents are read once for a narrow table of their hashes, and only the rows drawn are dealt.
    """
    docs = docs.select("doc_id", "text", *meta)
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(contradicting(label).cast("int").alias("_label"))
    key = F.xxhash64(F.concat_ws(",", *[F.col(c).isNull() for c in meta]), "text", *meta)
    groups = docs.groupBy("doc_id", key.alias("_key")).count()
    known = groups.where(F.col("doc_id").isNotNull()).join(marks, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "_key", "count", "_label")
    groups = staged(known.union(groups.where(F.col("doc_id").isNull()).select("doc_id", "_key", "count", F.lit(None).cast("int"))), "sample-rows")
    n = groups.groupBy(F.col("_label").isNotNull().alias("labelled")).agg(F.sum("count").alias("n")).collect()
    n = {r.labelled: r.n for r in n}
    shares = [F.lit(min(1.0, wanted / n[of]) if n.get(of) else 1.0) for of, wanted in ((True, labelled), (False, pool))]
    copies = F.when(F.col("_label").isNotNull(), _copies(shares[0], "labelled")).otherwise(_copies(shares[1], "pool"))
    # About labelled + pool narrow rows at most, which also bound what the fit holds in one task, so they are broadcast.
    drawn = groups.withColumn("_copies", copies).where("_copies > 0").select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), "_label", "_copies")
    found = docs.withColumn("_key", key).join(F.broadcast(drawn), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")))
    once = found.select("doc_id", "_key", "_label", "_copies", "text", *meta).dropDuplicates(["doc_id", "_key"])
    return once.withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("doc_id", "_label", "text", *meta)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", labelled: int = LABELLED, pool: int = POOL, **options) -> dict[str, np.ndarray]:
    """The model, fitted on about ``labelled`` labelled documents and ``pool`` others; few numbers, so it comes to the driver.

    Features are made in parallel; only the sample's feature rows, bounded by the two numbers, meet in one task.
    An empty model, which calls everything good, results if the labels lack a class.
    """
    rows = sample(docs, labels, label, labelled, pool)
    views = rows.select(F.col("doc_id").cast("long"), "_label", F.col("text").cast("binary"), *META).mapInArrow(_view_rows, FEATURES)
    model = views.repartition(1).mapInArrow(_fit(options), "name string, weights array<double>").collect()
    return {r.name: np.array(r.weights) for r in model}


SCORES = ("cq_text", "cq_meta", "cq_score")


def _score(broadcast, read: Sequence[str], keep: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in read]
            texts, *meta = (c.to_pylist() for c in columns)
            views = [np.stack(v) if v else np.zeros((0, 1)) for v in ([text_view(t or b"") for t in texts], [meta_view(m) for m in zip(*meta, strict=True)])]
            found = score(model, *views) if texts else [np.zeros(0)] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *map(pa.array, found)], names=[*keep, *SCORES])

    return run


def score_all(docs: DataFrame, model: dict[str, np.ndarray], keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` columns of every document (all by default) with cq_text, cq_meta and cq_score, the probabilities of good quality."""
    keep = [c for c in (keep or docs.columns) if c not in SCORES]
    read = fresh(docs, "cq_bytes", *(f"cq_{c}" for c in META))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], *[F.col(c).cast("binary" if c == "text" else docs.schema[c].dataType).alias(name) for c, name in zip(("text", *META), read, strict=True)])
    schema = T.StructType([*rows.schema.fields[: len(keep)], *[T.StructField(c, T.DoubleType()) for c in SCORES]])
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), read, keep), schema)


#: Documents below this probability of good quality are rejected.
ACCEPT = 0.5


def accepted() -> Column:
    return F.col("cq_score") >= ACCEPT


def report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, text_score, meta_score, score and keep.

    Null and empty texts have a text view of zeros and null metadata is a value of its own, so they get a score like others.  Repeated rows and ids are
    scored row by row; labels that contradict each other count as bad; labels of unknown documents are ignored; without labels
    of both classes everything is kept with score 1; an empty table gives an empty result; other columns are not read.
    """
    found = score_all(docs, fit(docs, labels, **options), keep=["doc_id"])
    return found.select("doc_id", F.col("cq_text").alias("text_score"), F.col("cq_meta").alias("meta_score"), F.col("cq_score").alias("score"), accepted().alias("keep"))


def reject_low_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that the classifier rejects."""
    return score_all(docs, fit(docs, labels, **options)).where(accepted()).select(*[F.col(f"`{c}`") for c in docs.columns])
