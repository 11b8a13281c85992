"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated scores and rejection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm._common import ship

ship(__name__)

#: Labelled documents that the model is fitted on at most (about; dealt evenly to the languages, chosen by hash).
SAMPLE = 12_000
#: Languages learned at most, those with the most documents.
LANGUAGES = 256
#: Logarithm of the number of hash bins of the subwords, and size of an embedding.
BIN_BITS, SIZE = 16, 16
BINS = 1 << BIN_BITS
#: Longest subword; the borders of a word count as a character.
GRAM = 4
#: Documents of one step, and the rate of the first step, from which it falls to nothing.
BATCH, RATE = 16, 20.0
#: One in so many sampled documents is not learned from, but calibrates the scores.
CALIBRATION = 5
#: Words of the piece of every sampled document that is learned beside the whole text, so that short texts are known too.
PIECE = 6
#: Share of errors among accepted calibration texts that the rejection allows.
ERRORS = 0.01
#: Characters that are worked on together; a longer text is cut where a word ends, if there is such a place.
BLOCK = 1 << 18
UNDETERMINED = "und"

#: Odd 64-bit multipliers of the hashes.
MIX, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

#: Which code points of the basic plane are letters.
LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x10000)), dtype=bool, count=0x10000)


def is_letter(points: np.ndarray) -> np.ndarray:
    out = LETTERS[np.minimum(points, 0xFFFF)]
    beyond = np.flatnonzero(points > 0xFFFF)
    if len(beyond):
        kinds, which = np.unique(points[beyond], return_inverse=True)
        out[beyond] = np.array([chr(c).isalpha() for c in kinds.tolist()])[which]
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def blocks(text: str) -> Iterator[np.ndarray]:
    """Code points of the lower-cased text, with one 0 for everything between words and at both ends."""
    text, start = text.lower(), 0
    while start < len(text):
        stop = min(len(text), start + BLOCK)
        while stop < len(text) and stop - start < 2 * BLOCK and text[stop - 1].isalpha():
            stop += 1
        points = np.frombuffer(text[start:stop].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        points = np.concatenate(([0], np.where(is_letter(points), points, 0), [0])).astype(np.uint64)
        yield points[np.concatenate(([True], (points[1:] != 0) | (points[:-1] != 0)))]
        start = stop


def subwords(points: np.ndarray) -> tuple[np.ndarray, int]:
    """Bins of all words of a block, whole and in pieces of up to ``GRAM`` characters, and the number of words."""
    inner = points != 0
    starts = np.flatnonzero(inner[1:] & ~inner[:-1]) + 1
    if not len(starts):
        return np.zeros(0, dtype=np.int64), 0
    hashes, found = points * MIX, []
    found.append(hashes[inner])
    within = np.ones(len(points) - 1, dtype=bool)  # no border but at the ends of the piece
    for n in range(2, min(GRAM, len(points)) + 1):
        hashes = (hashes[:-1] ^ (hashes[:-1] >> np.uint64(29))) * SPREAD + points[n - 1 :] * MIX
        if n > 2:
            within = within[:-1] & inner[n - 2 : -1]
        found.append(hashes[within] + np.uint64(n))
    since = np.zeros(len(points), dtype=np.int64)
    since[starts] = np.diff(starts, prepend=0)
    since = (np.arange(len(points)) - np.cumsum(since)).astype(np.uint64)  # place within the word
    single = points * MIX
    single = (single ^ (single >> np.uint64(31))) * (SPREAD * (since + since + np.uint64(1)))
    found.append(np.add.reduceat(single, starts))
    hashes = np.concatenate(found)
    hashes ^= hashes >> np.uint64(32)
    return ((hashes * MIX) >> np.uint64(64 - BIN_BITS)).astype(np.int64), len(starts)


def whole(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Features of a whole text, block by block."""
    counts, words = np.zeros(BINS, dtype=np.int64), 0
    for points in blocks(text):
        bins, n = subwords(points)
        counts, words = counts + np.bincount(bins, minlength=BINS), words + n
    used = np.flatnonzero(counts)
    return used, (counts[used] / max(1, counts.sum())).astype(np.float32), words


def some_words(text: str, order: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Features of ``PIECE`` consecutive words of a block of the text; ``order`` names the place."""
    parts = list(blocks(text))
    points = parts[order % len(parts)]
    borders = np.flatnonzero(points == 0)
    at = order % max(1, len(borders) - PIECE)
    bins, words = subwords(points[borders[at] : borders[min(at + PIECE, len(borders) - 1)] + 1])
    used, counts = np.unique(bins, return_counts=True)
    return used, (counts / max(1, len(bins))).astype(np.float32), words


class Model:
    """Embeddings of the bins, a linear layer over their average, and the calibration of its margins."""

    def __init__(self, languages: Sequence[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.languages = list(languages)
        self.embeddings = rng.uniform(-1 / SIZE, 1 / SIZE, (BINS, SIZE)).astype(np.float32)
        self.output = np.zeros((SIZE, len(self.languages)), dtype=np.float32)
        #: Margins count exp(a + b * log1p(words)) times: a score of few words is worth less.
        self.sharpness = np.zeros(2)
        self.threshold = 0.0

    def step(self, rows: Sequence[tuple[np.ndarray, np.ndarray, int]], rate: float) -> None:
        """One step of stochastic gradient descent on the mean loss of some rows (bins, shares, language)."""
        averages = np.stack([shares @ self.embeddings[bins] for bins, shares, _ in rows])
        error = softmax(averages @ self.output)
        error[np.arange(len(rows)), [language for _, _, language in rows]] -= 1
        error /= len(rows)
        back = rate * (error @ self.output.T)
        self.output -= rate * (averages.T @ error)
        for (bins, shares, _), change in zip(rows, back, strict=True):
            self.embeddings[bins] -= np.outer(shares, change)  # a row has every bin once

    def margins(self) -> np.ndarray:
        """What one subword of each bin adds to each language."""
        return self.embeddings @ self.output

    def calibrate(self, margins: np.ndarray, words: np.ndarray, truth: np.ndarray, steps: int = 300) -> None:
        """Sharpness by gradient descent on the loss of texts not learned from; the least threshold that keeps errors below ``ERRORS``."""
        if not len(truth):
            return
        length, at = np.log1p(words), np.arange(len(truth))
        centre = margins - margins.mean(axis=1, keepdims=True)
        for _ in range(steps):
            scale = np.exp(self.sharpness[0] + self.sharpness[1] * length)
            p = softmax(centre * scale[:, None])
            slope = scale * ((p * centre).sum(axis=1) - centre[at, truth])
            self.sharpness -= 0.1 * np.clip([slope.mean(), (slope * length).mean()], -1, 1)
        p = self.probabilities(margins, words)
        score, right = p.max(axis=1), p.argmax(axis=1) == truth
        order = np.argsort(-score, kind="stable")
        good = np.cumsum(~right[order]) <= ERRORS * np.arange(1, len(order) + 1)
        self.threshold = float(score[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0

    def probabilities(self, margins: np.ndarray, words: np.ndarray) -> np.ndarray:
        return softmax(margins * np.exp(self.sharpness[0] + self.sharpness[1] * np.log1p(words))[:, None])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


LEARNED = T.StructType([
    T.StructField("order", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("piece", T.BooleanType()), T.StructField("words", T.LongType()),
    T.StructField("bins", T.ArrayType(T.IntegerType())), T.StructField("shares", T.ArrayType(T.FloatType())),
])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every sampled text whole, and a piece of it from a place that its hash names; a batch's worth of texts at a time."""
    for batch in batches:
        orders, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows, found = [], []
        for order, lang, text in zip(orders, langs, batch.column(2), strict=True):
            for piece, (bins, shares, words) in ((False, whole(text.as_py())), (True, some_words(text.as_py(), order))):
                rows.append((order, lang, piece, words))
                found.append((bins, shares))
        ends = np.cumsum([0, *(len(bins) for bins, _ in found)], dtype=np.int32)
        values = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.float32) for k in (0, 1)]
        order, lang, piece, words = zip(*rows, strict=True) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([
            pa.array(order, pa.int64()), pa.array(lang, pa.string()), pa.array(piece, pa.bool_()), pa.array(words, pa.int64()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(values[0].astype(np.int32))), pa.ListArray.from_arrays(pa.array(ends), pa.array(values[1].astype(np.float32))),
        ], names=LEARNED.names)


def _learn(languages: list[str], expected: int):
    """Gradient descent over the rows in their order, then calibration with those of negative order; rows go as they come."""
    place = {lang: k for k, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, step, waiting = Model(languages), 0, []
        steps = max(1, expected // BATCH)
        margins, words, truth = [], [], []
        table = None
        for batch in batches:
            orders, langs, sizes = (batch.column(i).to_pylist() for i in (0, 1, 3))
            bins, shares = batch.column(4), batch.column(5)
            for k, order in enumerate(orders):
                row = (bins[k].values.to_numpy(), shares[k].values.to_numpy(), place[langs[k]])
                if order >= 0:
                    waiting.append(row)
                    if len(waiting) == BATCH:
                        model.step(waiting, RATE * max(0.02, 1 - step / steps))
                        step, waiting = step + 1, []
                    continue
                if table is None:
                    if waiting:
                        model.step(waiting, RATE * 0.02)
                    table = model.margins()
                margins.append(row[1] @ table[row[0]])
                words.append(sizes[k])
                truth.append(row[2])
        model.calibrate(np.array(margins, dtype=np.float64).reshape(-1, len(languages)), np.array(words, dtype=np.float64), np.array(truth, dtype=np.int64))
        table = (model.margins() if table is None else table).astype(np.float64)
        names = [*map(str, range(len(languages))), "sharpness", "threshold"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array([*table.T.tolist(), model.sharpness.tolist(), [model.threshold]], pa.list_(pa.float64()))], names=["name", "numbers"],
        )

    return run


def fit(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> dict:
    """The model from about ``sample`` of the documents that ``usable`` allows, have a language and a letter in their text.

    Languages share the sample evenly, rare ones with all they have.  Documents enter by a hash of id and text, equal
    ones once.  Feature rows are made in parallel, sorted by hash, and learned by one task that holds the model and one
    batch, however long the texts; one document in ``CALIBRATION`` comes last and calibrates.  A sample smaller than
    ``sample`` is learned several times over, so that there are about as many steps.
    """
    key = F.xxhash64(F.lit("language"), F.col(id_col), F.col(text))
    rows = docs.where(usable & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(key.alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return {}
    share, left = {}, sample
    for k, (language, n) in enumerate(sorted(counts.items(), key=lambda c: c[1])):
        taken = min(n, left // (len(counts) - k))  # of what smaller languages leave, each gets an equal part
        share[language], left = taken / n, left - taken
    spark = docs.sparkSession
    shares = spark.createDataFrame([(k, int(v * (1 << 30))) for k, v in share.items()], "lang string, least long")
    chosen = rows.join(F.broadcast(shares), "lang").where(F.pmod("key", F.lit(1 << 30)) < F.col("least")).dropDuplicates(["key"])
    # Negative orders calibrate; they sort last as the order descends.
    order = F.shiftrightunsigned(F.xxhash64(F.lit("order"), "key"), 1)
    ordered = chosen.select(F.when(F.pmod(F.shiftright("key", 30), F.lit(CALIBRATION)) == 0, -order - 1).otherwise(order).alias("order"), "lang", "text")
    languages, size = sorted(counts), sample - left
    again = F.array_repeat(F.lit(0), F.when(F.col("order") < 0, 1).otherwise(-(-sample // size)))
    turns = ordered.mapInArrow(_features, LEARNED).select("*", F.posexplode(again).alias("turn", "_")).drop("_")
    learned = (
        turns.repartition(1).sortWithinPartitions((F.col("order") < 0), "turn", F.desc("order"), "piece").drop("turn")
        .mapInArrow(_learn(languages, 2 * -(-sample // size) * size), "name string, numbers array<double>").collect()
    )
    numbers = {r.name: np.array(r.numbers) for r in learned}
    return {
        "languages": languages, "table": np.stack([numbers[str(k)] for k in range(len(languages))], axis=1).astype(np.float32),
        "sharpness": numbers["sharpness"], "threshold": float(numbers["threshold"][0]),
    }


class Scorer:
    """Best languages and calibrated scores of texts."""

    def __init__(self, model: dict):
        self.languages, self.table, self.threshold = model["languages"], model["table"], model["threshold"]
        self.model = Model.__new__(Model)
        self.model.sharpness = model["sharpness"]

    def texts(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Best language (its place) and calibrated score of texts that have letters."""
        margins, words = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for k, text in enumerate(texts):
            n = 0
            for points in blocks(text):
                bins, found = subwords(points)
                margins[k] += self.table[bins].sum(axis=0, dtype=np.float64)
                words[k], n = words[k] + found, n + len(bins)
            margins[k] /= max(1, n)
        p = self.model.probabilities(margins, words)
        return p.argmax(axis=1), p.max(axis=1)


RESULT = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]


def _predict(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(broadcast.value) if broadcast.value else None
        for batch in batches:
            texts = batch.column(2)
            names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            at = [k for k, t in enumerate(texts) if scorer and has_letter(t.as_py())]
            for start in range(0, len(at), 64):
                some = at[start : start + 64]
                best, score = scorer.texts([texts[k].as_py() for k in some])
                for k, b, s in zip(some, best.tolist(), score.tolist(), strict=True):
                    names[k], scores[k] = scorer.languages[b], s
            accepted = [name != UNDETERMINED and s >= scorer.threshold for name, s in zip(names, scores.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores), pa.array(accepted, pa.bool_())],
                names=["id", "held_out", *[f.name for f in RESULT]],
            )

    return run


def identify(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs``: its id, held_out (not ``usable`` for learning), lang_pred, score and accepted.

    The score is the calibrated probability of lang_pred, the best learned language; ``accepted`` is false where it is
    below the least threshold that kept the share of errors among calibration texts at ``ERRORS``.  Only the text is read
    for a prediction.  Null texts and texts without a letter are ``und`` with score 0 and not accepted, and so is every
    text if nothing could be learned.  Rows without a language are not learned from; rows with a null id are if ``usable``
    allows; repeated rows and ids are predicted row by row, and equal rows learned once; empty tables give an empty result.
    """
    model = fit(docs, F.coalesce(usable, F.lit(False)), text, lang, id_col, sample)
    rows = docs.select(F.col(id_col).alias("id"), (~F.coalesce(usable, F.lit(False))).alias("held_out"), F.col(text).alias("text"))
    schema = T.StructType([*rows.schema.fields[:2], *RESULT])
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), schema).withColumnRenamed("id", id_col)


def report(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``identify`` with the contract's split: documents whose crc32 of the id as text is 2 modulo 4 are held out (a null id counts as empty)."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    return identify(docs, ~held_out, sample=sample)
