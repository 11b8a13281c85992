"""Winnowing fingerprints: rolling k-gram hashes, the minimum of every window, rightmost ties."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm._common import shuffle_partitions, ship, staged

ship(__name__)

#: Characters of a gram and grams of a window: any two texts that share WINDOW + GRAM - 1 characters share a selected hash.
GRAM, WINDOW = 20, 32
BASE = 0x9E3779B97F4A7C15
#: Characters of a text by which rows with the same id are dealt.
HEAD = 64
#: Grams handled at once; longer texts go in blocks that overlap by a window.
BLOCK = 1 << 20


#: Kept per worker; a plain dict, as it travels with the functions that executors get by value.
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if n in _POWERS:
        return _POWERS[n]

    def powers(base: int) -> np.ndarray:
        factors = np.full(n, base, dtype=np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)

    _POWERS[n] = powers(BASE), powers(pow(BASE, -1, 1 << 64))
    return _POWERS[n]


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k neighbouring codes, from running sums of code * BASE**i."""
    if len(codes) < k:
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(1 << (BLOCK + k).bit_length())
    out = []
    for at in range(0, len(codes) - k + 1, BLOCK):
        part = codes[at : at + BLOCK + k - 1].astype(np.uint64) + np.uint64(1)
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(part * up[: len(part)], dtype=np.uint64)))
        h = (sums[k:] - sums[:-k]) * down[: len(sums) - k]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        out.append(h ^ (h >> np.uint64(32)))
    return np.concatenate(out)


def rightmost_minima(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of every window, the rightmost of equal ones, each position once.

    Hashes are compared by their upper 40 bits; the lower 24 hold the position within a block, counted down.
    A sequence shorter than a window is one window.
    """
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    window = min(window, len(hashes))
    found = []
    for at in range(0, len(hashes) - window + 1, BLOCK):
        part = hashes[at : at + BLOCK + window - 1]
        keys = (part & np.uint64(0xFFFFFFFFFF000000)) | (np.uint64(0xFFFFFF) - np.arange(len(part), dtype=np.uint64))
        width = 1
        while width * 2 <= window:
            keys = np.minimum(keys[:-width], keys[width:])
            width *= 2
        if width < window:
            keys = np.minimum(keys[: len(keys) - (window - width)], keys[window - width :])
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
        found.append(at + (np.uint64(0xFFFFFF) - (keys & np.uint64(0xFFFFFF))).astype(np.int64))
    positions = np.concatenate(found)
    return positions[np.concatenate(([True], positions[1:] != positions[:-1]))]


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Selected positions (code points) and their hashes.  A shorter text than a gram is one gram; an empty one has none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    hashes = rolling(codes, max(1, min(gram, len(codes))))
    at = rightmost_minima(hashes, window)
    return at, hashes[at]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two sets of hashes (Jaccard); two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def fingerprint(found: tuple[np.ndarray, np.ndarray]) -> str:
    """Digest of the selected positions and hashes, in order."""
    return hashlib.sha256(found[0].astype("<i8").tobytes() + found[1].astype("<u8").tobytes()).hexdigest()


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SELECTED = "array<struct<position:long,hash:long>>"


def _select(text: str, gram: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            found = [winnow(x or "", gram, window) for x in batch.column(at).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(p) for p, _ in found]))).astype(np.int32)
            flat = [np.concatenate([f[i] for f in found] or [np.zeros(0)]).astype(np.int64 if not i else np.uint64).view(np.int64) for i in (0, 1)]
            marks = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[0]), pa.array(flat[1])], names=["position", "hash"]))
            kept = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*kept, marks], names=[*(n for i, n in enumerate(batch.schema.names) if i != at), "selected"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(id, selected): position and hash of every selected gram, in order.

    Null and empty texts select nothing; a text shorter than a gram is one gram, one shorter than a window of grams is one window;
    of equal hashes the rightmost is taken; repeated rows and null ids are rows like others; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_select("text", gram, window), f"id {dict(rows.dtypes)['id']}, selected {SELECTED}").withColumnRenamed("id", id_col)


PAIR = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
])
#: Rows of the ordered pass: results, and the first and last document of every part, which wait for the neighbouring part.
STEP = T.StructType([*PAIR.fields, T.StructField("kind", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("part", T.IntegerType())])
DONE, FIRST, LAST = 0, 1, 2


def _pair(doc_id, text: str, own, following: str, following_found, gram: int, window: int) -> tuple:
    changed = edited(text, following)
    other = winnow(changed, gram, window)
    return (
        doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(own), fingerprint(other),
        likeness(own[1], other[1]), likeness(own[1], following_found[1]),
    )


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema.fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[f.dataType.simpleString()]) for c, f in zip(columns, schema.fields, strict=True)], names=schema.names)


def _in_order(gram: int, window: int):
    """Documents of one part in order: each meets the next; only the first and the last text leave the part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part = None, TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = winnow(text, gram, window)
                if held is None:
                    rows.append((doc_id, *[None] * 6, FIRST, text, part))
                else:
                    rows.append((*_pair(*held, text, found, gram, window), DONE, None, part))
                held = (doc_id, text, found)
            yield _batch(rows, STEP)
        if held is not None:
            yield _batch([(held[0], *[None] * 6, LAST, held[1], part)], STEP)

    return run


def _across(gram: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([_pair(i, t, winnow(t, gram, window), n, winnow(n, gram, window), gram, window) for i, t, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)], PAIR)

    return run


def edit_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last half replaced by the head of the next document's.

    Texts move once, dealt by ranges of the id and the head of the text and sorted there, so almost every document meets the next in
    its own task.  The first and last text of each part are staged with the results and joined by the numbers of their parts.

    Null and empty texts have no selected grams (likeness 1 to each other, else 0).  Repeated ids are ordered by text; null ids come first;
    a single document follows itself; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), F.col("id"), F.substring("text", 1, HEAD)).sortWithinPartitions("id", "text")
    steps = staged(parts.mapInArrow(_in_order(gram, window), STEP), "winnow-steps")
    # Which part follows which is a matter of their numbers only; as many rows as parts.
    numbers = steps.where(F.col("kind") == FIRST).select("part")
    following = numbers.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())).alias("next"))
    firsts = steps.where(F.col("kind") == FIRST).select(F.col("part").alias("next"), F.col("text").alias("following"))
    lasts = steps.where(F.col("kind") == LAST).select("doc_id", "text", "part")
    paired = lasts.join(following, "part").join(firsts, "next").select("doc_id", "text", "following")
    done = steps.where(F.col("kind") == DONE).select(*PAIR.names)
    return done.union(paired.repartition(shuffle_partitions(docs.sparkSession)).mapInArrow(_across(gram, window), PAIR)).withColumnRenamed("doc_id", id_col)
