"""Exact removal of long repeated byte strings: sampled suffixes sorted on disk, the others induced from them.

The method dealt is external induced sorting.  A suffix tuple for every byte takes ten bytes and more on disk for each byte of text,
and every level of the recursion moves them again.  So this version sorts only a sample of the suffixes and induces the rest:

* A suffix is sampled where a window of ``length`` bytes has its smallest hashed gram (rightmost of equal ones).  Equal windows
  have equal samples at equal places, so nothing is lost; about one byte in twenty-seven is sampled.
* The tuple of a sample is (gram, phrase, document, place): ``phrase`` stands for the common prefix of all windows that belong to the
  sample, which are those that start at lo..hi.  Spark's external sort (sorted runs on disk, merged through a priority queue) brings equal
  tuples together in text order, and a streaming pass decides them: all but the first of a phrase repeat it with every window.
* One level down, the first tuples of different phrases around one gram are induced window by window: each window is hashed (128 bits),
  sorted in the same way, and all but the first occurrence repeat.

A first occurrence of a window always reaches the lower level if another phrase may hold it, so the result is exact up to the hashes: 64 bits tell
the phrases around one gram apart (the gram is the same for all of them), 128 bits tell windows apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm._common import ship, shuffle_partitions, staged
from barloom.llm.winnowing import rolling

ship(__name__)

LENGTH, GRAM = 100, 48
#: Windows of one text that are handled at once, and bytes of texts whose tuples are reduced together before the shuffle.
SEGMENT, GATHER = 1 << 21, 24 << 20
#: Phrases around one gram in one such gathering from which on the gram is dealt by phrase as well.
HOT = 8
NO_ID = -(1 << 63)

# What a tuple knows besides its gram, phrase, document and hash of the text (0 unless the id repeats or is null): start | hi - lo (7 bits) | kind (2 bits).
PLAIN, DEALT, WITNESS, REPEAT = range(4)
TUPLE = T.StructType([T.StructField(n, T.LongType()) for n in ("gram", "phrase", "doc", "th", "about")])
FOUND = T.StructType([T.StructField("doc", T.LongType()), T.StructField("th", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("refine", T.BooleanType())])


def pack(lo: np.ndarray, width: np.ndarray, kind) -> np.ndarray:
    return (lo.astype(np.int64) << 9) | (width.astype(np.int64) << 2) | kind


def unpack(about: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, hi - lo and kind."""
    return about >> 9, (about >> 2) & 0x7F, about & 3


def samples(data: bytes, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per segment: lo and hi of the windows that belong to each sampled suffix, hash of its gram, hash of its phrase."""
    codes, view = np.frombuffer(data, dtype=np.uint8), memoryview(data)
    span = length - gram + 1
    for base in range(0, len(data) - length + 1, SEGMENT):
        h = rolling(codes[base : base + SEGMENT + length - 1], gram)
        low = np.uint64(0xFFFFFF)
        keys = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
        width = 1
        while width * 2 <= span:
            keys = np.minimum(keys[:-width], keys[width:])
            width *= 2
        if width < span:
            keys = np.minimum(keys[: len(keys) - (span - width)], keys[span - width :])
        start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        lo, hi = base + start, base + np.concatenate((start[1:], [len(keys)])) - 1
        at = (low - (keys[start] & low)).astype(np.int64)
        phrase = xxhash.xxh64_intdigest
        phrases = [phrase(view[i : j + length], s) for i, j, s in zip(lo.tolist(), hi.tolist(), (at - start).tolist(), strict=True)]
        yield lo, hi, h[at], np.array(phrases, dtype=np.uint64)


def later(keys: tuple[np.ndarray, ...], doc: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by keys, doc, lo: which start a run of equal keys, and which lie strictly after the start of their run."""
    new = np.zeros(len(doc), dtype=bool)
    if len(new):
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else new.astype(np.int64)
    return new, (doc != doc[first]) | (lo != lo[first])


def joined_runs(doc: np.ndarray, th: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals of window starts with neighbours joined."""
    order = np.lexsort((lo, th, doc))
    doc, th, lo, hi = doc[order], th[order], lo[order], hi[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (lo[1:] > hi[:-1] + 1)
    start = np.flatnonzero(new)
    return doc[start], th[start], lo[start], np.maximum.reduceat(hi, start) if len(start) else hi


def _tuples(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in columns], names=TUPLE.names)


def _reduced(gram, phrase, doc, th, lo, hi, by_gram: bool) -> pa.RecordBatch:
    """What leaves a gathering: the first row of every key, and the intervals of all later ones, which are decided here."""
    order = np.lexsort((lo, doc, phrase, gram))
    gram, phrase, doc, th, lo, hi = (x[order] for x in (gram, phrase, doc, th, lo, hi))
    _, repeats = later((gram, phrase), doc, lo)
    r_doc, r_th, r_lo, r_hi = joined_runs(doc[repeats], th[repeats], lo[repeats], hi[repeats])
    gram, phrase, doc, th, lo, hi = (x[~repeats] for x in (gram, phrase, doc, th, lo, hi))
    kind = np.zeros(len(gram), dtype=np.int64)
    witness = gram[:0]
    if by_gram and len(gram):
        starts = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        many = np.diff(np.concatenate((starts, [len(gram)]))) >= HOT
        kind[np.repeat(many, np.diff(np.concatenate((starts, [len(gram)]))))] = DEALT
        witness = gram[starts[many]]
    none, ended = np.zeros(len(witness), dtype=np.int64), np.zeros(len(r_doc), dtype=np.int64)
    return _tuples(
        np.concatenate([gram, witness, r_hi.astype(np.uint64)]), np.concatenate([phrase, none.astype(np.uint64), ended.astype(np.uint64)]),
        np.concatenate([doc, none, r_doc]), np.concatenate([th, none, r_th]), np.concatenate([pack(lo, hi - lo, kind), pack(none, none, WITNESS), pack(r_lo, ended, REPEAT)]),
    )


def _gathered(rows: Iterator[tuple], by_gram: bool) -> Iterator[pa.RecordBatch]:
    """Rows (bytes, gram, phrase, doc, th, lo, hi) reduced in gatherings of bounded size."""
    held, size = [], 0
    for weight, *row in rows:
        held.append(row)
        size += weight
        if size >= GATHER:
            yield _reduced(*(np.concatenate(c) for c in zip(*held, strict=True)), by_gram)
            held, size = [], 0
    if held:
        yield _reduced(*(np.concatenate(c) for c in zip(*held, strict=True)), by_gram)


def _sample(length: int, gram: int):
    def rows(batches):
        for batch in batches:
            for doc, th, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for lo, hi, g, p in samples(data, length, gram):
                    yield int(hi[-1] - lo[0]) + 1, g, p, np.full(len(lo), doc, dtype=np.int64), np.full(len(lo), th, dtype=np.int64), lo, hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(rows(batches), True)

    return run


def _induce(length: int):
    """Windows of the intervals to refine, hashed one by one."""
    def rows(batches):
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for doc, th, data, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                view, spans = memoryview(data), np.array([(s["lo"], s["hi"]) for s in spans], dtype=np.int64)
                for at in range(0, len(spans), 20_000):
                    p = np.concatenate([np.arange(i, j + 1) for i, j in spans[at : at + 20_000].tolist()])
                    h = np.frombuffer(b"".join([digest(view[i : i + length]) for i in p.tolist()]), dtype=np.uint64).reshape(-1, 2)
                    yield 16 * len(p), h[:, 0], h[:, 1], np.full(len(p), doc, dtype=np.int64), np.full(len(p), th, dtype=np.int64), p, p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(rows(batches), False)

    return run


def _found(doc, th, lo, hi, refine) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(np.asarray(x, dtype=np.int64)) for x in (doc, th, lo, hi)), pa.array(np.asarray(refine, dtype=bool))], names=FOUND.names)


def _decide(by_gram: bool):
    """Goes through sorted tuples with the first one of the current phrase, and the state of the current gram, in hand."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None  # the first tuple of the last phrase
        waiting = None  # the only phrase of the last gram so far; None once the gram has several
        for batch in batches:
            if not batch.num_rows:
                continue
            gram, phrase, doc, th, about = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            decided = about & 3 == REPEAT
            yield _found(doc[decided], th[decided], unpack(about[decided])[0], gram[decided], np.zeros(int(decided.sum()), dtype=bool))
            gram, phrase, doc, th, about = (x[~decided] for x in (gram, phrase, doc, th, about))
            if not len(gram):
                continue
            if carried is not None:
                gram, phrase, doc, th, about = (np.concatenate(([c], x)) for c, x in zip(carried, (gram, phrase, doc, th, about), strict=True))
            lo, width, kind = unpack(about)
            first, repeats = later((gram, phrase, kind), doc, lo)
            repeats &= kind != WITNESS
            yield _found(doc[repeats], th[repeats], lo[repeats], lo[repeats] + width[repeats], np.zeros(int(repeats.sum()), dtype=bool))
            at = int(np.flatnonzero(first)[-1])
            held = (gram[at], phrase[at], doc[at], th[at], about[at])
            if by_gram:
                opens = np.concatenate(([True], gram[1:] != gram[:-1]))
                starts = np.flatnonzero(opens)
                several = np.add.reduceat(first.astype(np.int64), starts) > 1
                several |= np.maximum.reduceat(((kind == DEALT) | (kind == WITNESS)).astype(np.int64), starts) > 0
                known = carried is not None and waiting is None  # the carried gram has several phrases, whose firsts have left
                several[0] |= known
                out = ~repeats & (kind != WITNESS) & np.repeat(several, np.diff(np.concatenate((starts, [len(gram)]))))
                if known:
                    out[0] = False
                yield _found(doc[out], th[out], lo[out], lo[out] + width[out], np.ones(int(out.sum()), dtype=bool))
                waiting = None if several[-1] else held
            carried = held

    return run


def _ordered(tuples: DataFrame, n: int) -> DataFrame:
    kind = F.col("about").bitwiseAND(F.lit(3))
    route = F.when(kind == REPEAT, F.xxhash64("doc")).when(kind == DEALT, F.xxhash64("gram", "phrase")).otherwise(F.col("gram"))
    return tuples.repartition(n, route).sortWithinPartitions("gram", "phrase", kind, "doc", F.shiftright("about", 9))


RESULT = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("kept", T.BinaryType()),
])


def removed_spans(spans: list[dict], size: int, length: int) -> list[int]:
    """Byte starts and ends, in turn, of what intervals of window starts cover."""
    if not spans:
        return []
    lo, hi = np.array([(s["lo"], s["hi"] + length) for s in spans], dtype=np.int64).T
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate(([True], lo[1:] > hi[:-1]))
    starts, ends = lo[new], hi[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(hi) - 1]))]
    return np.stack([starts, ends], axis=1).ravel().tolist()


def _cut(length: int, with_bytes: bool):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, _, data, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                spans = removed_spans(found or [], len(data), length)
                kept = b"".join(data[i:j] for i, j in zip([0, *spans[1::2]], [*spans[::2], len(data)], strict=True))
                out.append((doc, len(data), len(data) - len(kept), len(spans) // 2, hashlib.sha256(kept).hexdigest(), spans if with_bytes else None, kept if with_bytes else None))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 7, kinds, strict=True)], names=RESULT.names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, with_bytes: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept): each text without the bytes that earlier ones repeat.

    A byte goes if it lies in a string of ``length`` bytes that also starts earlier: under a smaller id, or under the same id at an earlier place.
    Texts are UTF-8 bytes, matches never cross texts, and strings are judged on the input.  ``with_bytes`` gives spans and the remaining bytes.

    Tuples are reduced in each task before they are dealt: of thousands of equal passages in a task one leaves it.  A gram with many different
    surroundings is dealt by its phrase as well, so that no gram is a hot key.  Every pass streams sorted rows with a fixed state.

    Null and empty texts, and texts shorter than ``length``, lose nothing.  Rows that share an id and a place are not earlier than each other, so exact repeats
    of a row keep the same bytes; different texts under one id, or under null, are told apart by a 64-bit hash.  A null id is the smallest; an empty table gives an empty result; other columns are not read.
    """
    if not 0 < length - gram + 1 <= 128:
        raise ValueError("a gram must be shorter than the length by 127 bytes at most")
    n = shuffle_partitions(docs.sparkSession)
    own_id = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    # Staged, so that the size of this table, which is small as a rule, is known before the texts are dealt for the join.
    several = staged(docs.groupBy(own_id.alias("doc")).count().where(F.col("count") > 1).where(F.col("doc") != NO_ID).select(F.col("doc").alias("_several")), "suffix-ids")
    texts = docs.select(own_id.alias("doc"), F.xxhash64(text).alias("th"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    texts = texts.join(several, (F.col("doc") == F.col("_several")) & (F.col("doc") != NO_ID), "left").select(
        "doc", F.when(F.col("_several").isNotNull() | (F.col("doc") == NO_ID), F.col("th")).otherwise(F.lit(0).cast("long")).alias("th"), "data",
    )
    found = staged(_ordered(texts.mapInArrow(_sample(length, gram), TUPLE), n).mapInArrow(_decide(True), FOUND), "suffix-tuples")
    dealt = texts.repartition(n, "doc", "th")

    def per_text(rows: DataFrame) -> DataFrame:
        return rows.groupBy("doc", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    refined = dealt.join(per_text(found.where("refine")).hint("shuffle_hash"), ["doc", "th"]).select("doc", "th", "data", "spans")
    windows = _ordered(refined.mapInArrow(_induce(length), TUPLE), n).mapInArrow(_decide(False), FOUND)
    repeats = per_text(found.where("not refine").select("doc", "th", "lo", "hi").union(windows.select("doc", "th", "lo", "hi")))
    cut = dealt.join(repeats.hint("shuffle_hash"), ["doc", "th"], "left").select("doc", "th", "data", "spans").mapInArrow(_cut(length, with_bytes), RESULT)
    own = F.when(F.col("doc") != NO_ID, F.col("doc")).alias(id_col)
    return cut.select(own, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["spans", "kept"] if with_bytes else []))


def report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
