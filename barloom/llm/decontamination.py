"""Benchmark decontamination: a broadcast set of normalised benchmark n-grams, scanned over training words."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm._common import ship, staged

ship(__name__)

N_GRAM = 13
#: Bytes of distinct benchmark words that one broadcast set may come from; a larger benchmark is scanned in several passes.  The set
#: takes about 37 bytes per byte: 300 MB in the driver and in each Python worker.
BROADCAST_BYTES = 8 << 20
#: Words of one piece of an item; longer items are cut into pieces that share the windows' overlap.
PIECE_WORDS = 4096
#: Every byte that is no digit, letter or part of a non-ASCII character separates words; A-Z become a-z.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(data: bytes) -> list[bytes]:
    return data.translate(NORMAL).split()


class NgramSet:
    """Hash set of benchmark windows.  A window is ``n`` words; a shorter item is one window."""

    def __init__(self, items: Iterable[tuple[str, bytes]], n: int = N_GRAM):
        self.word_ids: dict[bytes, int] = {}
        self.items_of: dict[bytes, list[str]] = defaultdict(list)
        hashes: dict[int, set[int]] = defaultdict(set)
        for item, data in items:
            words = words_of(data)
            width = min(n, len(words))
            ids = np.array([self.word_ids.setdefault(w, len(self.word_ids) + 1) for w in words], dtype=np.int64)
            for i in range(len(words) - width + 1 if width else 0):
                owners = self.items_of[b" ".join(words[i : i + width])]
                if item not in owners:
                    owners.append(item)
            if width:
                hashes[width].update(self._rolled(ids, width).tolist())
        self.hashes = {width: np.array(sorted(found), dtype=np.uint64) for width, found in sorted(hashes.items())}

    def plain(self) -> tuple:
        """What is broadcast: nothing that an executor would have to import."""
        return self.word_ids, dict(self.items_of), self.hashes

    @classmethod
    def of(cls, plain: tuple) -> NgramSet:
        made = cls(())
        made.word_ids, made.items_of, made.hashes = plain
        return made

    @staticmethod
    def _rolled(ids: np.ndarray, width: int) -> np.ndarray:
        h = np.zeros(len(ids) - width + 1, dtype=np.uint64)
        for j in range(width):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + len(h)].astype(np.uint64)
        return h

    def hits(self, words: Sequence[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie in an occurrence of a window, and the items that occur."""
        hit, items = np.zeros(len(words), dtype=bool), set()
        get = self.word_ids.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for width, hashes in self.hashes.items():
            if len(words) < width:
                break
            starts = np.flatnonzero(known[width:] - known[:-width] == width)
            if not len(starts):
                continue
            rolled = self._rolled(ids, width)[starts]
            place = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
            for i in starts[hashes[place] == rolled].tolist():
                owners = self.items_of.get(b" ".join(words[i : i + width]))  # the hash may lie, the words don't
                if owners:
                    hit[i : i + width] = True
                    items.update(owners)
        return hit, items


def pieces(n: int, words: int = PIECE_WORDS):
    """Items as normalised pieces that hold the same windows; items without words have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, data in zip(batch.column("item").to_pylist(), batch.column("data").to_pylist(), strict=True):
                found = words_of(data)
                cut = [b" ".join(found[at : at + words + n - 1]) for at in range(0, max(len(found) - n + 1, min(1, len(found))), words)]
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(cut), pa.string()), pa.array(cut, pa.binary())], names=["item", "data"])

    return run


def runs(hit: np.ndarray) -> list[int]:
    """Starts and ends of the runs of True, in turn."""
    return np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).tolist()


def cut_words(data: bytes, spans: Sequence[int]) -> bytes:
    """``data`` without the words of ``spans`` and what stands between them."""
    places = [m.span() for m in WORD.finditer(data)]
    out, at = [], 0
    for start, end in zip(spans[::2], spans[1::2], strict=True):
        out.append(data[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*out, data[at:]])


ADDED = T.StructType([
    T.StructField("dc_words", T.LongType()), T.StructField("dc_hits", T.LongType()),
    T.StructField("dc_items", T.ArrayType(T.StringType())), T.StructField("dc_spans", T.ArrayType(T.IntegerType())),
])


def _scan(broadcast, text: str, cut: bool, first: bool, emit_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = NgramSet.of(broadcast.value)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            before = [[]] * len(texts) if first else batch.column("dc_spans").to_pylist()
            owned = [[]] * len(texts) if first else batch.column("dc_items").to_pylist()
            counts, hits, items, spans = [], [], [], []
            for k, data in enumerate(texts):
                words = words_of(data or b"")
                hit, found = grams.hits(words)
                for start, end in zip(before[k][::2], before[k][1::2], strict=True):
                    hit[start:end] = True
                counts.append(len(words))
                hits.append(int(hit.sum()))
                items.append(sorted(found.union(owned[k])))
                spans.append(runs(hit))
                if cut and spans[-1]:
                    texts[k] = cut_words(data, spans[-1])
            names = [name for name in batch.schema.names if name not in ADDED.names and (emit_text or name != text)]
            kept = [batch.column(batch.schema.get_field_index(name)) for name in names]
            if cut and emit_text:
                kept[names.index(text)] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int32()))],
                names=[*names, *ADDED.names],
            )

    return run


def scan(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: Sequence[str] | None = None,
    n: int = N_GRAM, cut: bool = False, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) with dc_words, dc_hits, dc_items and dc_spans.

    dc_hits counts the words inside any occurrence of a benchmark window, dc_items are the items with such windows
    (as strings, sorted), dc_spans the hit runs as word starts and ends.  ``cut`` also removes the runs from the text.

    The benchmark is cut into pieces of distinct words, staged and measured first.  Up to ``broadcast_bytes`` of them become one
    broadcast set; a larger one is dealt by hash into parts of that size, which scan the documents one after the other, the
    hits so far carried along in a staged table.  Documents are never shuffled.  Every candidate that the hashes find is compared word by word.

    Null and empty texts have no words and no hits; items without words never match; null item ids count as the empty
    string and repeated ids as one item; no items or no documents is fine; columns named like the results are replaced.
    """
    spark = docs.sparkSession
    kept = [c for c in (keep or docs.columns) if c not in ADDED.names]
    docs = docs.select(*kept, *([] if text in kept else [text]))
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.coalesce(item_text, F.lit("")).cast("binary").alias("data"))
    items = staged(items.mapInArrow(pieces(n), "item string, data binary").distinct(), "dc-items")
    size = items.agg(F.sum(F.length("data"))).first()[0] or 0
    parts = max(1, -(-size // broadcast_bytes))
    part = F.pmod(F.xxhash64("item", "data"), F.lit(parts))
    out = docs
    for k in range(parts):
        own = items.where(part == k)
        grams = NgramSet(((r.item, bytes(r.data)) for r in own.toLocalIterator()), n)
        last = k == parts - 1
        emit_text = text in kept or not last
        schema = T.StructType([*[f for f in docs.schema.fields if emit_text or f.name != text], *ADDED.fields])
        out = out.mapInArrow(_scan(spark.sparkContext.broadcast(grams.plain()), text, cut and last, k == 0, emit_text), schema)
        if not last:
            out = staged(out, "dc-part")
    return out


def contaminated():
    """The contract's rule: some hit, and at least a twentieth of the words."""
    return (F.col("dc_hits") > 0) & (F.col("dc_hits") * 20 >= F.col("dc_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "drop", **options) -> DataFrame:
    """``docs`` without contaminated documents (``drop``), or with the hit passages cut out of every text (``cut``)."""
    found = scan(docs, benchmark, cut=mode == "cut", **options)
    return (found if mode == "cut" else found.where(~contaminated())).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    return scan(docs.select("doc_id", "text"), benchmark, keep=["doc_id"], **options).select(
        "doc_id", F.col("dc_words").alias("n_words"), F.col("dc_hits").alias("n_hit"), F.size("dc_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("dc_items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )
