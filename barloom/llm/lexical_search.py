"""Ranked lexical search, reversed: the items' terms are the inverted index, every document streams through it once."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm._common import ship, staged
from barloom.llm.decontamination import words_of

ship(__name__)

#: Documents returned per item.
TOP = 10
#: (item, term) pairs of one broadcast index, about 100 bytes each in a worker; more items make several parts that are searched in turn.
PAIRS = 500_000
#: Scores (documents x items) and postings that are worked on together.
CELLS = 1 << 21
#: The place of documents without an id among equal scores: after all others.
LAST = np.iinfo(np.int64).max
#: Lists of one item that are merged in one task.
FAN_IN = 64


def weight(n_docs: int, holding: int) -> int:
    """w of a term that ``holding`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def damping(n_terms: int, n_docs: int, all_terms: int) -> int:
    """m of a document of ``n_terms`` terms."""
    return 25 + 75 * n_terms * n_docs // all_terms


class Heaps:
    """Per item the ``top`` best (score, document) seen so far; equal scores rank by ascending document.

    The worst entry of each full heap is kept in arrays, so that a block of scores is sifted at once and only
    entries that enter a heap are handled one by one.
    """

    def __init__(self, items: int, top: int):
        self.top = top
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(items)]
        self.least = np.zeros(items, dtype=np.int64)
        self.least_doc = np.full(items, np.iinfo(np.int64).min)

    def update(self, docs: np.ndarray, scores: np.ndarray) -> None:
        """``scores`` has a row per document and a column per item."""
        enters = (scores > self.least) | ((scores == self.least) & (docs[:, None] < self.least_doc))
        for d, i in zip(*np.nonzero(enters), strict=True):
            entry, heap = (int(scores[d, i]), -int(docs[d])), self.heaps[i]
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.top:
                self.least[i], self.least_doc[i] = heap[0][0], -heap[0][1]

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for i, heap in enumerate(self.heaps):
            for score, doc in heap:
                yield i, -doc, score


class Index:
    """Postings of terms as flat arrays: those of term t are ``items[starts[t]:starts[t + 1]]``."""

    def __init__(self, terms: np.ndarray, items: np.ndarray, counts: np.ndarray, weights: np.ndarray):
        order = np.lexsort((items, terms))
        self.items, self.counts, self.weights = items[order], counts[order], weights
        self.starts = np.searchsorted(terms[order], np.arange(len(weights) + 1))

    def scores(self, terms: np.ndarray, tfs: np.ndarray, ends: np.ndarray, damp: np.ndarray, n_items: int) -> np.ndarray:
        """Scores of a block of documents; document d has the entries of ``terms`` and ``tfs`` before ``ends[d]``."""
        lengths = np.diff(np.concatenate(([0], ends)))
        doc = np.repeat(np.arange(len(ends)), lengths)
        # What overflows 64 bits would need a term ten billion times in one text.
        value = self.weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * damp[doc]))
        width = self.starts[terms + 1] - self.starts[terms]
        at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width - self.starts[terms], width)
        out = np.zeros(len(ends) * n_items, dtype=np.int64)
        np.add.at(out, np.repeat(doc * n_items, width) + self.items[at], np.repeat(value, width) * self.counts[at])
        return out.reshape(len(ends), n_items)


COUNTED = T.StructType([
    T.StructField("doc", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType())),
])


def _count(broadcast):
    """Term counts of documents, of the index's terms only; documents without any term go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {term: k for k, term in enumerate(broadcast.value)}
        for batch in batches:
            ids, ns, terms, tfs = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py() or b"")
                if not words:
                    continue
                found = sorted((place[w], n) for w, n in Counter(words).items() if w in place)
                ids.append(doc)
                ns.append(len(words))
                terms.append([t for t, _ in found])
                tfs.append([n for _, n in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=COUNTED.names,
            )

    return run


FOUND = T.StructType([T.StructField("no", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("score", T.LongType())])


def _search(broadcast, n_docs: int, all_terms: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, terms, items, counts, weights = broadcast.value
        index, heaps, n_items = Index(terms, items, counts, weights), Heaps(len(numbers), top), len(numbers)
        width = np.diff(index.starts)
        for batch in batches:
            docs = batch.column(0).fill_null(LAST).to_numpy()
            damp = np.array([damping(n, n_docs, all_terms) for n in batch.column(1).to_pylist()], dtype=np.int64)
            ends = batch.column(2).offsets.to_numpy().astype(np.int64)
            t, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            ends, start = ends[1:] - ends[0], 0
            work = np.concatenate(([0], np.cumsum(width[t])))  # postings before an entry
            while start < len(docs):
                first = ends[start - 1] if start else 0
                stop = min(start + max(1, CELLS // n_items), max(start + 1, int(np.searchsorted(work[ends], work[first] + CELLS, side="right"))))
                cut = slice(first, ends[stop - 1])
                heaps.update(docs[start:stop], index.scores(t[cut], tf[cut], ends[start:stop] - first, damp[start:stop], n_items))
                start = stop
        out = list(heaps.rows())
        no, doc, score = (np.array(c, dtype=np.int64) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        yield pa.RecordBatch.from_arrays([pa.array(numbers[no]), pa.array(doc), pa.array(score)], names=FOUND.names)

    return run


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for no, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = Counter(words_of(text.as_py() or b""))
            yield pa.RecordBatch.from_arrays(
                [pa.array([no] * len(found), pa.int64()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["no", "term", "qtf"],
            )


def _parts(postings: DataFrame, pairs: int) -> int:
    """Into how many parts the items are dealt so that no part of several items holds more than ``pairs`` postings."""
    parts = max(1, -(-postings.count() // pairs))
    while parts > 1:
        sizes = postings.groupBy(F.pmod(F.xxhash64("no"), F.lit(parts)).alias("part")).agg(F.count("*").alias("n"), F.min("no").alias("a"), F.max("no").alias("b"))
        if not sizes.where((F.col("n") > pairs) & (F.col("a") < F.col("b"))).limit(1).count():
            break
        parts *= 2
    return parts


def best(found: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each item, ranked; lists of one item meet ``FAN_IN`` ways before they meet all."""
    order = [F.col("score").desc(), "doc"]
    dealt = found.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(FAN_IN)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("no", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("no").orderBy(*order))).where(F.col("rank") <= top).drop("salt")


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP, pairs: int = PAIRS,
) -> DataFrame:
    """Per item its ``top`` best documents of score above 0: item_id, rank, doc_id, score.

    Terms are runs of digits, letters and non-ASCII characters, only A-Z lower-cased.  The items' postings are the
    index.  They are measured first: up to ``pairs`` of them are broadcast, more are dealt by item into parts of that
    size (a single longer item is a part of its own), and the documents are searched for one part after the other.

    Per part the texts are read once, into a staged table of term counts that holds the index's terms only, from which
    come the number of documents holding each term and then the scores.  Every task keeps one heap of ``top`` entries
    per item; the heaps are merged in two steps.  Documents are not shuffled, however many copies or terms they share.

    Null and empty texts have no terms: such documents are not counted and never found, such items find nothing.
    Rows that repeat an item or its id, and items without an id, are each searched; rows that repeat a document's id
    are each ranked, equal ones next to each other; documents without an id come last among equal scores and are
    returned with a null id.  Empty tables give an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    # Numbers that depend on the order of rows are made once and written down.
    items = staged(items.select(F.col(item_id).alias("item"), F.col(item_text).cast("binary").alias("data"), F.monotonically_increasing_id().alias("no")), "search-items")
    postings = staged(items.select("no", "data").mapInArrow(_index_rows, "no long, term binary, qtf long"), "search-postings")
    parts, answers = _parts(postings, pairs), []
    texts = docs.select(F.col(id_col).cast("long"), F.col(text).cast("binary"))
    for part in range(parts):
        own = postings.where(F.pmod(F.xxhash64("no"), F.lit(parts)) == part).toPandas()
        if own.empty:  # no items, or none dealt here
            continue
        terms = sorted(set(own.term.map(bytes)))
        place = {t: k for k, t in enumerate(terms)}
        counted = staged(texts.mapInArrow(_count(spark.sparkContext.broadcast(terms)), COUNTED), "search-counts")
        n_docs, all_terms = counted.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        holding = np.zeros(len(terms), dtype=np.int64)
        for term, n in counted.select(F.explode("terms").alias("term")).groupBy("term").count().toPandas().itertuples(index=False):
            holding[term] = n
        numbers = np.sort(own.no.unique().astype(np.int64))
        index = (
            numbers, own.term.map(lambda t: place[bytes(t)]).to_numpy(np.int64), np.searchsorted(numbers, own.no.to_numpy(np.int64)),
            own.qtf.to_numpy(np.int64), np.array([weight(n_docs, n) for n in holding.tolist()], dtype=np.int64),
        )
        answers.append(counted.mapInArrow(_search(spark.sparkContext.broadcast(index), n_docs, all_terms, top), FOUND))
    found = answers[0] if answers else spark.createDataFrame([], FOUND)
    for more in answers[1:]:
        found = found.unionByName(more)
    return best(found, top).join(items.select("no", "item"), "no").select(
        F.col("item").alias(item_id), F.col("rank").cast("int").alias("rank"), F.nullif("doc", F.lit(int(LAST))).alias(id_col), "score",
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
t AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM d GROUP BY ALL), q AS (SELECT item_id, term, count(*)::BIGINT AS qtf FROM i GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM t GROUP BY 1), s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS l FROM n),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, s GROUP BY 1),
m AS (SELECT doc_id, 25 + (75 * n * docs) // l AS m FROM n, s),
r AS (SELECT item_id, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY rank <= 10
"""
