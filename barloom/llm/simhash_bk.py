"""SimHash near-duplicates: fingerprints of word shingles, linked through BK-trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from barloom.llm._common import fresh, shuffle_partitions, ship, staged
from barloom.llm._graph import components

ship(__name__)

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Nodes of one tree at most.  A shard with more fingerprints is cut into several trees.
TREE_NODES = 16_384
#: Queries that walk a tree together.
BLOCK = 512
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def simhash(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of UTF-8 text: a bit is set if more than half of the shingle hashes set it."""
    words = data.lower().split()  # on bytes both touch ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    hashed = xxhash.xxh64_intdigest
    n = len(words) - size + 1
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        spans = zip(starts[at:to].tolist(), ends[at + size - 1 : to + size - 1].tolist(), strict=True)
        h = np.array([hashed(joined[i:j], seed) for i, j in spans], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _fingerprints(text: str, shingle: int, seed: int, keep_text: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            bits = [simhash(x or b"", shingle, seed) for x in batch.column(at).cast(pa.binary()).to_pylist()]
            names = [n for i, n in enumerate(batch.schema.names) if keep_text or i != at]
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.array(bits, dtype=np.uint64).view(np.int64))], names=[*names, "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp): the fingerprint as a signed long with the same bits."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_fingerprints("text", shingle, seed), f"id {dict(rows.dtypes)['id']}, fp long")


class BKTree:
    """A BK-tree over distinct 64-bit numbers, kept in arrays and walked by many queries at once.

    ``child[node, d]`` is the node below ``node`` whose subtree lies at Hamming distance ``d`` from it.
    Nodes are placed in their order, level by level, which gives the tree that inserting one by one gives.
    """

    def __init__(self, numbers: np.ndarray):
        self.numbers = numbers
        self.child = np.full((len(numbers), 65), -1, dtype=np.int32)
        slots = self.child.reshape(-1)
        waiting, below = np.arange(1, len(numbers)), np.zeros(max(0, len(numbers) - 1), dtype=np.int64)
        while len(waiting):
            slot = below * 65 + np.bitwise_count(numbers[waiting] ^ numbers[below])
            free = slots[slot] < 0
            open_slots, first = np.unique(slot[free], return_index=True)
            slots[open_slots] = waiting[free][first]
            below = slots[slot].astype(np.int64)
            left = below != waiting
            waiting, below = waiting[left], below[left]

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) at most ``radius`` apart, block by block; only edges d-radius..d+radius are followed."""
        for at in range(0, len(queries), BLOCK):
            q = np.arange(at, min(len(queries), at + BLOCK))
            node = np.zeros(len(q), dtype=np.int64)
            while len(q):
                d = np.bitwise_count(self.numbers[node] ^ queries[q]).astype(np.int64)
                near = d <= radius
                yield q[near], node[near]
                nexts = []
                for edge in range(-radius, radius + 1):
                    k = d + edge
                    ok = (k > 0) & (k <= 64)
                    below = self.child[node[ok], k[ok]]
                    has = below >= 0
                    nexts.append((q[ok][has], below[has].astype(np.int64)))
                q = np.concatenate([x for x, _ in nexts])
                node = np.concatenate([x for _, x in nexts])


def _few(numbers: list[int], others: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """The same for a few numbers, without arrays: a tree is (number, children by distance)."""
    tree, links = None, []

    def look(q: int) -> None:
        stack = [tree] if tree else []
        while stack:
            number, children = stack.pop()
            d = (number ^ q).bit_count()
            if d <= radius:
                links.append((number, q))
            stack.extend(children[k] for k in range(max(1, d - radius), d + radius + 1) if k in children)

    for q in numbers:
        if others is None:
            look(q)
        if tree is None:
            tree = (q, {})
            continue
        number, children = tree
        while (k := (number ^ q).bit_count()) in children:
            number, children = children[k]
        children[k] = (q, {})
    for q in others or ():
        look(q)
    return links


class _Sets:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            r = self.up[x]
            if (r == x).all():
                return r
            self.up[x] = self.up[r]
            x = r

    def link(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Join the sets of a[i] and b[i]; the pairs that did join two sets."""
        made = []
        ra, rb = self.roots(a), self.roots(b)
        new = np.flatnonzero(ra != rb)
        if not len(new):
            return made
        _, first = np.unique(ra[new] * len(self.up) + rb[new], return_index=True)
        for i in new[first].tolist():
            x, y = int(ra[i]), int(rb[i])
            while self.up[x] != x:
                x = int(self.up[x])
            while self.up[y] != y:
                y = int(self.up[y])
            if x != y:
                self.up[max(x, y)] = min(x, y)
                made.append((int(a[i]), int(b[i])))
        return made


def shard_links(numbers: np.ndarray, others: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links that hold together what lies within ``radius``: among ``numbers``, or between them and ``others``.

    A spanning set only: at most one link for every number, never all pairs.
    """
    if len(numbers) + (0 if others is None else len(others)) <= 24:
        return _few(numbers.tolist(), None if others is None else others.tolist(), radius)
    if not len(numbers):
        return []
    tree = BKTree(numbers)
    sets = _Sets(len(numbers) + (0 if others is None else len(others)))
    queries, shift = (numbers, 0) if others is None else (others, len(numbers))
    links = []
    everything = numbers if others is None else np.concatenate([numbers, others])
    for q, node in tree.within(queries, radius):
        links.extend(sets.link(q + shift, node))
    return [(int(everything[i]), int(everything[j])) for i, j in links]


def _walk(radius: int):
    """Rows come sorted by shard; a shard has at most two trees' worth of rows."""

    def flush(parts: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        if not parts:
            return []
        fp = np.concatenate([p.column(3).to_numpy(zero_copy_only=False) for p in parts]).view(np.uint64)
        side = np.concatenate([p.column(4).to_numpy(zero_copy_only=False) for p in parts])
        numbers, others = fp[side == 0], fp[side == 1]
        same = parts[0].column(1)[0].as_py() == parts[0].column(2)[0].as_py()
        return shard_links(numbers, None if same else others, radius) if len(fp) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            out = []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(keys[:, i].tolist())
                if key != last:
                    out.extend(flush(held))
                    held, last = [], key
                held.append(batch.slice(i, j - i))
            yield _link_batch(out)
        yield _link_batch(flush(held))

    return run


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def near_links(numbers: DataFrame, fp: str = "fp", radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all that lie within ``radius`` bits of each other.

    Two numbers within r bits agree on one of r + 1 bands of bits, so every band value is a shard.  A shard with more
    than ``tree_nodes`` numbers is cut by hash into trees of about that size, and each tree is sent to the shard's numbers in
    blocks: no number is left out, no task holds more than two trees, and the links given for one task are
    a spanning set.  Trees go to their queries by shuffle instead of by broadcast: their total size grows with the data.
    """
    width = [64 // (radius + 1) + (i < 64 % (radius + 1)) for i in range(radius + 1)]
    low = [sum(width[:i]) for i in range(radius + 1)]
    bands = [F.shiftleft(F.lit(i).cast("long"), 60) + F.shiftrightunsigned(F.shiftleft(F.col(fp), 64 - low[i] - width[i]), 64 - width[i]) for i in range(radius + 1)]
    banded = numbers.select(F.col(fp).cast("long").alias("fp"), F.explode(F.array(*bands)).alias("shard"))
    sizes = banded.groupBy("shard").count().where("count > 1").select("shard", F.ceil(F.col("count") / tree_nodes).cast("int").alias("trees"))
    mine = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    dealt = (
        banded.join(sizes, "shard")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
        .select(
            "shard", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp",
            F.when((F.col("mine") > F.col("other")), 1).otherwise(0).alias("side"),
        )
    )
    n = max(shuffle_partitions(numbers.sparkSession), 1)
    return dealt.repartition(n, "shard", "i", "j").sortWithinPartitions("shard", "i", "j").mapInArrow(_walk(radius), "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, tree_nodes: int = TREE_NODES,
) -> DataFrame:
    """(id, fp, group, component): one row per document; component is the smallest id of its group, group one of its fingerprints.

    Documents are grouped by equal fingerprint first, so thousands of copies are one number in the trees; links join
    different fingerprints within ``radius`` bits.  Words end at ASCII white space, A-Z count as a-z.  Null, empty
    and blank texts have fingerprint 0 and are linked like any other; texts of fewer words than a shingle hash as a whole.
    Repeated rows and ids stay rows; null ids are members but never name a group that has another id.  An empty table gives an
    empty result; other columns are not read.
    """
    rows = staged(fingerprints(docs, id_col, text, shingle), "simhash")
    numbers = staged(rows.groupBy("fp").agg(F.min("id").alias("low")), "simhash-numbers")
    roots = components(near_links(numbers, "fp", radius, tree_nodes), "a", "b")
    rooted = numbers.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("group"))
    lowest = rooted.groupBy("group").agg(F.min("low").alias("component"))
    groups = rooted.select("fp", "group").join(lowest, "group")
    return rows.join(groups, "fp").select(F.col("id").alias(id_col), "fp", "group", "component")


def fingerprint_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Near copies share at least SIMILAR of the distinct COPY_SHINGLE-word shingles of both.  Their fingerprints over those shingles differ
#: in 10 bits on average at that likeness (standard deviation 3), those of unrelated texts in 32 (4).
SIMILAR, COPY_SHINGLE, COPY_RADIUS = 0.8, 5, 22
#: Shards of near copies: BANDS keys of ROWS minima each; texts of likeness SIMILAR have one in common 997 times in 1,000.
BANDS, ROWS = 8, 3
#: Texts of one tree at most when their shingles travel with them.
COPY_NODES = 4_096
_MULTIPLIERS = np.array([xxhash.xxh64_intdigest(b"%d" % i, SEED) | 1 for i in range(BANDS * ROWS)], dtype=np.uint64)


def shingle_hashes(data: bytes, shingle: int = COPY_SHINGLE, seed: int = SEED) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; a text of fewer words is one shingle, one without words has none."""
    words = data.lower().split()
    size, hashed = min(shingle, len(words)), xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True) if words else ()
    return np.unique(np.fromiter((hashed(joined[i:j], seed) for i, j in spans), dtype=np.uint64))


def copy_sketch(hashes: np.ndarray) -> tuple[int, list[int]]:
    """SimHash over the distinct shingles, and the shards of a text; both signed."""
    if not len(hashes):
        return 0, [0]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype(">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    fp = np.packbits(counts * 2 > len(hashes)).view(">u8").astype(np.uint64)
    minima = np.array([(hashes * m).min() for m in _MULTIPLIERS], dtype=np.uint64).reshape(BANDS, ROWS)
    shards = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        shards = (shards ^ minima[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        shards ^= shards >> np.uint64(29)
    return int(fp.view(np.int64)[0]), shards.view(np.int64).tolist()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the distinct shingles of two texts that both have; 1 if neither has any."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [copy_sketch(shingle_hashes(t.as_py() or b"")) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([f for f, _ in found], pa.int64()), pa.array([s for _, s in found], pa.list_(pa.int64()))], names=["id", "key", "fp", "shards"],
        )


DEALT = StructType([StructField(c, LongType()) for c in ("shard", "i", "j", "side", "fp")] + [StructField("key", BinaryType()), StructField("hashes", BinaryType())])


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's row for every shard of it that other texts share, and there for every pair of trees with its own."""
    for batch in batches:
        for key, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            hashes = shingle_hashes(text.as_py() or b"")
            fp, _ = copy_sketch(hashes)
            packed, rows = np.unique((hashes >> np.uint64(32)).astype(np.uint32)).tobytes(), []
            for place in places:
                mine = int.from_bytes(key[:8], "little") % place["trees"]
                rows += [(place["shard"], min(mine, other), max(mine, other), int(mine > other), fp) for other in range(place["trees"])]
            for at in range(0, len(rows), 256):
                part = rows[at : at + 256]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(list(c), pa.int64()) for c in zip(*part, strict=True)), pa.array([key] * len(part), pa.binary()), pa.array([packed] * len(part), pa.binary())], names=DEALT.names,
                )


def copy_links(fps: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, radius: int, similar: float) -> list[tuple[int, int]]:
    """Links (places) that hold together the texts of ``similar`` likeness or more: among all, or between sides 0 and 1.

    The BK-tree over the fingerprints names candidates; each is compared by its shingles unless the two texts already hang together.
    """
    if side is None:
        tree_at, query_at = np.arange(len(fps)), np.arange(len(fps))
    else:
        tree_at, query_at = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(tree_at) or not len(query_at):
        return []
    tree_at = tree_at[np.argsort(fps[tree_at], kind="stable")]
    numbers, first, held = np.unique(fps[tree_at], return_index=True, return_counts=True)
    tree, hung, links = BKTree(numbers), _Sets(len(fps)), []
    for q, node in tree.within(fps[query_at], radius):
        a, n = np.repeat(query_at[q], held[node]), held[node]  # every text that has the node's fingerprint
        b = tree_at[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[node], n)]
        while True:
            ra, rb = hung.roots(a), hung.roots(b)
            apart = ra != rb
            if not apart.any():
                break
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            _, tried = np.unique(np.minimum(ra, rb) * len(fps) + np.maximum(ra, rb), return_index=True)  # one pair for two sets
            alike = np.array([likeness(sets[x], sets[y]) >= similar for x, y in zip(a[tried].tolist(), b[tried].tolist(), strict=True)])
            links += hung.link(a[tried[alike]], b[tried[alike]])
            left = np.ones(len(a), dtype=bool)
            left[tried] = False
            a, b = a[left], b[left]
    return links


LINKED = StructType([StructField("a", BinaryType()), StructField("b", BinaryType())])


def _confirm(radius: int, similar: float):
    """Rows come sorted by shard and pair of trees, two trees' worth at most."""
    def links(rows: list[tuple]) -> list[tuple[bytes, bytes]]:
        if len(rows) < 2:
            return []
        fps = np.array([r[4] for r in rows], dtype=np.int64).view(np.uint64)
        side = np.array([r[3] for r in rows]) if rows[0][1] != rows[0][2] else None
        found = copy_links(fps, [np.frombuffer(r[6], dtype=np.uint32) for r in rows], side, radius, similar)
        return [(rows[a][5], rows[b][5]) for a, b in found if rows[a][5] != rows[b][5]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][:3] != row[:3]:
                    out += links(held)
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=LINKED.names)
        out = links(held)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=LINKED.names)

    return run


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", similar: float = SIMILAR, radius: int = COPY_RADIUS, tree_nodes: int = COPY_NODES,
) -> DataFrame:
    """(id, key, group): one row per document; ``key`` is the MD5 of its text, ``group`` one key of its group.

    Equal texts are one text.  Texts that share a shard, which near copies do with very few exceptions (``BANDS``), meet there: a BK-tree over
    the SimHash of their distinct five-word shingles names the candidates within ``radius`` bits, and the shingles themselves decide, so
    every link stands for a likeness of ``similar`` or more.  Shards beyond ``tree_nodes`` texts are cut into trees that meet in pairs.
    A text is shuffled once, reduced to one of its copies before that; its shingles go to the shards that another text shares, as 32-bit hashes.

    Null, empty and blank texts have no shingles and are alike.  Repeated rows and ids, null ids too, stay rows; an empty table gives an empty
    result; other columns are not read.
    """
    spark = docs.sparkSession
    digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))
    plain = docs.select(F.col(id_col).alias("id"), digest.alias("key"), F.col(text).cast("binary").alias("data"))
    schema = StructType([plain.schema["id"], StructField("key", BinaryType()), StructField("fp", LongType()), StructField("shards", ArrayType(LongType()))])
    rows = staged(plain.mapInArrow(_sketches, schema), "copy-sketches")
    banded = rows.groupBy("key").agg(F.first("shards").alias("shards")).select("key", F.explode("shards").alias("shard"))
    sizes = banded.groupBy("shard").count().where("count > 1").select("shard", F.ceil(F.col("count") / tree_nodes).cast("int").alias("trees"))
    wanted = banded.join(sizes, "shard").groupBy("key").agg(F.collect_list(F.struct("shard", "trees")).alias("places"))
    texts = plain.groupBy("key").agg(F.first("data").alias("data")).join(wanted, "key").select("key", "data", "places")
    n = max(shuffle_partitions(spark), 1)
    dealt = texts.mapInArrow(_deal, DEALT).repartition(n, "shard", "i", "j").sortWithinPartitions("shard", "i", "j")
    roots = components(dealt.mapInArrow(_confirm(radius, similar), LINKED), "a", "b")
    grouped = rows.select("id", "key").join(roots.withColumnRenamed("node", "key"), "key", "left")
    return grouped.select(F.col("id").alias(id_col), "key", F.coalesce("root", "key").alias("group"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group of near copies: that with the smallest id, null ids last.

    If that id occurs on several rows of the group, the row with the smallest MD5 of its text stays, and of equal texts any one.
    """
    found = staged(near_copies(docs, id_col, text, **options).withColumnRenamed(id_col, "id"), "copy-groups")
    best = found.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("best")).select("best.id", "best.key")
    count = found.groupBy("id", "key").count()
    own_id, own_key = fresh(docs, "id", "key")
    stays = best.join(count, best.id.eqNullSafe(count.id) & (best.key == count.key)).select(best.id.alias(own_id), best.key.alias(own_key), "count")
    marked = docs.withColumn(own_key, F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))))

    def of(some: DataFrame) -> DataFrame:
        other = some.select(F.col(own_id).alias(f"{own_id}_"), F.col(own_key).alias(f"{own_key}_"))
        return marked.join(other, marked[id_col].eqNullSafe(other[f"{own_id}_"]) & (marked[own_key] == other[f"{own_key}_"]), "left_semi")

    names = [F.col(f"`{c}`") for c in docs.columns]
    several = of(stays.where("count > 1")).select(F.col(f"`{id_col}`").alias("id"), F.col(own_key).alias("key"), F.struct(*names).alias("row"))
    picked = several.groupBy("id", "key").agg(F.first("row").alias("row")).select("row.*")
    return of(stays.where("count = 1")).select(*names).unionByName(picked)
