"""Repair of conversation structure: the cheapest edits that make the roles alternate, by bidirectional Dijkstra."""

from __future__ import annotations

import hashlib
import heapq
from array import array
from collections import deque
from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from barloom.llm._common import ship, staged

ship(__name__)

WHITE = " \t\n\x0b\f\r"
#: States of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a.  A conversation may end in the first and the last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
#: A row's code: its initial (s, u, a or another) and two marks.
INITIALS = {"s": 0, "u": 1, "a": 2}
OTHER, TRUNCATED, DELETE = 3, 4, 8
INSERT_COST, REROLE_COST, DELETE_COST, TRUNCATED_COST = 2, 2, 3, 1
#: Rows or bytes of text that are handed on together.
OUT_ROWS, OUT_BYTES = 4096, 8 << 20


def after(state: int) -> int:
    """The state behind a user or assistant row that is put where the pattern wants one."""
    return ASSISTANT if state == USER else USER


def kept(state: int, initial: int) -> int | None:
    """The state behind a kept row, if the pattern takes it."""
    if initial == 0:
        return SYSTEM if state == NOTHING else None
    return after(state) if initial == after(state) - 1 else None


class Lattice:
    """Nodes 4 * i + state: i rows are dealt with.  Edges are edits; from any node, at most one per initial."""

    def __init__(self, codes: Sequence[int]):
        self.codes, self.size = codes, 4 * (len(codes) + 1)
        self.ends = [4 * len(codes) + state for state in ENDS]

    def forward(self, node: int) -> Iterator[tuple[str, int, int]]:
        """(initial, node, cost) of the edits that start here, by initial."""
        i, state = divmod(node, 4)
        row = self.codes[i] if i < len(self.codes) else None
        if row is not None:
            yield "D", node + 4, DELETE_COST
        yield "I", 4 * i + after(state), INSERT_COST
        if row is not None and not row & DELETE:
            extra = TRUNCATED_COST if row & TRUNCATED else 0
            to = kept(state, row & 3)
            if to is not None:
                yield "K", 4 * i + 4 + to, extra
            yield "R", 4 * i + 4 + after(state), REROLE_COST + extra

    def backward(self, node: int) -> Iterator[tuple[int, int]]:
        """(node, cost) of the edits that end here."""
        i, state = divmod(node, 4)
        before = (USER,) if state == ASSISTANT else (NOTHING, SYSTEM, ASSISTANT) if state == USER else ()
        for b in before:
            yield 4 * i + b, INSERT_COST
        if i:
            row, at = self.codes[i - 1], 4 * i - 4
            yield at + state, DELETE_COST
            if not row & DELETE:
                extra = TRUNCATED_COST if row & TRUNCATED else 0
                for b in before:
                    yield at + b, REROLE_COST + extra
                if row & 3 == 0 and state == SYSTEM:
                    yield at + NOTHING, extra
                elif row & 3 in (1, 2) and state == (row & 3) + 1:
                    for b in before:
                        yield at + b, extra


def cheapest(codes: Sequence[int]) -> tuple[int, str]:
    """Least cost and, of the cheapest edits, the ASCII-least string of initials.

    Two heaps grow costs from the start and from both ends.  Once their least costs together exceed the best way found,
    every cheapest way crosses from a node that the first has settled to one that the second has, so all of them are
    known.  Those crossings are marked back to the start along edges that lose nothing, and the initials are then read
    off by the least edit that still leads to a crossing or, behind it, to an end.  An edit string never is the
    beginning of another of the same cost between two nodes, so the first difference decides.
    """
    net = Lattice(codes)
    size, far = net.size, 1 << 30
    ahead, back = array("i", [far]) * size, array("i", [far]) * size
    front, rear = [0], list(net.ends)  # entries are cost * size + node
    heapq.heapify(rear)
    ahead[0] = 0
    for end in net.ends:
        back[end] = 0
    best = min(ahead[end] for end in net.ends)
    while front and rear and front[0] // size + rear[0] // size <= best:
        if (front[0] // size, len(front)) <= (rear[0] // size, len(rear)):
            cost, node = divmod(heapq.heappop(front), size)
            if cost > ahead[node]:
                continue
            for _, to, more in net.forward(node):
                if cost + more < ahead[to]:
                    ahead[to] = cost + more
                    heapq.heappush(front, (cost + more) * size + to)
                    best = min(best, cost + more + back[to])
        else:
            cost, node = divmod(heapq.heappop(rear), size)
            if cost > back[node]:
                continue
            for to, more in net.backward(node):
                if cost + more < back[to]:
                    back[to] = cost + more
                    heapq.heappush(rear, (cost + more) * size + to)
                    best = min(best, cost + more + ahead[to])
    leads = bytearray(size)
    stack = [
        u for u in range(size)
        if ahead[u] <= best and (ahead[u] + back[u] == best or any(ahead[u] + w + back[v] == best for _, v, w in net.forward(u)))
    ]
    for u in stack:
        leads[u] = 1
    while stack:
        u = stack.pop()
        for p, w in net.backward(u):
            if not leads[p] and ahead[p] + w == ahead[u]:
                leads[p] = 1
                stack.append(p)
    node, cost, audit = 0, 0, []
    while not (cost == best and node in net.ends):
        for initial, to, w in net.forward(node):
            if (leads[to] and ahead[to] == cost + w) or cost + w + back[to] == best:
                audit.append(initial)
                node, cost = to, cost + w
                break
        else:
            raise AssertionError("no cheapest edit goes on from here")
    return best, "".join(audit)


def first_seen(hashes: np.ndarray) -> np.ndarray:
    """Which rows of an (n, 2) array of numbers equal none before them."""
    order = np.lexsort((hashes[:, 1], hashes[:, 0]))
    ordered = hashes[order]
    new = np.ones(len(order), dtype=bool)
    new[order[1:]] = (ordered[1:] != ordered[:-1]).any(axis=1)
    return new


REPORT = [T.StructField(name, T.LongType()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]


def _rows(conversations: DataFrame, copies: str | None) -> DataFrame:
    """The rows with nulls as one space, the hash of the text, and how often each stands there."""
    text = F.coalesce("text", F.lit(" "))
    return conversations.select(
        F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), F.unhex(F.md5(text)).alias("hash"),
        (F.col(copies).cast("int") if copies else F.lit(1)).alias("copies"),
    )


def _narrow(rows: DataFrame) -> DataFrame:
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    return rows.select(
        "conv", "turn", "role", "hash", "copies", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"),
        F.unhex(F.md5(F.concat("role", F.lit("\0"), F.hex("hash")))).alias("same"),
    )


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[pa.RecordBatch]]]:
    """Consecutive pieces of batches with the same value in the first column."""
    def pieces():
        for batch in batches:
            conv, start = batch.column(0).to_pylist(), 0
            for key, run in groupby(conv):
                n = sum(1 for _ in run)
                yield key, batch.slice(start, n)
                start += n

    for key, run in groupby(pieces(), key=lambda piece: piece[0]):
        yield key, [piece for _, piece in run]


def _edit(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for conv, pieces in _conversations(batches):
            rows = pa.Table.from_batches(pieces)
            copies = rows["copies"].to_numpy()
            at = np.repeat(np.arange(len(copies)), copies)
            report = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0) | {"audit": ""}
            if len(at):
                blank, cut = (rows[name].combine_chunks().to_numpy(zero_copy_only=False)[at] for name in ("blank", "truncated"))
                same = np.frombuffer(b"".join(rows["same"].to_pylist()), dtype="<u8").reshape(-1, 2)[at]
                repeat = ~first_seen(same) & ~blank
                cut = cut & ~blank & ~repeat
                initials = np.array([INITIALS.get(role[:1], OTHER) for role in rows["role"].to_pylist()], dtype=np.uint8)[at]
                pairs = initials[:-1].astype(np.int64) * 4 + initials[1:]
                turns = rows["turn"].filter(pa.array(copies > 0)).drop_null().unique().to_pylist()
                codes = (initials + TRUNCATED * cut + DELETE * (blank | repeat)).astype(np.uint8).tobytes()
                cost, audit = cheapest(codes)
                report = {
                    "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, "blank": int(blank.sum()), "duplicate": int(repeat.sum()),
                    "truncated": int(cut.sum()), "illegal": int((~np.isin(pairs, (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))).sum()), "cost": cost, "audit": audit,
                }
                ends = [k + 1 for k, edit in enumerate(audit) if edit != "I"]
                ends[-1] = len(audit)  # what is inserted last goes with the last row
                starts = [0, *ends[:-1]]
                turn, role, text_hash = (rows[name].to_pylist() for name in ("turn", "role", "hash"))
                last, nth = None, 0
                for k, first, n in zip(range(len(copies)), np.cumsum(copies) - copies, copies.tolist(), strict=True):
                    if n:
                        key = (turn[k], role[k], text_hash[k])
                        last, nth = key, nth + 1 if key == last else 0
                        out.append({"conv": conv, "turn": turn[k], "role": role[k], "hash": text_hash[k], "nth": nth, "edits": audit[starts[first] : ends[first + n - 1]]})
                        if len(out) >= OUT_ROWS:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out = []
            out.append({"conv": conv, **report})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


#: Ascending, which puts null turns first.
ORDER = ["conv", "turn", "role", "hash"]


def edits(conversations: DataFrame, copies: str | None = None) -> DataFrame:
    """One row per conversation with its faults, cost and audit, and one per row of it with the edits there; staged.

    Rows of the second kind have an ``edits`` string: the inserts before the row, then its own edit, for every copy;
    ``nth`` numbers equal rows.  Texts are not shuffled for this, only their hashes.
    """
    rows = _rows(conversations, copies)
    key = [rows.schema["conv"], rows.schema["turn"], rows.schema["role"], rows.schema["hash"]]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in key], T.StructField("nth", T.LongType()), T.StructField("edits", T.StringType()), *REPORT, T.StructField("audit", T.StringType())])
    found = _narrow(rows).repartition("conv").sortWithinPartitions(*ORDER).mapInArrow(_edit(to_arrow_schema(schema)), schema)
    return staged(found, "conversation-edits")


def _apply(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        conv, position, state, first = None, 0, NOTHING, True
        pending: deque[str] = deque()
        for batch in batches:
            keys, roles, todo = (batch.column(batch.schema.get_field_index(name)).to_pylist() for name in ("conv", "role", "edits"))
            texts = batch.column(batch.schema.get_field_index("text"))
            for k, (key, role, edit) in enumerate(zip(keys, roles, todo, strict=True)):
                if first or key != conv:
                    conv, position, state, first = key, 0, NOTHING, False
                    pending.clear()
                if edit is not None:
                    pending.append(edit)
                    continue
                text = texts[k].as_py()
                for letter in pending.popleft():
                    if letter == "D":
                        continue
                    state = kept(state, INITIALS[role[:1]]) if letter == "K" else after(state)
                    named = role if letter == "K" else "assistant" if state == ASSISTANT else "user"
                    content = "" if letter == "I" else text
                    out.append({"conv": conv, "position": position, "role": named, "text": content, "edit": letter})
                    position += 1
                    size += len(content)
                    if len(out) >= OUT_ROWS or size >= OUT_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def apply_edits(conversations: DataFrame, found: DataFrame, copies: str | None = None) -> DataFrame:
    """The repaired rows: conv, position, role, text and edit (K, R or I), a conversation's rows next to each other and in order."""
    rows = _rows(conversations, copies).where("copies > 0")
    none = {f.name: F.lit(None).cast(f.dataType) for f in found.schema.fields}
    key = ["conv", "turn", "role", "hash"]
    steps = found.where(F.col("hash").isNotNull()).select(*key, "nth", "edits", F.lit(None).cast("string").alias("text"), F.lit(0).alias("kind"))
    texts = rows.select(*key, none["nth"].alias("nth"), none["edits"].alias("edits"), "text", F.lit(1).alias("kind"))
    schema = T.StructType([
        T.StructField("conv", found.schema["conv"].dataType), T.StructField("position", T.LongType()), *[T.StructField(name, T.StringType()) for name in ("role", "text", "edit")],
    ])
    both = steps.unionByName(texts).repartition("conv").sortWithinPartitions(*ORDER, "kind", "nth")
    return both.mapInArrow(_apply(to_arrow_schema(schema)), schema)


def _digest(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, out = None, None, []
        for batch in batches:
            keys, positions, roles = (batch.column(i).to_pylist() for i in range(3))
            texts = batch.column(3)
            for k, position in enumerate(positions):
                if position == 0:
                    if digest:
                        out.append({"conv": conv, "repaired_sha256": digest.hexdigest()})
                    conv, digest = keys[k], hashlib.sha256()
                digest.update(b"\n" * (position > 0) + roles[k].encode() + b":" + texts[k].as_py().encode())
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if digest:
            yield pa.RecordBatch.from_pylist([{"conv": conv, "repaired_sha256": digest.hexdigest()}], schema)

    return run


def repair(conversations: DataFrame, copies: str | None = None) -> DataFrame:
    """The repaired conversations: conv_id, position, role, text and edit.

    A row's first fault counts: blank (nothing but white space), duplicate (role and text seen earlier in the
    conversation), truncated (does not end in . ! or ?).  Blank rows and duplicates are deleted (3); other rows are
    kept (0), get another role (2) or are deleted (3); rows without text are inserted (2); a truncated row that stays
    costs 1.  The roles' initials come out as (s?(ua)+)? at the least cost, and of such edits those with the
    ASCII-least initials are taken.

    A conversation's rows go by turn, nulls first, ties by role and hash of the text.  Null ids are one
    conversation, null roles and texts are one space (which is blank); an empty role or one with another initial fits
    nowhere; repeated rows are duplicates; an empty table gives an empty result; other columns are not read.
    ``copies`` names a column with the number of times that a row stands there (0: not at all).

    A conversation is repaired in one task, as its digest is sequential by nature: there it takes about 50 bytes a
    row; texts only stream through.
    """
    found = edits(conversations, copies)
    return apply_edits(conversations, found, copies).withColumnRenamed("conv", "conv_id")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows as the contract spoils them, by crc32 of ``conv_id:turn`` modulo 20; dropped rows stay with no copies."""
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def report(conversations: DataFrame, copies: str | None = None) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and the digest of the repaired rows.

    A conversation without rows has zeros, an empty audit and the digest of nothing.  See ``repair`` for odd rows.
    """
    found = edits(conversations, copies)
    repaired = apply_edits(conversations, found, copies)
    schema = T.StructType([T.StructField("conv", found.schema["conv"].dataType), T.StructField("repaired_sha256", T.StringType())])
    digests = repaired.mapInArrow(_digest(to_arrow_schema(schema)), schema).withColumnRenamed("conv", "digest_of")
    return (
        found.where(F.col("hash").isNull()).join(digests, F.col("conv").eqNullSafe(F.col("digest_of")), "left")
        .select(F.col("conv").alias("conv_id"), *[f.name for f in REPORT], "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    )
