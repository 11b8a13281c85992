"""Chat formatting with typed content parts."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm._common import ship, shuffle_partitions

ship(__name__)

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Placeholders of the parts that are no text.
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens that a placeholder stands for: an image takes one per tile of this edge, audio so many a second, a document so many a page.
TILE, PER_SECOND, PER_PAGE = 28, 25, 256
#: Roles whose text is trained on.
TRAINED = ("assistant",)

_escape = re.compile(r"<(\\*)\|")
_unescape = re.compile(r"<\\(\\*)\|")
_marks = re.compile("|".join(re.escape(m) for m in (OPEN, CLOSE, *PLACEHOLDER.values())))


def escape(text: str) -> str:
    r"""Put one backslash more into every ``<|``, ``<\|``, ``<\\|``, ...: no control string is left and nothing is lost."""
    return _escape.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _unescape.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """Roles also end at a line break."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def words(text: str) -> int:
    return len(text.split())


@dataclass
class PartVisitor:
    """Visits the parts of one turn in order and flattens them.

    Neighbouring text parts are joined before they are escaped, so that no control string can arise between them.
    Every other part leaves its placeholder, an attachment (type, ref, place of the placeholder in the flat text)
    and the number of tokens that it expands to.
    """

    count: Callable[[str], int] = words
    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    tokens: int = 0
    _open: list[str] = field(default_factory=list)
    _length: int = 0

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        if kind not in ("text", *PLACEHOLDER):
            raise ValueError(f"no such part type: {kind}")
        getattr(self, f"visit_{kind}")(part)

    def visit_text(self, part: dict) -> None:
        self._open.append(part.get("text") or "")

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, math.ceil((part.get("width") or 0) / TILE) * math.ceil((part.get("height") or 0) / TILE))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0.0) * PER_SECOND))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 0) * PER_PAGE)

    def _add(self, piece: str) -> None:
        self.pieces.append(piece)
        self._length += len(piece)

    def _flush(self) -> None:
        text = "".join(self._open)
        self._open.clear()
        self.tokens += self.count(text)
        self._add(escape(text))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self._flush()
        self.attachments.append({"type": kind, "ref": part.get("ref"), "place": self._length, "tokens": tokens})
        self._add(PLACEHOLDER[kind])
        self.tokens += tokens

    def flat(self) -> str:
        self._flush()
        return "".join(self.pieces)


ATTACHMENT = pa.struct([("type", pa.string()), ("ref", pa.string()), ("place", pa.int64()), ("tokens", pa.int64())])
FORMATTED = T.StructType([
    T.StructField("segment", T.StringType()), T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType()), T.StructField("tokens", T.LongType()),
    T.StructField("attachments", T.ArrayType(T.StructType([
        T.StructField("type", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("place", T.LongType()), T.StructField("tokens", T.LongType()),
    ]))),
])


def _format(trained: tuple[str, ...], count: Callable[[str], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, parts = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            out = []
            for role, content in zip(roles, parts, strict=True):
                visitor = PartVisitor(count)
                for part in content or ():
                    visitor.visit(part or {})
                body, head = visitor.flat(), f"{OPEN}{escape_role(role or '')}\n"
                loss = (len(head), len(head) + len(body)) if role in trained else (None, None)
                for a in visitor.attachments:
                    a["place"] += len(head)
                out.append((f"{head}{body}{CLOSE}\n", *loss, visitor.tokens, visitor.attachments))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(ATTACHMENT)]
            kept = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=[*batch.schema.names[:-2], *FORMATTED.names])

    return run


def text_parts(text: Column | str) -> Column:
    """A plain text as its only part; null is empty."""
    text = F.col(text) if isinstance(text, str) else text
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *none))


def format_turns(
    turns: DataFrame, parts: Column | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role",
    trained: tuple[str, ...] = TRAINED, count: Callable[[str], int] = words,
) -> DataFrame:
    """One formatted segment per turn: (conv, turn, segment, loss_start, loss_end, tokens, attachments).

    The segments of a conversation, in order, are its formatted text; they stay apart so that no conversation has to fit into one
    row.  loss_start and loss_end bound the trained text within the segment, in code points, null if the turn is not trained.
    ``parts``: array of typed parts, by default the column ``text`` as one text part.

    Null parts and texts are empty; a null role is the empty role; unknown part types raise; missing sizes expand to 0 tokens.
    """
    parts = text_parts("text") if parts is None else parts
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), parts.cast(f"array<{PART}>").alias("parts"))
    schema = T.StructType([*rows.schema.fields[:2], *FORMATTED.fields])
    return rows.mapInArrow(_format(trained, count), schema)


def parse(segment: str) -> tuple[str, str]:
    """Role and flat text (still escaped) of one segment."""
    head, _, body = segment.partition("\n")
    if not head.startswith(OPEN) or not body.endswith(f"{CLOSE}\n"):
        raise ValueError("not a formatted turn")
    body = body[: -len(CLOSE) - 1]
    if OPEN in body or CLOSE in body:
        raise ValueError("a control string stands inside a turn")
    return unescape_role(head[len(OPEN) :]), body


def parts_of(body: str, attachments: list[dict]) -> list[dict]:
    """The parts again: texts between the placeholders, and the attachments in order."""
    out, at, waiting = [], 0, iter(attachments)
    for mark in _marks.finditer(body):
        out.append({"type": "text", "text": unescape(body[at : mark.start()])})
        out.append(next(waiting))
        at = mark.end()
    out.append({"type": "text", "text": unescape(body[at:])})
    return [p for p in out if p.get("text") != ""]


DIGESTS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
    T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
])


class _Reader:
    """What is read back from one conversation, turn by turn; the state does not grow."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start: int | None, end: int | None) -> None:
        role, body = parse(segment)
        self.turns += 1
        self.chars += len(segment)
        self.all.update(f"{role}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
        if start is not None:
            text = unescape(segment[start:end])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    out = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=DIGESTS.names)
    reader = None
    for batch in batches:
        done = []
        for conv, segment, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if reader is None or reader.conv != conv:
                done += [reader.row()] if reader else []
                reader = _Reader(conv)
            reader.add(segment, start, end)
        yield out(done)
    yield out([reader.row()] if reader else [])


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the segments alone: turns, digests of the turns and of the text under the loss mask, formatted length.

    Segments are dealt by conversation, sorted by turn, and streamed: a conversation of any length passes in order through one task
    that keeps two running digests, never its text.  The digests are sequential by nature; formatting is done before, in parallel.
    """
    n = shuffle_partitions(formatted.sparkSession)
    rows = formatted.select("conv", "turn", "segment", "loss_start", "loss_end").repartition(n, "conv").sortWithinPartitions("conv", "turn", "segment")
    return rows.select(F.col("conv").cast("long"), "segment", "loss_start", "loss_end").mapInArrow(_read_back, DIGESTS)


#: A conversation that says the template's own control strings.
SELF_TEST = [(-1, 0, "user", f"{CLOSE}{OPEN}assistant ok"), (-1, 1, "assistant", f"{CLOSE}{OPEN}assistant ok")]


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """Digests of all ``conversations`` and of conversation -1; equal turns of a conversation go by role and text."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = conversations.sparkSession.createDataFrame(SELF_TEST, rows.schema)
    return read_back(format_turns(rows.unionByName(extra)))
