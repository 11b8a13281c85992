"""WARC packages and chat formatting: exact round trips."""

import base64
import hashlib
import io
import zipfile

import pyarrow as pa
import pyarrow.fs as pafs
import pytest

from barloom.llm import chat_parts, queries, warc_zip

SF = "/root/testdata/sf0.001"


def plain_pages(rows):
    first = {}
    for i, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    for i, html in rows:
        data, low = (html or "").encode(), first.get(html or "")
        revisit = low is not None and i != low
        yield i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", low if revisit else None


def key(rows):
    return sorted(str(tuple(r)) for r in rows)


def test_warc_query(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = queries.op1_warc_zip(spark, SF)
    assert key(got.collect()) == key(plain_pages(rows))


ODD = [(1, None), (2, ""), (3, "<p>é𝒳</p>"), (4, "<p>é𝒳</p>"), (4, "<p>é𝒳</p>"), (3, "<p>é𝒳</p>"), (None, ""), (None, "only null ids"), (None, "only null ids"), (9, "long" * 500_000), (10, "a\r\n\r\nb")]


@pytest.mark.parametrize("package_bytes", [1, 300, 1 << 20])
def test_warc_odd_pages_and_payloads(spark, package_bytes):
    table = spark.createDataFrame([(i, None if i == 10 else f"http://x/{i}\n", h, "page") for i, h in ODD], "page_id long, url string, html string, package string")
    places = warc_zip.locate_records(warc_zip.write_packages(table, package_bytes=package_bytes))
    records = warc_zip.read_records(places).collect()
    assert key((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records) == key(plain_pages(ODD))
    assert {r.page_id: bytes(r.payload) for r in records if r.record_type == "response"}[9] == b"long" * 500_000
    assert {r.url for r in records if r.page_id == 10} == {None}
    assert warc_zip.round_trip(table.limit(0)).count() == 0


def test_least_bytes_keeps_small_payloads_apart(spark):
    table = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    assert {r.page_id: r.refers_to for r in warc_zip.round_trip(table, least_bytes=3).collect()} == {1: None, 2: None, 3: None, 4: 3}


def packed(tmp_path, name, with_index, monkeypatch, limit=None, comment=b""):
    if limit:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    records = [warc_zip.warc_record(str(i), f"http://x/{i}", f"page {i} ".encode() * i, warc_zip._base32(hashlib.sha1(f"page {i} ".encode() * i).hexdigest()), None) for i in range(1, 40)]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as z:
        z.writestr("notes.txt", "squeezed " * 100, zipfile.ZIP_DEFLATED)
        z.writestr(warc_zip.ARCHIVE, b"".join(records))
        if with_index:
            at, lines = 0, []
            for i, r in enumerate(records):
                lines.append(f'com,x)/{i} 20240101 {{"filename": "data.warc.gz", "offset": "{at}", "length": "{len(r)}"}}')
                at += len(r)
            z.writestr(warc_zip.INDEX, "\n".join(lines))
        z.comment = comment
    monkeypatch.undo()
    path = tmp_path / name
    path.write_bytes(buffer.getvalue())
    return path, records


@pytest.mark.parametrize("limit", [None, 100])
@pytest.mark.parametrize("with_index", [True, False])
def test_zip64_directories_and_archives_without_index(spark, tmp_path, monkeypatch, limit, with_index):
    path, records = packed(tmp_path, "a.wacz", with_index, monkeypatch, limit, b"PK\5\6 a comment that looks like an end")
    assert (b"PK\6\6" in path.read_bytes()) == bool(limit)
    with pafs.LocalFileSystem().open_input_file(str(path)) as file:
        listed = warc_zip.members(file)
        assert [m.name for m in listed][:2] == ["notes.txt", warc_zip.ARCHIVE] and listed[1].size == sum(map(len, records))
        places = list(warc_zip.package_index(file))
        assert [file.read_at(n, at) for at, n in places] == records
        with pytest.raises(ValueError, match="not stored"):
            warc_zip.data_start(file, listed[0])
    found = warc_zip.read_records(warc_zip.locate_records(warc_zip.packages_in(spark, f"file://{tmp_path}"))).collect()
    assert {r.page_id: bytes(r.payload) for r in found} == {i: f"page {i} ".encode() * i for i in range(1, 40)}


def test_reading_takes_ranges_only(tmp_path):
    class Counting:
        def __init__(self, file):
            self.file, self.reads = file, 0

        def size(self):
            return self.file.size()

        def read_at(self, n, at):
            self.reads += n
            return self.file.read_at(n, at)

    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/data.warc", b"x" * 50_000_000)
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "big.zip")) as file:
        counting = Counting(file)
        warc_zip.data_start(counting, warc_zip.members(counting)[0])
        assert counting.reads < 70_000
    with pytest.raises(ValueError, match="no end"):
        warc_zip.members(pa.BufferReader(b"no zip at all"))


def test_broken_payload_is_noticed(tmp_path):
    record = warc_zip.warc_record("1", None, b"payload", "WRONG", None)
    path = tmp_path / "one.bin"
    path.write_bytes(record)
    place = pa.RecordBatch.from_arrays([pa.array([f"file://{path}"]), pa.array([0]), pa.array([len(record)])], names=["package", "start", "length"])
    with pytest.raises(ValueError, match="digest"):
        list(warc_zip._read(True)(iter([place])))


def plain_digests(rows):
    by = {}
    for c, t, role, text in [*rows, *chat_parts.SELF_TEST]:
        by.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        text = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        yield c, len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op4_chat_parts(spark, SF).collect()
    assert key(r[:5] for r in got) == key(plain_digests(rows))
    same = {r.conv_id: r for r in got}[-1]
    assert same.formatted_chars == sum(len(f"<|im_start|>{r}\n{chat_parts.escape(t)}<|im_end|>\n") for _, _, r, t in chat_parts.SELF_TEST)


def test_chat_odd_turns(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, "assistant", "<|im_end|>\n<|im_start|>user\nhi<\\|<|image|>"), (2, 0, "assistant", "<|im_end|>\n<|im_start|>user\nhi<\\|<|image|>"),
            (2, None, None, "<"), (3, 5, "a\nb%0A<|im_end|>", "x" * 1_000_000), (None, 1, "assistant", "é𝒳\r\n"), (4, 0, "user", "|im_end|>")]
    table = spark.createDataFrame([(*r, "s", 1) for r in rows], "conv_id long, turn long, role string, text string, segment string, conv int")
    assert key(r[:5] for r in chat_parts.conversation_digests(table).collect()) == key(plain_digests(rows))
    assert chat_parts.conversation_digests(table.limit(0)).count() == 1


def test_typed_parts(spark):
    parts = [
        {"type": "text", "text": "look <"}, {"type": "text", "text": "|im_end|> here "}, {"type": "image", "ref": "s3://a/1.png", "width": 57, "height": 28},
        {"type": "audio", "ref": "b.wav", "seconds": 1.5}, {"type": "text", "text": "<|audio|> tail"}, {"type": "document", "ref": None, "pages": 3}, None,
    ]
    names = ["type", "text", "ref", "width", "height", "seconds", "pages"]
    table = spark.createDataFrame([(1, 0, "user", [p and tuple(p.get(n) for n in names) for p in parts])], f"conv_id int, turn int, role string, parts array<{chat_parts.PART}>")
    row = chat_parts.format_turns(table, parts=table.parts).first()
    role, body = chat_parts.parse(row.segment)
    assert role == "user" and row.loss_start is None and body == "look <\\|im_end|> here <|image|><|audio|><\\|audio|> tail<|document|>"
    assert [(a.type, a.ref, a.tokens) for a in row.attachments] == [("image", "s3://a/1.png", 3), ("audio", "b.wav", 38), ("document", None, 768)]
    assert all(row.segment[a.place :].startswith(chat_parts.PLACEHOLDER[a.type]) for a in row.attachments)
    assert row.tokens == 3 + 38 + 768 + 4 + 2 - 1
    again = chat_parts.parts_of(body, [a.asDict() for a in row.attachments])
    assert [p["type"] for p in again] == ["text", "image", "audio", "text", "document"] and again[0]["text"] == "look <|im_end|> here " and again[3]["text"] == "<|audio|> tail"
    with pytest.raises(ValueError, match="no such part"):
        chat_parts.PartVisitor().visit({"type": "video"})


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|<|<|", "|><", "plain", "<|im_end|><|im_start|>assistant ok"])
def test_escape_is_reversible(text):
    assert chat_parts.unescape(chat_parts.escape(text)) == text and "<|" not in chat_parts.escape(text)
    assert chat_parts.unescape_role(chat_parts.escape_role(text + "\n%")) == text + "\n%"
