"""WARC records in ZIP packages: written as stored members with an index, read back by byte ranges."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from contextlib import closing
from dataclasses import dataclass
from struct import calcsize, unpack, unpack_from

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm._common import shared_dir, ship, shuffle_partitions, staged

ship(__name__)

#: Compressed bytes after which a package is closed; one record may exceed it alone.
PACKAGE_BYTES = 64 << 20
#: Bytes that one read asks for at most; records that lie next to each other share a read.
READ_BYTES = 4 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
NO_ID = -(1 << 63)

# Fixed values of the ZIP format: signatures and field layouts.
END = "<4s4H2LH"  # PK\5\6
END64_LOCATOR = "<4sLQL"  # PK\6\7
END64 = "<4sQ2H2L4Q"  # PK\6\6
ENTRY = "<4s6H3L5H2L"  # PK\1\2
LOCAL = "<4s5H3L2H"  # PK\3\4


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    header: int
    size: int
    packed: int


def _range(file: pa.NativeFile, at: int, size: int) -> bytes:
    data = file.read_at(size, at)
    if len(data) != size:
        raise ValueError(f"package ends before byte {at + size}")
    return data


def members(file: pa.NativeFile) -> list[Member]:
    """The members that the central directory of a ZIP or ZIP64 file lists; only its tail and the directory are read."""
    size = file.size()
    tail_at = max(0, size - calcsize(END) - 0xFFFF)
    tail = _range(file, tail_at, size - tail_at)
    at = tail.rfind(b"PK\5\6")
    while at >= 0 and (at + calcsize(END) > len(tail) or at + calcsize(END) + unpack_from(END, tail, at)[7] != len(tail)):
        at = tail.rfind(b"PK\5\6", 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    _, _, _, _, count, length, start, _ = unpack_from(END, tail, at)
    place = tail_at + at - calcsize(END64_LOCATOR)
    if place >= 0 and (locator := _range(file, place, calcsize(END64_LOCATOR))).startswith(b"PK\6\7"):
        _, _, where, _ = unpack(END64_LOCATOR, locator)
        found = unpack(END64, _range(file, where, calcsize(END64)))
        if found[0] != b"PK\6\6":
            raise ValueError("no ZIP64 end of a central directory")
        count, length, start = found[7:10]
    directory = _range(file, start, length)
    out, at = [], 0
    for _ in range(count):
        mark, _, _, flags, method, _, _, _, packed, full, n, extra, comment, _, _, _, header = unpack_from(ENTRY, directory, at)
        if mark != b"PK\1\2":
            raise ValueError("broken central directory")
        at += calcsize(ENTRY)
        name = directory[at : at + n].decode("utf-8" if flags & 0x800 else "cp437")
        fields = directory[at + n : at + n + extra]
        at += n + extra + comment
        while len(fields) >= 4:
            kind, width = unpack_from("<2H", fields)
            if kind == 1:  # only what overflows stands here, in this order
                wide = iter(unpack_from(f"<{width // 8}Q", fields, 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            fields = fields[4 + width :]
        out.append(Member(name, method, header, full, packed))
    return out


def data_start(file: pa.NativeFile, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method:
        raise ValueError(f"{member.name} is not stored")
    fields = unpack(LOCAL, _range(file, member.header, calcsize(LOCAL)))
    if fields[0] != b"PK\3\4":
        raise ValueError(f"no local header of {member.name}")
    return member.header + calcsize(LOCAL) + fields[9] + fields[10]


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _field(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def warc_record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One record in a gzip member of its own.  A revisit holds no payload, only its digest and length."""
    fields = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_field(url)}"] if url is not None else []), f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Payload-Length: {len(payload)}",
           "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []),
    ]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += payload if refers_to is None else b""
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the payload behind the HTTP head."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block


class PackageWriter:
    """Streams records into ``archive/``, then the index, as stored members; the final name appears when all is written."""

    def __init__(self, folder: str, name: str):
        self.fs, self.path = _filesystem(f"{folder}/{name}")
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.waiting = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.waiting)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(ARCHIVE, "w", force_zip64=True)
        self.index: list[str] = []
        self.size = 0

    def add(self, record_id: str, record: bytes) -> None:
        self.member.write(record)
        self.index.append(json.dumps({"id": record_id, "filename": ARCHIVE, "offset": self.size, "length": len(record)}))
        self.size += len(record)

    def close(self) -> int:
        self.member.close()
        self.zip.writestr(INDEX, "".join(line + "\n" for line in self.index))
        self.zip.close()
        self.out.close()
        self.fs.move(self.waiting, self.path)
        return len(self.index)


def _write(folder: str, package_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, writer = TaskContext.get().partitionId(), [], None

        def close() -> None:
            nonlocal writer
            if writer is not None:
                done.append((f"{folder}/part-{part:06d}-{len(done):06d}.wacz", writer.close()))
                writer = None

        for batch in batches:
            for page, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    writer = PackageWriter(folder, f"part-{part:06d}-{len(done):06d}.wacz")
                name = "" if page is None else str(page)
                writer.add(name, warc_record(name, url, html or b"", _base32(digest), None if refers is None else str(refers)))
                if writer.size >= package_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["package", "records"])

    return run


def write_packages(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url: str = "url", html: str = "html",
    least_bytes: int = LEAST_BYTES, package_bytes: int = PACKAGE_BYTES,
) -> DataFrame:
    """Write one record per row into ZIP packages below ``folder``; give the manifest (package, records).

    Rows with equal payloads of ``least_bytes`` or more are one response, that with the smallest id, and revisits of it.
    Digests are grouped as narrow rows, reduced before the shuffle; payloads move once, dealt by id and
    digest and sorted, so neither a payload that a third of the pages share nor rows without an id are a hot key.  A task that runs again writes the same names anew.

    A null payload is empty; a null id is the empty name and never the smallest beside another id; rows that repeat the smallest
    id and its payload are all responses; a null url has no field; an empty table gives no package; other columns are not read.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc-packages")
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("html"),
    ).withColumn("key", F.coalesce("id", F.lit(NO_ID)))
    digests = rows.select("id", "key", F.sha1("html").alias("digest"), F.length("html").alias("size"))
    firsts = digests.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = digests.join(firsts, "digest").where(~F.col("id").eqNullSafe(F.col("first"))).select("key", "digest", F.col("first").alias("refers_to")).distinct()
    # The join itself deals the payloads by id and digest, unless the revisits are few enough to be sent to where the payloads are.
    marked = rows.withColumn("digest", F.sha1("html")).join(again, ["key", "digest"], "left").select("id", "url", "html", "digest", "refers_to")
    return staged(marked.sortWithinPartitions("id", "digest", "url").mapInArrow(_write(folder, package_bytes), "package string, records long"), "warc-manifest")


def _scan_members(file: pa.NativeFile, start: int, size: int) -> Iterator[tuple[int, int]]:
    """Offset and length of every gzip member, for an archive without index; reads in pieces."""
    at, opened, stream = start, start, zlib.decompressobj(31)
    while at < start + size:
        piece = _range(file, at, min(READ_BYTES, start + size - at))
        at += len(piece)
        while piece:
            stream.decompress(piece)
            piece = stream.unused_data
            if stream.eof:
                yield opened, at - len(piece) - opened
                opened, stream = at - len(piece), zlib.decompressobj(31)


def package_index(file: pa.NativeFile) -> Iterator[tuple[int, int]]:
    """Absolute place and length of every record: from the stored indexes, else by going through the archives."""
    listed = {m.name: m for m in members(file)}
    archives = {n: data_start(file, m) for n, m in listed.items() if n.endswith((".warc.gz", ".warc")) and not m.method}
    indexed = set()
    for name, member in listed.items():
        if name.startswith("indexes/") and not member.method:
            for line in _range(file, data_start(file, member), member.size).splitlines():
                entry = json.loads(line[line.index(b"{") :])
                path = entry["filename"] if entry["filename"] in archives else f"archive/{entry['filename']}"
                indexed.add(path)
                yield archives[path] + int(entry["offset"]), int(entry["length"])
    for name, start in archives.items():
        if name not in indexed:
            yield from _scan_members(file, start, listed[name].size)


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for package in batch.column(0).to_pylist():
            fs, path = _filesystem(package)
            with fs.open_input_file(path) as file:
                places = sorted(package_index(file))
            for at in range(0, len(places), 10_000):
                part = places[at : at + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([package] * len(part), pa.string()), pa.array([p for p, _ in part], pa.int64()), pa.array([n for _, n in part], pa.int64())],
                    names=["package", "start", "length"],
                )


def _ranges(file: pa.NativeFile, places: list[tuple[int, int]]) -> Iterator[bytes]:
    """The bytes at ascending places; neighbours share a read of READ_BYTES at most."""
    i = 0
    while i < len(places):
        j, low = i + 1, places[i][0]
        while j < len(places) and places[j][0] == sum(places[j - 1]) and sum(places[j]) - low <= READ_BYTES:
            j += 1
        data = memoryview(_range(file, low, sum(places[j - 1]) - low))
        yield from (bytes(data[at - low : at - low + n]) for at, n in places[i:j])
        i = j


RECORD = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload", T.BinaryType()),
])


def _number(urn: str | None) -> int | None:
    text = (urn or "").strip("<>").rpartition(":")[2]
    return int(text) if text else None


def _read(with_payload: bool):
    def rows(data: bytes) -> tuple:
        fields, payload = parse_record(zlib.decompress(data, 31))
        kind, digest = fields["warc-type"], fields["warc-payload-digest"].rpartition(":")[2]
        if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload digest of {fields['warc-record-id']} does not hold")
        size = len(payload) if kind == "response" else int(fields["warc-payload-length"])
        return _number(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, _number(fields.get("warc-refers-to")), size, digest, payload if with_payload else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            packages, starts, lengths = (c.to_pylist() for c in batch.columns)
            for package in dict.fromkeys(packages):
                fs, path = _filesystem(package)
                with closing(fs.open_input_file(path)) as file:
                    places = sorted((s, n) for p, s, n in zip(packages, starts, lengths, strict=True) if p == package)
                    out, size = [], 0
                    for data in _ranges(file, places):
                        out.append(rows(data))
                        size += len(out[-1][6] or b"")
                        if len(out) == 4096 or size > READ_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=RECORD.names)
                            out, size = [], 0
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=RECORD.names)

    return run


def locate_records(packages: DataFrame) -> DataFrame:
    """(package, start, length) of every record in the packages named in column ``package``."""
    n = shuffle_partitions(packages.sparkSession)
    return packages.select("package").repartition(n, "package").mapInArrow(_locate, "package string, start long, length long")


def read_records(places: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records at these places, each read by its byte range and checked against its digest."""
    return places.select("package", "start", "length").mapInArrow(_read(with_payload), RECORD)


def packages_in(spark: SparkSession, folder: str, keep: Callable[[str], bool] = lambda name: name.endswith((".wacz", ".zip"))) -> DataFrame:
    """The packages that lie in ``folder`` as a table, for archives that this module did not write."""
    fs, path = _filesystem(folder)
    scheme = folder[: folder.index("://") + 3] if "://" in folder else ""
    found = [(f"{scheme}{f.path}",) for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if f.is_file and keep(f.base_name)]
    return spark.createDataFrame(found, "package string")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Per page, read back from the archives: page_id, payload_bytes, payload_digest, record_type and refers_to."""
    manifest = write_packages(pages, **options)
    return read_records(locate_records(manifest), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
