"""A partitioned message log over files as a Spark data source, for the topics of a broker that is not at hand.

``spark.dataSource.register(MessageLog)`` makes the format ``message_log`` known, with the options ``path`` and
``partitions`` (of a new log).  Messages are (key, value) texts; keys are dealt to partitions by hash.  Tasks write Parquet files that nobody sees
until the driver lists them, with their offsets, in the next commit file; a commit that a repeated micro-batch sends again
is recognised and not taken twice, and what an aborted write left is deleted.  Streams read from offsets per partition, so
a restart goes on where the checkpoint stands.

A log has one writing job at a time; files are written through ``pyarrow.fs``, so the path is a folder that the driver
and all executors reach.  A renamed commit file has to appear at once there, as on HDFS or a shared POSIX folder.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

from barloom.shipping import ship

ship(__name__)

PARTITIONS = 6
#: Messages, or characters of them, that a task holds before it writes a file.
FILE_ROWS, FILE_CHARS = 50_000, 32 << 20
MESSAGES = pa.schema([("key", pa.string()), ("value", pa.string())])


@dataclass
class Slice(InputPartition):
    """Messages ``start`` to ``stop`` of a log partition, in one file whose first message has offset ``first``."""

    partition: int
    file: str
    first: int
    start: int
    stop: int

    def __post_init__(self):
        super().__init__(self)


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: (log partition, name, messages), in the order written."""

    files: list[tuple[int, str, int]]


class Log:
    """The files of a log: ``data`` holds messages, ``commits`` one file per commit, in order."""

    def __init__(self, path: str, partitions: int):
        self.fs, self.root = fs.FileSystem.from_uri(path)
        self.partitions = partitions

    def commits(self) -> list[str]:
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/commits", allow_not_found=True))
        return sorted(f.base_name for f in found if f.base_name.endswith(".json"))

    def entries(self, since: int = 0) -> list[dict]:
        out = []
        for name in self.commits()[since:]:
            with self.fs.open_input_file(f"{self.root}/commits/{name}") as file:
                out.append(json.loads(file.read()))
        return out

    def ends(self) -> list[int]:
        """The offset after the last message of every partition."""
        last = self.entries(max(0, len(self.commits()) - 1))
        return last[-1]["ends"] if last else [0] * self.partitions

    def slices(self, start: Sequence[int], end: Sequence[int]) -> list[Slice]:
        out = []
        for entry in self.entries():
            for partition, file, first, n in entry["files"]:
                low, high = max(first, start[partition] if partition < len(start) else 0), min(first + n, end[partition])
                if low < high:
                    out.append(Slice(partition, file, first, low, high))
        return out

    def read(self, part: Slice) -> Iterator[tuple]:
        at = part.first
        with self.fs.open_input_file(f"{self.root}/data/{part.file}") as file:
            for batch in pq.ParquetFile(file).iter_batches(8_192):
                low, high = max(0, part.start - at), min(batch.num_rows, part.stop - at)
                if low < high:
                    for k, (key, value) in enumerate(zip(batch.column(0).to_pylist()[low:high], batch.column(1).to_pylist()[low:high], strict=True)):
                        yield part.partition, at + low + k, key, value
                at += batch.num_rows

    def write(self, rows) -> Written:
        held: dict[int, list] = {}
        chars: dict[int, int] = {}
        done = Written([])

        def flush(partition: int) -> None:
            name = f"{partition:05d}-{uuid.uuid4().hex}.parquet"
            self.fs.create_dir(f"{self.root}/data", recursive=True)
            keys, values = zip(*held.pop(partition), strict=True)
            with self.fs.open_output_stream(f"{self.root}/data/{name}") as file:
                pq.write_table(pa.table([keys, values], schema=MESSAGES), file)
            done.files.append((partition, name, len(keys)))
            chars[partition] = 0

        for row in rows:
            key, value = row["key"], row["value"]
            partition = zlib.crc32((value if key is None else key or "").encode()) % self.partitions if key is not None or value is not None else 0
            held.setdefault(partition, []).append((key, value))
            chars[partition] = chars.get(partition, 0) + len(key or "") + len(value or "")
            if len(held[partition]) >= FILE_ROWS or chars[partition] >= FILE_CHARS:
                flush(partition)
        for partition in sorted(held):
            flush(partition)
        return done

    def commit(self, messages: Sequence[Written | None], batch: str) -> None:
        """List the files of all tasks under the next offsets, unless this batch is listed already."""
        written = [m for m in messages if m is not None]
        entries = self.entries()
        if any(e["batch"] == batch for e in entries):
            self.abort(written)
            return
        ends, files = (list(entries[-1]["ends"]) if entries else [0] * self.partitions), []
        for message in written:
            for partition, name, n in message.files:
                files.append((partition, name, ends[partition], n))
                ends[partition] += n
        self.fs.create_dir(f"{self.root}/commits", recursive=True)
        place = f"{self.root}/commits/{len(entries):012d}"
        with self.fs.open_output_stream(f"{place}.tmp") as file:
            file.write(json.dumps({"batch": batch, "ends": ends, "files": files}).encode())
        self.fs.move(f"{place}.tmp", f"{place}.json")

    def abort(self, messages: Sequence[Written | None]) -> None:
        for message in messages:
            for _, name, _ in message.files if message is not None else ():
                self.fs.delete_file(f"{self.root}/data/{name}")


class LogReader(DataSourceReader):
    def __init__(self, log: Log):
        self.log = log

    def partitions(self) -> list[Slice]:
        ends = self.log.ends()
        return self.log.slices([0] * len(ends), ends)

    def read(self, partition: Slice) -> Iterator[tuple]:
        return self.log.read(partition) if partition is not None else iter(())


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, log: Log):
        self.log = log

    def initialOffset(self) -> dict:
        return {"ends": [0] * self.log.partitions}

    def latestOffset(self) -> dict:
        return {"ends": self.log.ends()}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        return self.log.slices(start["ends"], end["ends"])

    def read(self, partition: Slice) -> Iterator[tuple]:
        return self.log.read(partition)

    def commit(self, end: dict) -> None:
        """The checkpoint holds the offsets; the log keeps its messages."""


class LogWriter(DataSourceWriter):
    def __init__(self, log: Log):
        self.log, self.batch = log, uuid.uuid4().hex

    def write(self, iterator) -> Written:
        return self.log.write(iterator)

    def commit(self, messages) -> None:
        self.log.commit(messages, self.batch)

    def abort(self, messages) -> None:
        self.log.abort(messages)


class LogStreamWriter(DataSourceStreamWriter):
    def __init__(self, log: Log, writer: str):
        self.log, self.writer = log, writer

    def write(self, iterator) -> Written:
        return self.log.write(iterator)

    def commit(self, messages, batchId: int) -> None:
        self.log.commit(messages, f"{self.writer}-{batchId}")

    def abort(self, messages, batchId: int) -> None:
        self.log.abort(messages)


class MessageLog(DataSource):
    """Format ``message_log``.  A stream that writes names itself by the option ``writer``, the same after a restart (its checkpoint's path will do)."""

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return "partition int, offset long, key string, value string"

    def _log(self) -> Log:
        if "path" not in self.options:
            raise ValueError("a message log needs a path")
        return Log(self.options["path"], int(self.options.get("partitions", PARTITIONS)))

    def reader(self, schema) -> LogReader:
        return LogReader(self._log())

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self._log())

    def writer(self, schema, overwrite: bool) -> LogWriter:
        if overwrite:
            raise ValueError("a message log is appended to, not overwritten")
        return LogWriter(self._log())

    def streamWriter(self, schema, overwrite: bool) -> LogStreamWriter:
        if "writer" not in self.options:
            raise ValueError("a stream that writes to a message log needs the option writer")
        return LogStreamWriter(self._log(), self.options["writer"])
