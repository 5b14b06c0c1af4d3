"""Files of binary messages: read by byte ranges, from a text index or by walking their headers.

A message begins with ``GRIB``, its edition (2) and its length, has numbered sections, and
ends with ``7777``; section 4 says what it holds. An index, if there is one, has a line
"n:start:date:name:level:..." for each message, in a file beside the messages'. A scan is
split into stretches of files; a task seeks to the messages that start in its stretch and
reads no others, and of those only the ones asked for.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from .stores import StagedWriter, Stretch, located, stretches

MAGIC, END, HEAD = b"GRIB", b"7777", 16
#: Bytes read to tell what a message holds, and at once in the search for a message's start.
DESCRIBED, SEARCHED = 512, 1 << 20


def described(head: bytes) -> tuple[str, str]:
    """("discipline.category.number", "surface type:value") from a message's first bytes; empty if section 4 isn't among them."""
    at = HEAD
    while at + 5 <= len(head):
        size, number = struct.unpack_from(">IB", head, at)
        if number == 4 and at + 28 <= len(head):
            category, what, surface = head[at + 9], head[at + 10], head[at + 22]
            return f"{head[6]}.{category}.{what}", f"{surface}:{struct.unpack_from('>I', head, at + 24)[0]}"
        if not size:
            break
        at += size
    return "", ""


def framed(kind: tuple[int, int, int], level: tuple[int, int], payload: bytes) -> bytes:
    """A message of (discipline, category, number) at (surface type, value) whose section 7 is ``payload``."""
    what = struct.pack(">HHBB", 0, 0, kind[1], kind[2]) + bytes(11) + struct.pack(">BBI", level[0], 0, level[1]) + bytes(6)
    body = struct.pack(">IB", 5 + len(what), 4) + what + struct.pack(">IB", 5 + len(payload), 7) + payload
    return MAGIC + bytes([0, 0, kind[0], 2]) + struct.pack(">Q", HEAD + len(body) + 4) + body + END


def payload(message: bytes) -> bytes:
    """Section 7 of a message."""
    at = HEAD
    while at + 5 <= len(message):
        size, number = struct.unpack_from(">IB", message, at)
        if number == 7:
            return message[at + 5 : at + size]
        if not size:
            break
        at += size
    return b""


class _Ranges:
    """A file read by ranges; ``total`` counts the bytes."""

    def __init__(self, file, size: int):  # noqa: ANN001
        self.file, self.size, self.total = file, size, 0

    def read(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        out = self.file.read(max(0, min(length, self.size - start)))
        self.total += len(out)
        return out


def message_length(file: _Ranges, start: int, head: bytes) -> int:
    """Length of the message at ``start``; 0 if none stands there that ends where it says."""
    if len(head) < HEAD or head[:4] != MAGIC or head[7] != 2:
        return 0
    (length,) = struct.unpack_from(">Q", head, 8)
    if length < HEAD + 4 or start + length > file.size:
        return 0
    return length if file.read(start + length - 4, 4) == END else 0


def next_message(file: _Ranges, at: int, before: int) -> int:
    """Where the first message at or after ``at`` and before ``before`` starts; -1 if none does."""
    while at < before:
        block = file.read(at, SEARCHED + HEAD)
        k = block.find(MAGIC)
        while 0 <= k < SEARCHED and at + k < before:
            if message_length(file, at + k, block[k : k + HEAD] if k + HEAD <= len(block) else file.read(at + k, HEAD)):
                return at + k
            k = block.find(MAGIC, k + 1)
        at += SEARCHED
    return -1


def walked(file: _Ranges, lo: int, hi: int) -> Iterator[tuple[int, int, str, str]]:
    """(start, length, name, level) of the messages that start in [lo, hi), by their headers alone."""
    at = next_message(file, lo, hi)
    while 0 <= at < hi:
        head = file.read(at, DESCRIBED)
        length = message_length(file, at, head)
        if not length:
            at = next_message(file, at + 1, hi)  # bytes between messages
            continue
        yield at, length, *described(head[:length])
        at += length


def indexed(lines: str, size: int) -> list[tuple[int, int, str, str]]:
    """(start, length, name, level) of the messages of an index; the last goes to the file's end."""
    rows = [line.split(":") for line in lines.splitlines() if line.strip()]
    starts = [int(r[1]) for r in rows]
    order = sorted(set(starts)) + [size]
    after = dict(zip(order, order[1:]))
    return [(s, after[s] - s, r[3], r[4]) for s, r in zip(starts, rows)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix, self.index = options["path"], options.get("suffix", ".bin"), options.get("index", ".idx")
        self.names = set(filter(None, options.get("names", "").split(",")))
        self.codes = json.loads(options.get("codes", "{}"))
        self.content = options.get("content", "true") == "true"
        self.wide = int(options.get("stretch", 64 << 20))

    def partitions(self) -> list[Stretch]:
        return stretches(self.path, self.suffix, self.wide)

    def messages(self, store, file: _Ranges, part: Stretch) -> Iterator[tuple[int, int, str, str]]:  # noqa: ANN001
        lo, hi = part.bounds
        if not self.index:
            found: Iterator | list = walked(file, lo, hi)
        else:
            with store.open_input_stream(part.place.removesuffix(self.suffix) + self.index) as f:
                found = [m for m in indexed(f.read().decode(), part.size) if lo <= m[0] < hi]
        for start, length, name, level in found:
            name = self.codes.get(name, name)
            if not self.names or name in self.names:
                yield start, length, name, level

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        store, _ = located(self.path)
        with store.open_input_file(part.place) as f:
            file = _Ranges(f, part.size)
            rows, held = [], 0
            for start, length, name, level in self.messages(store, file, part):
                rows.append((part.place.rsplit("/", 1)[-1], start, length, name, level, file.read(start, length) if self.content else None))
                held += length if self.content else 64
                if held > 8 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["file", "start", "length", "name", "level", "message"])


class _Writer(StagedWriter):
    """A file of messages and its index for each task."""

    def put(self, batches: Iterator[pa.RecordBatch], begin) -> Iterator[str]:  # noqa: ANN001
        own, file, lines, at, n = f"messages-{TaskContext.get().partitionId():05d}", None, [], 0, 0
        for batch in batches:
            for name, level, message in zip(*(batch.column(c).to_pylist() for c in ("name", "level", "message"))):
                if message is None:
                    continue
                if file is None:
                    file = begin(f"{own}.bin")
                n += 1
                lines.append(f"{n}:{at}:d=0:{name}:{level}:anl:")
                file.write(message)
                at += len(message)
        if file is not None:
            file.close()
            with begin(f"{own}.idx") as f:
                f.write("\n".join(lines).encode())
            yield f"{own}.bin"
            yield f"{own}.idx"


class MessageFiles(DataSource):
    """Format ``message_files``.

    Read options: path (a file or a folder), suffix (.bin), index (suffix of the index beside each
    file, .idx; empty: headers are walked), names (only these, commas between), codes (JSON: names
    for "discipline.category.number"), content (false: no message is read), stretch (bytes a task).
    Written columns: name, level, message.
    """

    @classmethod
    def name(cls) -> str:
        return "message_files"

    def schema(self) -> str:
        return "file string, start long, length long, name string, level string, message binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> StagedWriter:
        return _Writer(self.options["path"], overwrite)


def read_messages(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(file, start, length, name, level, message) of a folder of message files: see MessageFiles for the options."""
    spark.dataSource.register(MessageFiles)
    return spark.read.format("message_files").options(path=path, **options).load()


def write_messages(df: DataFrame, path: str) -> None:
    """Rows (name, level, message) as message files with indexes, a pair a task; all appear at once."""
    df.sparkSession.dataSource.register(MessageFiles)
    kinds = df.selectExpr("cast(name as string) name", "cast(level as string) level", "message")
    kinds.write.format("message_files").option("path", path).mode("overwrite").save()
