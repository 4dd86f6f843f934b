"""Server-sent-event capture files as a table or a stream of lines.

A capture is a file `<folder>/stream_id=<id>/<any name>` of lines, as one response sent them.  Captures written in bulk share
files `<folder>/captures/<any name>`, in which each line stands behind its quoted stream id and a tab: a file for each of many small
captures would make the driver hold all their names.  The source reads byte ranges, so one
large file is read by many tasks, and small files and ranges share a task; it gives each line its byte offset, which orders the lines of a
file without a count of those before it; `numbered_lines` makes line numbers of them.  As a stream it follows files that grow: what it
has read of each file is kept as an offset, and a last line without line end waits until it has one.

Lines end with \\n or \\r\\n.  Bytes that are no UTF-8 are replaced.  A line above 10 MiB is null, which ends a capture.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quietlog.operators.ranks import numbered

SCHEMA = "stream_id string, offset long, line string"
#: fixed value: the longest line that is read
LINE_BYTES = 10 * 1024 * 1024
SPLIT_BYTES = 64 << 20
BLOCK = 1 << 20
BATCH = 8192
#: bytes and files that a task gets at most, but for one large range
TASK_BYTES, TASK_FILES = 8 << 20, 1000
#: folder of files of many captures; longest quoted id there
BULK, ID_BYTES = "captures", 1 << 16
#: id of lines without one, as in names of folders
NO_ID = "__HIVE_DEFAULT_PARTITION__"


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"file:/+", path):
        path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> dict[str, int]:
    """The capture files below a folder, with their sizes."""
    files, root = _located(path)
    found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    bulk = f"{root.rstrip('/')}/{BULK}/"
    return {f.path: f.size for f in found if f.is_file and not f.base_name.startswith(("_", ".")) and ("stream_id=" in f.path or f.path == bulk + f.base_name)}


def _id(path: str) -> str:
    return unquote(path.split("stream_id=", 1)[1].split("/", 1)[0])


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Work(InputPartition):
    """Stretches of files that one task reads, in ranges of `split` bytes each."""

    stretches: list[Range]
    split: int

    def ranges(self) -> Iterator[Range]:
        return (r for s in self.stretches for r in ranges(s.path, s.start, s.end, self.split))


def ranges(path: str, start: int, end: int, split: int) -> list[Range]:
    return [Range(path, at, min(at + split, end)) for at in range(start, end, split)]


def dealt(files: Iterable[tuple[str, int, int]], split: int) -> list[Work]:
    """Tasks for stretches (path, start, end) of files; those above a task's size are cut between ranges."""
    whole = max(split, TASK_BYTES // split * split)
    out, held, size = [], [], 0
    for path, start, end in files:
        for part in ranges(path, start, end, whole):
            if held and (size + part.end - part.start > whole or len(held) >= TASK_FILES):
                out.append(Work(held, split))
                held, size = [], 0
            held.append(part)
            size += part.end - part.start
    return [*out, Work(held, split)]


def lines_of(stream: pa.NativeFile, start: int, end: int, from_line_start: bool, most: int | None = None) -> Iterator[tuple[int, bytes | None]]:
    """(offset, line) of the lines that begin in [start, end); without `from_line_start`, one may have begun before."""
    most = LINE_BYTES if most is None else most
    at = start if from_line_start or start == 0 else start - 1
    stream.seek(at)
    skipping = at != start or not (from_line_start or start == 0)
    held, begin = bytearray(), at
    too_long = False
    while True:
        # little beyond the range: it is another one's
        block = stream.read(max(min(BLOCK, end - at), min(BLOCK, 1 << 14)))
        if not block:
            if (held or too_long) and not skipping and begin < end:
                yield begin, None if too_long else bytes(held)
            return
        pos = 0
        while (cut := block.find(b"\n", pos)) >= 0:
            if skipping:
                skipping = False
            elif begin < end:
                size = len(held) + cut - pos
                yield begin, None if too_long or size > most else bytes(held) + block[pos:cut]
            held.clear()
            too_long = False
            pos = cut + 1
            begin = at + pos
            if begin >= end:
                return
        if not skipping and not too_long:
            held += block[pos:]
            if len(held) > most:
                too_long = True
                held.clear()
        at += len(block)


def _captured(files: fs.FileSystem, part: Range, from_line_start: bool) -> Iterator[tuple[str, int, bytes | None]]:
    """(stream_id, offset, line) of a range."""
    with files.open_input_file(part.path) as stream:
        if "stream_id=" in part.path:
            name = _id(part.path)
            for at, line in lines_of(stream, part.start, part.end, from_line_start):
                yield name, at, line
            return
        for at, line in lines_of(stream, part.start, part.end, from_line_start, LINE_BYTES + ID_BYTES):
            head = line
            if line is None:  # too long to read, but for its id
                with files.open_input_file(part.path) as again:
                    again.seek(at)
                    head = again.read(ID_BYTES)
            name, tab, rest = head.partition(b"\t")
            if tab:
                yield unquote(name.decode()), at, None if line is None or len(rest) > LINE_BYTES else rest


def _batches(path: str, part: Range | Work, from_line_start: bool) -> Iterator[pa.RecordBatch]:
    files, _ = _located(path)
    names, offsets, lines = [], [], []

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(lines, pa.string())], ["stream_id", "offset", "line"])

    held = 0
    for own in part.ranges() if isinstance(part, Work) else [part]:
        for name, at, line in _captured(files, own, from_line_start):
            names.append(name)
            offsets.append(at)
            lines.append(None if line is None else line.removesuffix(b"\r").decode(errors="replace"))
            held += len(line or b"")
            if len(lines) >= BATCH or held > LINE_BYTES:
                yield batch()
                names, offsets, lines, held = [], [], [], 0
    if lines:
        yield batch()


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[Work]:
        return dealt(((path, 0, size) for path, size in sorted(listed(self.path).items())), self.split)

    def read(self, partition: Work) -> Iterator[pa.RecordBatch]:
        yield from _batches(self.path, partition, False)


class CaptureStreamReader(DataSourceStreamReader):
    """Offsets: bytes read of each file, all of them whole lines."""

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT_BYTES))
        self.known: dict[str, tuple[int, int]] = {}  # size and whole bytes when last looked at

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        files, _ = _located(self.path)
        whole = {}
        for path, size in listed(self.path).items():
            if self.known.get(path, (-1, 0))[0] != size:
                self.known[path] = (size, self._whole(files, path, size, self.known.get(path, (0, 0))[1]))
            if self.known[path][1]:
                whole[path] = self.known[path][1]
        return {"files": json.dumps(whole, sort_keys=True)}

    def _whole(self, files: fs.FileSystem, path: str, size: int, least: int) -> int:
        """Where the last whole line ends, looked for backwards."""
        with files.open_input_file(path) as stream:
            end = size
            while end > least:
                begin = max(least, end - BLOCK)
                stream.seek(begin)
                if (cut := stream.read(end - begin).rfind(b"\n")) >= 0:
                    return begin + cut + 1
                end = begin
        return least

    def partitions(self, start: dict, end: dict) -> list[Work]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        return dealt(((path, before.get(path, 0), size) for path, size in sorted(after.items())), self.split)

    def read(self, partition: Work) -> Iterator[pa.RecordBatch]:
        # a range may begin inside a line, which the range before it reads
        yield from _batches(self.path, partition, False)

    def commit(self, end: dict) -> None:
        """Nothing to let go: the files stay."""


class CaptureSource(DataSource):
    """`spark.read.format("sse_capture").load(folder)`, and as a stream; option splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "sse_capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)

    def streamReader(self, schema) -> CaptureStreamReader:
        return CaptureStreamReader(self.options)


def read_captures(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines (stream_id, offset, line) of all captures below `path`."""
    spark.dataSource.register(CaptureSource)
    return spark.read.format("sse_capture").option("splitBytes", split_bytes).load(path)


def stream_captures(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The same as a stream that follows the files."""
    spark.dataSource.register(CaptureSource)
    return spark.readStream.format("sse_capture").option("splitBytes", split_bytes).load(path)


def numbered_lines(lines: DataFrame) -> DataFrame:
    """Lines (stream_id, seq, line) with line numbers from 0 for offsets."""
    return numbered(lines, ["stream_id"], ["offset"], "seq").select("stream_id", (F.col("seq") - 1).alias("seq"), "line")


def write_captures(lines: DataFrame, path: str) -> None:
    """Lines (stream_id, seq, line) as capture files of many streams; each stream lies in one of them."""
    ordered = lines.select("stream_id", "seq", "line").repartition("stream_id").sortWithinPartitions("stream_id", "seq")
    known = F.nullif(F.col("stream_id").cast("string"), F.lit(""))
    head = F.concat(F.coalesce(F.replace(F.url_encode(known), F.lit("+"), F.lit("%20")), F.lit(NO_ID)), F.lit("\t"))
    # a line end inside a line ends it in the file
    line = F.replace(F.coalesce("line", F.lit("")), F.lit("\n"), F.concat(F.lit("\n"), head))
    ordered.select(F.concat(head, line).alias("value")).write.text(f"{path}/{BULK}")
