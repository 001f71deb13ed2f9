"""Text logs that grow while they are read: the lines so far, then each line as it is finished.

A line belongs to the byte range that holds its closing LF, wherever it begins. Ranges that touch so share no line and
leave none out, however they are cut: a replay of what files held at one moment and a stream from the same
lengths on meet without gap or repeat, and a long range is read by many tasks. A line without its LF is not finished; the stream
gives it when the LF is there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from runledger.operators.logs import parse_tail, tail_lines
from runledger.session import ship_package

SCHEMA = "file string, at bigint, line string"
_CHUNK = 1 << 20
SPLIT_BYTES = 64 << 20


@dataclass
class Range(InputPartition):
    """The bytes ``[start, end)`` of a file."""

    file: str
    start: int
    end: int


def lengths(path: str) -> dict[str, int]:
    """Bytes of each file below a folder, or of one file."""
    files, place = fs.FileSystem.from_uri(path)
    found = files.get_file_info(place)
    if found.type == fs.FileType.Directory:
        listed = files.get_file_info(fs.FileSelector(place, recursive=True))
    else:
        listed = [found]
    return {one.path: one.size for one in listed if one.type == fs.FileType.File}


def ranges(start: dict[str, int], end: dict[str, int], split_bytes: int) -> list[Range]:
    """What files grew by, in ranges of at most ``split_bytes``. A file that shrank is an error."""
    found = []
    for file, upto in sorted(end.items()):
        at = start.get(file, 0)
        if upto < at:
            raise ValueError(f"{file} had {at} bytes and has {upto}: files followed must only grow")
        found += [Range(file, k, min(k + split_bytes, upto)) for k in range(at, upto, split_bytes)]
    return found


def _line_begin(source, start: int) -> int:
    """Where the line that byte ``start`` belongs to begins."""
    end = start
    while end > 0:
        begin = max(0, end - _CHUNK)
        source.seek(begin)
        place = source.read(end - begin).rfind(b"\n")
        if place >= 0:
            return begin + place + 1
        end = begin
    return 0


def finished_lines(files: fs.FileSystem, part: Range) -> Iterator[tuple[str, int, str]]:
    """``(file, at, line)`` of the lines whose LF lies in a range; empty lines are left out, at is a line's first byte."""
    with files.open_input_file(part.file) as source:
        at = _line_begin(source, part.start)
        # Bytes of an unfinished line, in pieces, so that a very long one is joined once.
        source.seek(at)
        open_line, place = [], at
        while place < part.end:
            piece = source.read(min(_CHUNK, part.end - place))
            if not piece:
                raise ValueError(f"{part.file} ends at {place}, before {part.end}")
            place += len(piece)
            *done, rest = piece.split(b"\n")
            for line in done:
                raw = b"".join((*open_line, line))
                open_line = []
                text = raw.decode("utf-8", "replace").rstrip("\r\n")
                if text:
                    yield part.file, at, text
                at += len(raw) + 1
            open_line.append(rest)


class _Source:
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.known = json.loads(options.get("lengths", "{}"))

    def read(self, part: Range) -> Iterator[tuple[str, int, str]]:
        files, _ = fs.FileSystem.from_uri(self.path)
        return finished_lines(files, part)


class _Replay(_Source, DataSourceReader):
    def partitions(self) -> list[Range]:
        return ranges({}, self.known, self.split_bytes)


class _Follow(_Source, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.seen = self.known

    def initialOffset(self) -> dict:
        # May be asked for after the latest one.
        return self.known

    def latestOffset(self) -> dict:
        # A file that is gone keeps its length: it has nothing more to give.
        self.seen = self.seen | lengths(self.path)
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(start, end, self.split_bytes)


class GrowingLogs(DataSource):
    """Options: ``path`` (a URI), ``lengths`` (JSON, the bytes of each file at the hand-over), ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Replay:
        return _Replay(self.options)

    def streamReader(self, schema) -> _Follow:
        return _Follow(self.options)


def _uri(path: str) -> str:
    return path if "://" in path else f"file://{path}"


def tail_then_follow(
    spark: SparkSession, path: str, tail: str | int = "all", split_bytes: int = SPLIT_BYTES
) -> tuple[DataFrame, DataFrame]:
    """``(file, at, line)`` twice: the last ``tail`` lines that files below ``path`` hold now, and a stream of all that follow.

    Every line finished after this call is in the stream, whether its beginning was there before or not, and none is
    in both. ``tail`` is as for ``logs.tail_lines``, per file; empty lines are no lines. Files are plain
    text, may appear later and only grow; one that shrinks ends the stream with an error, and a name is not used again. Bytes that are not UTF-8
    are replaced. Names and lengths of all files followed are the stream's offset, so finished files should be
    moved out of the folder. ``path`` is a URI all executors can read, or a folder they share.
    """
    parse_tail(tail)
    ship_package(spark)
    spark.dataSource.register(GrowingLogs)
    whole = _uri(path)
    options = {
        "path": whole, "lengths": json.dumps(lengths(whole), ensure_ascii=True), "splitBytes": str(split_bytes),
    }
    now = spark.read.format("growing_logs").options(**options).load()
    # A line's first byte orders the lines of a file like a number, and a block of bytes holds at most as many lines.
    numbered = now.select(F.col("file").alias("job_id"), F.col("at").alias("seq"), "line")
    last = tail_lines(numbered, tail).select(F.col("job_id").alias("file"), F.col("seq").alias("at"), "line")
    return last, spark.readStream.format("growing_logs").options(**options).load()
