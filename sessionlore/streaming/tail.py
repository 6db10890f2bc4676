"""Following a growing log file, and the text of its lines.

The built-in file source sees new files only, so appended bytes come from a
Python data source. An offset is (head, position): a digest of the file's first
line, and a place after a line's end. A line that is still being written, and a
character cut in two, wait for a later batch. Each batch is cut at line ends into spans
for several tasks, which read the path that the driver sees. A file whose first line
is another one, or that has become shorter than the position, was started anew and is
read from its beginning. The reader keeps no state: a restarted query goes on from its
checkpoint, whatever happened to the file meanwhile.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions import coerce, scalars

TRIGGER = "500 milliseconds"
BLOCK = 1 << 20
#: Bytes that a task reads: a backlog is cut at line ends into spans of about that size.
SPAN = 64 << 20
#: Bytes of a first line that tell a file from its successor.
HEAD = 256


class Span(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def last_line_end(path: str, start: int, size: int) -> int:
    """The position after the last line end between start and size, or start; read from the back."""
    with open(path, "rb") as f:
        high = size
        while high > start:
            low = max(start, high - BLOCK)
            f.seek(low)
            at = f.read(high - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            high = low
    return start


def next_line_end(path: str, start: int, size: int) -> int:
    """The position after the first line end from start on, or size."""
    with open(path, "rb") as f:
        f.seek(start - 1)  # a line may end just there
        at = start - 1
        while at < size:
            data = f.read(min(BLOCK, size - at))
            if (found := data.find(b"\n")) >= 0:
                return at + found + 1
            if not data:
                break
            at += len(data)
    return size


def head_of(path: str) -> str:
    """A digest of the first line, or of its first bytes; empty where there is no whole line yet."""
    with open(path, "rb") as f:
        data = f.read(HEAD)
    line, end, _ = data.partition(b"\n")
    return hashlib.md5(line).hexdigest() if end or len(data) == HEAD else ""


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, from_start: bool):
        self.path, self.from_start = path, from_start

    def initialOffset(self) -> dict:
        now = self.latestOffset()
        return now | {"position": 0} if self.from_start else now

    def latestOffset(self) -> dict:
        try:
            head, size = head_of(self.path), os.path.getsize(self.path)
        except FileNotFoundError:
            return {"head": "", "position": 0}
        return {"head": head, "position": last_line_end(self.path, 0, size) if head else 0}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        same = start["head"] == end["head"] and end["position"] >= start["position"]
        at, out = start["position"] if same else 0, []
        while at < end["position"]:  # a long backlog is read by many tasks
            cut = min(at + SPAN, end["position"])
            if cut < end["position"]:
                cut = next_line_end(self.path, cut, end["position"])
            out.append(Span(self.path, at, cut))
            at = cut
        return out

    def read(self, partition: Span) -> Iterator[tuple[str]]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            left = partition.end - partition.start
            while left > 0 and (line := f.readline(left)):
                left -= len(line)
                yield (line.decode("utf-8", "replace").rstrip("\r\n"),)


class TailSource(DataSource):
    """``format("tail")`` with options path and from_start (false: begin at the end of the file)."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> TailReader:  # noqa: ARG002
        return TailReader(self.options["path"], self.options.get("from_start", "false").lower() == "true")


def follow(spark: SparkSession, path: str, from_start: bool = False) -> DataFrame:
    """A stream of the lines appended to a file, blank ones left out."""
    spark.dataSource.register(TailSource)
    lines = spark.readStream.format("tail").option("path", path).option("from_start", str(from_start).lower()).load()
    return lines.where(F.trim("value") != "")


def formatted(lines: DataFrame, column: str = "value") -> DataFrame:
    """(line, class): a short text for each line, and how it would be shown."""
    return lines.select(format_line(F.col(column)).alias("line"), line_class(F.col(column)).alias("class"))


def format_line(line: Column) -> Column:
    v = F.try_parse_json(line)
    at = scalars.short_time(F.coalesce(coerce.text(v, "$.timestamp"), coerce.text(v, "$.ts"), F.lit("")))
    kind = coerce.text(v, "$.type")
    took = coerce.count(v, "$.durationMs")
    record = F.concat(at, F.lit(" ["), kind, F.lit("]"), F.when((kind == "system") & (took > 0), F.concat(F.lit(" "), took.cast("string"), F.lit("ms"))).otherwise(F.lit("")))
    level = F.coalesce(coerce.text(v, "$.level"), coerce.text(v, "$.severity"), F.lit("info"))
    message = F.coalesce(coerce.text(v, "$.message"), coerce.text(v, "$.msg"), line)
    log = F.concat(F.when(at == "", F.lit("")).otherwise(F.concat(at, F.lit(" "))), F.lit("["), level, F.lit("] "), message)
    return F.when(v.isNull(), line).when(kind.isNotNull(), record).otherwise(log)


def line_class(line: Column) -> Column:
    """Fixed words: levels of structured lines, or parts of plain ones."""
    v = F.try_parse_json(line)
    level = F.lower(F.coalesce(coerce.text(v, "$.level"), coerce.text(v, "$.severity"), F.lit("info")))
    structured = F.when(level.isin("error", "fatal", "critical"), "error").when(level.isin("warn", "warning"), "warn").when(level.isin("debug", "trace"), "debug").otherwise("plain")
    has = lambda *words: F.rlike(F.lower(line), F.lit("|".join(words)))
    plain = F.when(has("error", "fatal"), "error").when(has("warn"), "warn").when(has("tool_call", "tool_use"), "tool").when(has("debug", "trace"), "debug").otherwise("plain")
    return F.when(v.isNull(), plain).when(coerce.text(v, "$.type").isNotNull(), "record").otherwise(structured)
