"""Line logs as a data source: ``spark.read.format("textguard_lines").load(path)``.

Files are cut into ranges of bytes, one partition each, so that a single large log is read by many tasks; a range reads
the lines that begin inside it. Lines keep their file and the byte at which they begin, by which the order of a log can
be told. Lines that do not fit the format come with the column ``malformed`` and nulls elsewhere, so none is lost.

Formats: ``access`` (common and combined), ``csv`` (a header line at the top of each file, spelt in several ways), ``json`` (one object
a line, its columns given by the schema). Paths are whatever Arrow's file systems reach: local folders, hdfs://, s3:// and gs://.
"""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructType

from .patterns import LOG_LINE

#: Columns that every row has besides those of its format.
PLACE = "file string, offset long, malformed string"
#: Headers under which the columns of a CSV log may stand.
HEADERS = {"ip": ("ip", "clientip", "client_ip"), "user_agent": ("user_agent", "useragent", "ua")}
#: Bytes read at once where a line is sought.
BLOCK = 1 << 20


class Range(InputPartition):
    """The lines of a file that begin at byte ``begin`` or later, but before ``end``."""

    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def lines_of(opened, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in a range of an opened file, without their line ends."""
    at = begin
    if begin:
        opened.seek(begin - 1)  # a line that begins right here follows a line end
        at = begin - 1
    else:
        opened.seek(0)
    rest, skipping = b"", bool(begin)
    while True:
        block = opened.read(BLOCK)
        parts = (rest + block).split(b"\n")
        rest = parts.pop() if block else b""
        for part in parts:
            if skipping:
                skipping = False
            elif at < end and (part or block):
                yield at, part.removesuffix(b"\r")
            at += len(part) + 1
        if not block or (at >= end and not skipping):
            return


class LinesReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.kind = options["path"], options.get("kind", "access")
        self.size, self.columns = int(options.get("rangebytes", 64 << 20)), columns
        if self.kind not in ("access", "csv", "json"):
            raise ValueError(f"unknown kind of log {self.kind!r}")

    def _system(self):
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[Range]:
        system, path = self._system()
        top = system.get_file_info(path)
        if top.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [top] if top.is_file else [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
        return [Range(f.path, b, min(f.size, b + self.size)) for f in sorted(files, key=lambda f: f.path) for b in range(0, f.size, self.size)] or [Range("", 0, 0)]

    def _parser(self, opened):
        """What makes the values of the columns of a line, or None where it does not fit."""
        if self.kind == "access":
            shape = re.compile(LOG_LINE)
            return lambda line: (m.group(1), m.group(2)) if (m := shape.match(line)) else None
        if self.kind == "json":
            names = self.columns

            def parse(line: str) -> tuple | None:
                try:
                    row = json.loads(line)
                except ValueError:
                    return None
                text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
                return tuple(text(row.get(n)) for n in names) if isinstance(row, dict) else None

            return parse
        header = next((line for _, line in lines_of(opened, 0, 1)), b"").decode("utf-8", "replace")
        named = {h.strip().lower(): i for i, h in enumerate(next(csv.reader([header]), []))}
        places = [[named[h] for h in HEADERS[c] if h in named] for c in ("ip", "user_agent")]

        def cut(line: str) -> tuple | None:
            cells = next(csv.reader([line]), [])
            ip, agent = (next((cells[i] for i in at if i < len(cells) and cells[i]), "") for at in places)
            return (ip.strip(), agent) if ip.strip() else None

        return cut

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        system = self._system()[0]
        with system.open_input_file(partition.path) as opened:
            parse = self._parser(opened)
            for offset, raw in lines_of(opened, partition.begin, partition.end):
                if not raw.strip() or (self.kind == "csv" and offset == 0):
                    continue
                line = raw.decode("utf-8", "replace")
                values = parse(line)
                yield (*(values or (None,) * len(self.columns)), partition.path, offset, None if values else line)


class LineLog(DataSource):
    """Options: ``kind`` (access, csv, json) and ``rangeBytes``; a schema names the columns of JSON lines, all of them strings."""

    @classmethod
    def name(cls) -> str:
        return "textguard_lines"

    def schema(self) -> str:
        return f"ip string, user_agent string, {PLACE}"

    def reader(self, schema: StructType) -> LinesReader:
        own = [f.name for f in schema.fields[:-3]]
        if [f.name for f in schema.fields[-3:]] != ["file", "offset", "malformed"] or any(f.dataType != StringType() for f in schema.fields[:-3]):
            raise ValueError(f"the schema must be string columns followed by {PLACE}")
        return LinesReader(self.options, own)


def read_lines(spark: SparkSession, path: str, kind: str = "access", columns: list[str] = ("ip", "user_agent"), range_bytes: int = 64 << 20):
    """Lines of the logs below ``path`` with file, offset and malformed (see the module)."""
    spark.dataSource.register(LineLog)
    schema = ", ".join(f"`{c}` string" for c in columns) + ", " + PLACE
    return spark.read.format("textguard_lines").schema(schema).option("kind", kind).option("rangeBytes", range_bytes).load(path)
