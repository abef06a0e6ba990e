"""Data sources of disclosure files: the text lines of reports, and web pages.

``keelson_lines`` and ``keelson_pages`` have one partition for each file, so
files are read at once and each keeps its own line numbers. A file is read as a
stream, in batches; only a page is held whole, as its row is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Lines of a batch.
LINES = 1 << 14


def found(spark: SparkSession, pattern: str) -> list[str]:
    """The files that a pattern names, or that stand in the folders it names, in order of name; a name for each report."""
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for status in store.globStatus(p) or ():
        inside = store.listStatus(status.getPath()) if status.isDirectory() else [status]
        out += [f.getPath().toString() for f in inside if f.isFile() and f.getPath().getName()[0] not in "._"]
    return sorted(out)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class _Files(DataSource):
    def __init__(self, options) -> None:
        super().__init__(options)
        self.paths = json.loads(options["paths"])


class ReportLines(_Files):
    """(path, page, line_no, line): numbered from 0 through the file; a form feed ends a line and a page."""

    @classmethod
    def name(cls) -> str:
        return "keelson_lines"

    def schema(self) -> str:
        return "path string, page int, line_no int, line string"

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self.paths)


class WebPages(_Files):
    """(path, html): whole pages; bytes that are no UTF-8 are left out."""

    @classmethod
    def name(cls) -> str:
        return "keelson_pages"

    def schema(self) -> str:
        return "path string, html string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.paths)


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[_File]:
        return [_File(p) for p in self.paths]

    @staticmethod
    def opened(path: str):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        return store.open_input_stream(inner)


def lines_of(chunks: Iterator[bytes]) -> Iterator[tuple[int, str]]:
    """(page, line) of a text that comes in pieces, which may part a character or a line's end."""
    page, rest = 0, b""
    for chunk in chunks:
        *whole, rest = (rest + chunk).split(b"\n")
        for line in whole:
            parts = line.removesuffix(b"\r").split(b"\f")
            for i, part in enumerate(parts):
                page += i > 0
                yield page, part.decode("utf-8", "replace")
    if rest:
        for i, part in enumerate(rest.split(b"\f")):
            page += i > 0
            yield page, part.decode("utf-8", "replace")


class _LineReader(_Reader):
    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        names, kinds = ["path", "page", "line_no", "line"], [pa.string(), pa.int32(), pa.int32(), pa.string()]
        rows: list[tuple] = []
        with self.opened(partition.path) as stream:
            for n, (page, line) in enumerate(lines_of(iter(lambda: stream.read(1 << 20), b""))):
                rows.append((partition.path, page, n, line))
                if len(rows) == LINES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class _PageReader(_Reader):
    def read(self, partition: _File) -> Iterator[tuple[str, str]]:
        with self.opened(partition.path) as stream:
            yield partition.path, stream.read().decode("utf-8", "ignore")


def _loaded(spark: SparkSession, source: type[_Files], pattern: str) -> DataFrame:
    spark.dataSource.register(source)
    paths = found(spark, pattern)
    if not paths:
        raise FileNotFoundError(pattern)
    return spark.read.format(source.name()).option("paths", json.dumps(paths)).load()


def report_lines_of(spark: SparkSession, pattern: str) -> DataFrame:
    return _loaded(spark, ReportLines, pattern)


def web_pages(spark: SparkSession, pattern: str) -> DataFrame:
    return _loaded(spark, WebPages, pattern)
