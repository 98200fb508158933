"""Documents as a data source of Spark: files dealt by bytes, large text files by ranges, chosen before anything is opened.

Files are chosen by options of the load. Filters of a query are not taken over: Spark 4.1 keeps the partitions that one query's
filters left for all later queries of the same load (seen: a count after a filtered count gave the filtered one).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumora.functions.text import CHARS
from lumora.sources.files import parse

#: Suffixes whose files may be cut at line ends, bytes of a partition and of a range of one file.
LINES = {"txt", "md", "csv", "tsv", "json", "jsonl", "log"}
PARTITION, RANGE = 32 << 20, 16 << 20
SCHEMA = "uri string, suffix string, size long, modified timestamp, start long, contents string, error string"


@dataclass(frozen=True)
class Piece:
    """Bytes of a file from `start` to before `end`."""

    uri: str
    size: int
    modified: dt.datetime | None
    start: int
    end: int


@dataclass
class Part(InputPartition):
    pieces: tuple[Piece, ...]


def suffix_of(uri: str) -> str:
    name = uri.rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name else ""


class DocumentSource(DataSource):
    """spark.read.format("documents").load(path): uri, suffix, size, modified, start, contents, error.

    A row for each file, or for each range of a text file over `rangeBytes`, cut at line ends (a line is in the range that it begins
    in; start is the range's first byte). A file that cannot be parsed has null contents and an error. Paths are local or of any store
    that Arrow opens by its URI. Options: suffixes (with commas between), under (how a path goes on below the
    folder), after and before (ISO times between which a file was modified), smallest and largest (bytes), partitionBytes, rangeBytes.
    """

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(self.options)


class DocumentReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.partition, self.range = int(options.get("partitionBytes", PARTITION)), int(options.get("rangeBytes", RANGE))
        self.suffixes = {x.strip().lower() for x in options["suffixes"].split(",")} if "suffixes" in options else None
        self.under = options.get("under", "")
        time = lambda name, default: dt.datetime.fromisoformat(options[name]).replace(tzinfo=dt.UTC) if name in options else default
        self.after, self.before = time("after", dt.datetime.min.replace(tzinfo=dt.UTC)), time("before", dt.datetime.max.replace(tzinfo=dt.UTC))
        self.smallest, self.largest = int(options.get("smallest", 0)), int(options.get("largest", 1 << 62))

    def _wanted(self, piece: Piece, below: str) -> bool:
        time = piece.modified or dt.datetime.min.replace(tzinfo=dt.UTC)
        return (
            (self.suffixes is None or suffix_of(piece.uri) in self.suffixes) and below.startswith(self.under)
            and self.after <= time <= self.before and self.smallest <= piece.size <= self.largest
        )

    def partitions(self) -> list[Part]:
        """Ranges in the order of their files, a partition for each partitionBytes; only names, sizes and times are read."""
        store, path = opened(self.path)
        found = store.get_file_info(path)
        files = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        hidden = lambda x: any(p[0] in "_." for p in x.removeprefix(path).split("/") if p)
        parts: list[list[Piece]] = [[]]
        filled = 0
        for x in sorted((x for x in files if x.type == fs.FileType.File and not hidden(x.path)), key=lambda x: x.path):
            whole = Piece(self._uri(x.path, path), x.size, x.mtime, 0, x.size)
            if not self._wanted(whole, x.path.removeprefix(path).lstrip("/")):
                continue
            step = self.range if suffix_of(whole.uri) in LINES else max(1, x.size)
            for at in range(0, max(1, x.size), step):
                piece = Piece(whole.uri, x.size, x.mtime, at, min(x.size, at + step))
                if parts[-1] and filled + piece.end - piece.start > self.partition:
                    parts.append([])
                    filled = 0
                parts[-1].append(piece)
                filled += piece.end - piece.start
        return [Part(tuple(p)) for p in parts if p] or [Part(())]

    def _uri(self, found: str, path: str) -> str:
        return found if "://" not in self.path else self.path.rstrip("/") + found.removeprefix(path.rstrip("/"))

    def read(self, part: Part) -> Iterator[tuple]:
        for piece in part.pieces:
            contents = error = None
            try:
                contents = text_of(piece)
            except Exception as e:  # one bad file is a row with its error
                error = f"{type(e).__name__}: {e}"
            yield piece.uri, suffix_of(piece.uri), piece.size, piece.modified, piece.start, contents, error


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def text_of(piece: Piece) -> str:
    """The lines that begin in the piece, or the text of a whole file."""
    store, path = opened(piece.uri)
    with store.open_input_file(path) as file:
        if suffix_of(piece.uri) not in LINES:
            return parse(piece.uri, file.read())
        start = piece.start
        if start:  # from after the line end at or behind the byte before
            start = _after_line(file, start - 1, piece.size)
        end = piece.end if piece.end >= piece.size else _after_line(file, piece.end - 1, piece.size)
        file.seek(start)
        return file.read(max(0, end - start)).decode("utf-8", "replace")


def _after_line(file, at: int, size: int, step: int = 1 << 16) -> int:
    file.seek(at)
    while at < size:
        some = file.read(step)
        found = some.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(some)
    return size


def scan(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The source over a folder or a file, with the options of DocumentSource."""
    spark.dataSource.register(DocumentSource)
    return spark.read.format("documents").options(**options).load(path)


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """suffix, files, bytes, tokens (estimated from the bytes) below path, by Spark's own listing: no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    name = F.substring_index("path", "/", -1)
    suffix = F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")
    return files.groupBy(suffix.alias("suffix")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.sum((F.floor(F.col("length") / CHARS) + 1).cast("long")).alias("tokens")
    )
