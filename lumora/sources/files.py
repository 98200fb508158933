"""Files as rows: one row a file for documents, real rows for tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes that are read as tables, and those whose parts are XML in a zip archive (fixed values).
TABLES = {"csv", "parquet", "orc", "json", "jsonl"}
OFFICE = {"docx": "word/document.xml", "pptx": "ppt/slides/"}


def _office(content: bytes, part: str) -> str:
    """The text of an office file's parts, a line for each paragraph or string."""
    lines = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for name in sorted(n for n in archive.namelist() if n.startswith(part) and n.endswith(".xml")):
            for node in ElementTree.fromstring(archive.read(name)).iter():
                if node.tag.rpartition("}")[2] in ("p", "si"):
                    lines.append("".join(x.text or "" for x in node.iter() if x.tag.rpartition("}")[2] == "t"))
    return "\n".join(lines)


def _sheets(content: bytes) -> str:
    """The cells of a workbook: sheets by their number, a line for each row, tabs between its cells (empty ones between others too)."""
    tag = lambda node: node.tag.rpartition("}")[2]
    text = lambda node: "".join(x.text or "" for x in node.iter() if tag(x) == "t")
    lines = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = archive.namelist()
        shared = [text(x) for x in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")) if tag(x) == "si"] if "xl/sharedStrings.xml" in names else []
        sheets = [n for n in names if re.fullmatch(r"xl/worksheets/[^/]*\.xml", n)]
        for name in sorted(sheets, key=lambda n: (int("".join(re.findall(r"\d", n)) or 0), n)):
            for row in (x for x in ElementTree.fromstring(archive.read(name)).iter() if tag(x) == "row"):
                cells: list[str] = []
                for cell in (x for x in row if tag(x) == "c"):
                    at = 0
                    for letter in re.match(r"[A-Z]*", cell.get("r", ""))[0]:
                        at = 26 * at + ord(letter) - 64
                    cells += [""] * (at - 1 - len(cells))
                    value = next((x.text or "" for x in cell if tag(x) == "v"), "")
                    kind = cell.get("t")
                    cells.append(shared[int(value)] if kind == "s" and value else text(cell) if kind == "inlineStr" else {"1": "TRUE", "0": "FALSE"}.get(value, value) if kind == "b" else value)
                lines.append("\t".join(cells))
    return "\n".join(lines)


def _pdf(content: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("reading PDF needs pypdf") from e
    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)


def parse(uri: str, content: bytes) -> str:
    """The text of a file by its suffix; unknown ones are UTF-8 with replacements."""
    suffix = uri.rpartition(".")[2].lower()
    if suffix in OFFICE:
        return _office(content, OFFICE[suffix])
    if suffix == "xlsx":
        return _sheets(content)
    if suffix == "pdf":
        return _pdf(content)
    return content.decode("utf-8", "replace")


def read_documents(spark: SparkSession, path: str, *, pattern: str | None = None) -> DataFrame:
    """uri, contents, error of each file below path; a file that cannot be parsed has null contents and an error."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "content")

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for uri, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    texts.append(parse(uri, content))
                    errors.append(None)
                except Exception as e:  # one bad file is a row with its error
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["uri", "contents", "error"]
            )

    return files.mapInArrow(body, "uri string, contents string, error string")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV (with header), JSON lines, Parquet or ORC table, by its suffix."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    if suffix not in TABLES:
        raise ValueError(f"no table format: {path}")
    if suffix == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    return spark.read.format({"jsonl": "json"}.get(suffix, suffix)).load(path)


def search(documents: DataFrame, condition: F.Column, *, snippet: int = 200) -> DataFrame:
    """uri and a snippet of each document that meets a condition, each uri once."""
    found = documents.where(condition).select("uri", F.substring("contents", 1, snippet).alias("snippet"))
    return found.groupBy("uri").agg(F.min("snippet").alias("snippet"))


def preview(df: DataFrame, n: int = 10) -> tuple[int, list, dict]:
    """The number of rows, the first n and the columns' types."""
    return df.count(), df.limit(n).collect(), dict(df.dtypes)
