"""WARC archives with revisit resolution: equal payloads are written once."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.shared import in_order, narrowed, written

#: RFC 4648's base32 letters (fixed value).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"
BLANK = re.compile(rb"[\r\n]*")
RECORD = "record_id string, record_type string, page_id long, url string, declared_digest string, refers_to_id string, payload binary"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a binary column in upper-case base32 (160 bits: 32 letters, no padding)."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]  # 40 bits each
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def record_id(page_id: Column, digest: Column) -> Column:
    """A record's id: a URN made from the MD5 of its page's number and payload digest, so that only equal records share it."""
    digits = F.md5(F.concat_ws(":", F.lit("page"), F.coalesce(page_id.cast("string"), F.lit("none")), digest))
    cut = [F.substring(digits, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def resolve(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, digest, original, original_url: `original` is null for responses.

    Headers alone (digest and length with the smallest page) are aggregated and joined back
    by digest; a digest that a third of the pages share is summed before the shuffle and
    split by the adaptive skew join. Of payloads of at least `least_bytes` bytes, the rows
    with the smallest page_id are responses and the others revisit them; smaller ones are
    all responses. Null html is an empty payload; repeated rows with the smallest id are
    all responses; a page without id is a response if none of its payload has an id.
    """
    rows = narrowed(pages, page_id=id_col, url=url_col, html=html_col).select(
        F.col("page_id").cast("long"), F.regexp_replace("url", r"[\r\n]", "").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    rows = rows.withColumn("digest", base32_sha1(F.encode("html", "utf-8"))).withColumn("bytes", F.octet_length("html"))
    headers = rows.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(
        F.min(F.struct("page_id", "url")).alias("first"), F.min("page_id").alias("least")
    )
    # struct order puts a null id first; the smallest id that is not null counts
    headers = headers.select("digest", "bytes", "least", F.when(F.col("first.page_id") == F.col("least"), F.col("first.url")).alias("least_url"))
    joined = rows.join(headers, ["digest", "bytes"], "left")
    revisit = ~F.col("page_id").eqNullSafe(F.col("least")) & F.col("least").isNotNull()
    return joined.select(
        "page_id", "url", "html", "digest",
        F.when(revisit, F.col("least")).alias("original"), F.when(revisit, F.col("least_url")).alias("original_url"),
    )


def _member(record: bytes) -> bytes:
    """A gzip member of its own, without a time, so that equal records give equal bytes."""
    return zlib.compress(record, 6, wbits=31)


def write(
    resolved: DataFrame, path: str, *, date: str | None = None, date_col: str | None = None, records_per_file: int = 2000, software: str = "lumora"
) -> None:
    """Write the rows of resolve() as gzipped WARC 1.1 files, each record with fresh headers.

    Each file begins with a warcinfo record, and each record is a gzip member, so that a
    reader can start at any of them. A response's block is an HTTP header and the payload; a
    revisit's has the header alone. A record's date is that of `date_col` (a timestamp) or
    else `date`, by default the time of this call; a null url becomes urn:page: and the id.
    Spark's text writer takes the bytes as they are, with an empty member as its line
    separator, so the archives go to whatever store the path names.
    """
    now = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    own = F.date_format(F.to_utc_timestamp(F.col(date_col), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date_col else F.lit(None)
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.octet_length("html").cast("string"), F.lit(END + END),
    )
    revisit = F.col("original").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))

    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))),
        line("WARC-Date", F.coalesce(own, F.lit(now))),
        line("WARC-Target-URI", F.coalesce(F.col("url"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("WARC-Page-ID", F.col("page_id").cast("string")),
        line("WARC-Profile", F.when(revisit, PROFILE)),
        line("WARC-Refers-To", F.when(revisit, record_id(F.col("original"), F.col("digest")))),
        line("WARC-Refers-To-Target-URI", F.when(revisit, F.coalesce("original_url", F.concat(F.lit("urn:page:"), F.col("original").cast("string"))))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit(END),
    )
    records = resolved.withColumn("block", block).select(F.encode(F.concat(head, "block", F.lit(END + END)), "utf-8").alias("value"))
    about = f"software: {software}{END}format: WARC File Format 1.1{END}"

    def info(number: int) -> bytes:
        name = uuid.uuid5(uuid.NAMESPACE_URL, f"{path}/{now}/{number}")
        lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {now}", "Content-Type: application/warc-fields", f"Content-Length: {len(about)}"]
        return (END.join(lines) + END + END + about + END + END).encode()

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                members = []
                for record in batch.column("value").slice(at, 200):
                    if seen % records_per_file == 0:  # the writer begins a file after so many rows
                        members.append(_member(info(task << 32 | seen)))
                        seen += 1
                    members.append(_member(record.as_buffer()))
                    seen += 1
                yield {"value": pa.array(members, pa.binary())}

    members = records.mapInArrow(in_order(["value"], body), "value binary")
    members.select(F.col("value").cast("string").alias("value")).write.options(
        lineSep=_member(b"").decode("latin-1"), encoding="ISO-8859-1", maxRecordsPerFile=records_per_file, compression="none"
    ).text(path)


def _unpacked(content: memoryview, piece: int = 1 << 14) -> Iterator[bytes]:
    """The bytes of an archive in pieces, whether it is gzipped, member after member, or plain."""
    packed, at, open_ = bytes(content[:2]) == b"\x1f\x8b", 0, None
    while at < len(content):
        given = content[at : at + piece]
        at += len(given)
        if packed:
            open_ = open_ or zlib.decompressobj(wbits=31)
            given = open_.decompress(given)
            if open_.eof:
                at, open_ = at - len(open_.unused_data), None
        yield bytes(given)
    if open_:
        raise ValueError("the last gzip member is cut off")


def parse(content: bytes | memoryview) -> Iterator[tuple]:
    """The responses and revisits of one archive, plain or gzipped, as rows of RECORD.

    The archive is read as a stream, of which one record is held at a time; other types of
    records are passed over. Header names are taken in any case, with or without a blank after the
    colon, and continued lines are joined. What a foreign record lacks is null.
    """
    pieces, held, at = _unpacked(memoryview(content)), bytearray(), 0

    def more() -> None:
        piece = next(pieces, None)
        if piece is None:
            raise ValueError("the last record is cut off")
        held.extend(piece)

    while True:
        if at > 1 << 20:
            del held[:at]
            at = 0
        while (at := BLANK.match(held, at).end()) == len(held):
            piece = next(pieces, None)
            if piece is None:
                return
            held.extend(piece)
        while len(held) < at + 5:
            more()
        if held[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at {bytes(held[at : at + 20])!r}")
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            more()
        head: dict[str, str] = {}
        name = None
        for line in held[at:end].decode("utf-8", "replace").split(END)[1:]:
            if line[:1] in (" ", "\t") and name:
                head[name] += " " + line.strip()
            elif ":" in line:
                name, _, value = line.partition(":")
                name = name.strip().lower()
                head[name] = value.strip()
        size = int(head["content-length"])
        while len(held) < end + 4 + size:
            more()
        kind = head.get("warc-type", "").lower()
        if kind in ("response", "revisit"):
            block = bytes(held[end + 4 : end + 4 + size])
            page = head.get("warc-page-id", "")
            digest = head.get("warc-payload-digest")
            yield (
                head.get("warc-record-id"), kind, int(page) if page.lstrip("-").isdigit() else None, head.get("warc-target-uri"),
                digest.rpartition(":")[2] if digest else None, head.get("warc-refers-to"), block.partition(b"\r\n\r\n")[2] if kind == "response" else None,
            )
        at = end + 4 + size


def read(spark: SparkSession, path: str) -> DataFrame:
    """The responses and revisits of all archives under path; a revisit's payload is null."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                held = 0
                for row in parse(memoryview(content.as_buffer())):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if len(rows) == 500 or held > 16 << 20:
                        yield dict(zip(names, map(pa.array, zip(*rows, strict=True), kinds), strict=True))
                        rows, held = [], 0
                if rows:
                    yield dict(zip(names, map(pa.array, zip(*rows, strict=True), kinds), strict=True))

    names = [x.split()[0] for x in RECORD.split(", ")]
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(in_order(names, body), RECORD)


def restored(records: DataFrame) -> DataFrame:
    """record_id, page_id, payload_bytes, payload_digest, record_type, refers_to of each record of read().

    Length and digest are taken from the payloads that were read; revisits are joined to the
    response that they refer to, by its record id or, if they name none, by its digest.
    Repeated responses count once in that join; a revisit whose response is in no archive
    has null length, and the digest that it declares. A record without a page's number has a null page_id.
    """
    digest = F.when(F.col("record_type") == "response", base32_sha1(F.col("payload"))).otherwise(F.upper("declared_digest"))
    known = records.select(
        "record_id", "record_type", "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"),
        F.coalesce("refers_to_id", F.concat(F.lit("sha1:"), digest)).alias("to"),
    )
    known = written(known, "warc-headers")
    names = ["record_id", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses, revisits = known.where("record_type = 'response'"), known.where("record_type = 'revisit'")
    least = F.min(F.struct(F.col("page_id").isNull(), "page_id", "payload_bytes", "payload_digest")).alias("o")
    of = responses.groupBy(F.col("record_id").alias("to")).agg(least)
    by_digest = revisits.where("to like 'sha1:%'").select(F.col("to").substr(F.lit(6), F.length("to")).alias("payload_digest")).distinct()
    foreign = responses.join(by_digest, "payload_digest", "left_semi").groupBy(F.concat(F.lit("sha1:"), "payload_digest").alias("to")).agg(least)
    found = revisits.withColumnsRenamed({"payload_bytes": "_", "payload_digest": "declared"}).join(of.unionByName(foreign), "to", "left").select(
        "record_id", "page_id", F.col("o.payload_bytes").alias("payload_bytes"), F.coalesce("o.payload_digest", "declared").alias("payload_digest"),
        "record_type", F.col("o.page_id").alias("refers_to"),
    )
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(names).unionByName(found.select(names))
