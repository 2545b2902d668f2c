"""WARC archives: writing one record per page, and reading with verified record boundaries.

Writing: payloads of at least ``MIN_SHARED`` bytes that several pages have are stored once, with the page
of the largest id; the others become revisit records that refer to it. Spark's text writer puts the
records into files of bounded length, with the blank lines that end a record as the line separator.

Reading: Spark's text reader splits the files at the magic of a record. Each piece is a candidate: its
task works out its offset, reads its header and emits the offset of its successor. Pointer jumping
from offset 0 of each file (twice as far in each round) keeps the candidates that the chain of
lengths reaches; magic inside a payload is not reached, and its pieces are joined to the record
they belong to. Plain files are split among tasks, gzip files are read by one task each.

* A null html is an empty payload. Pages with equal page_id are separate records; if they share the
  payload of the largest id, each of them is a response. A null page_id is written without a number,
  is a response of its own, and is read back as null.
* A null url is left out; line breaks in a url become blanks. Extra columns are not archived.
* A file that does not begin with a record has no records; a record that its file cuts off is dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillwork.llm.common import stored
from rillwork.session import scratch_path

# Fixed values of the format, and bounds of this writer.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_SHARED = 1000
RECORDS_PER_FILE = 4096
DATE = "1970-01-01T00:00:00Z"


def _record(kind: Column, refers_to: Column, date: str) -> Column:
    """A record's bytes as text, without the blank lines that end it."""
    name = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    payload, size = F.col("payload"), F.octet_length("payload").cast("string")
    body = F.concat(F.lit(HTTP), size, F.lit(END), F.when(kind == "response", payload).otherwise(""))
    uri = F.regexp_replace(F.col("url").cast("string"), "[\r\n]+", " ")
    return F.concat(
        F.lit(MAGIC), line("WARC-Type", kind), line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Date", F.lit(date)), F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(payload.cast("binary")))),
        F.when(kind == "revisit", F.concat(
            line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", name(refers_to)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body,
    )


def write_archives(pages: DataFrame, path: str, compression: str = "gzip", date: str = DATE) -> None:
    """Write every row (page_id, url, html) as a record below ``path``."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("mark", F.when(F.octet_length("payload") >= MIN_SHARED, F.sha2("payload", 256)))
    shared = rows.where("mark is not null").groupBy("mark").agg(
        F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n"))
    shared = stored(shared.where("n > 1 and holder is not null").select("mark", "holder"), "shared")
    rows = rows.join(shared, "mark", "left")
    kind = F.when(F.col("page_id") != F.col("holder"), "revisit").otherwise("response")
    records = rows.select(_record(kind, F.col("holder"), date).alias("value"))
    writer = records.write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE)
    writer.option("compression", compression).text(path)


FIELDS = "type string, record string, refers string, uri string, digest string, told long, payload_bytes long, sha1 string"
_CANDIDATE = f"file string, block long, at long, length long, reach long, {FIELDS}"


def _header(piece: bytes) -> tuple[dict[bytes, bytes], int, int] | None:
    """Fields, size of the header and size of the block of the record that a piece begins; else None."""
    size = piece.find(b"\r\n\r\n")
    if size < 0:
        return None
    lines = [line.partition(b":") for line in piece[:size].split(b"\r\n")]
    fields = {key.strip().lower(): value.strip() for key, _, value in lines}
    length = fields.get(b"content-length", b"")
    if not re.fullmatch(rb"[0-9]{1,18}", length) or b"warc-type" not in fields:
        return None
    return fields, size + 4, int(length)


def _payload(block: bytes) -> tuple[bytes, int]:
    """Payload of an HTTP block and the length that its header gives."""
    head, _, payload = block.partition(b"\r\n\r\n")
    told = re.search(rb"content-length:\s*([0-9]+)", head.lower())
    return payload, int(told[1]) if told else len(payload)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(
        F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[tuple[str, int, int, bytes]]]]:
    """Pieces with their place, counted from the first magic of their part of the file.

    The first piece of a file lies before its first magic; it has place -1 and only shifts the rest.
    """
    last, at = None, 0
    for batch in batches:
        rows = []
        for piece, file, block in zip(batch["piece"], batch["file"].to_pylist(), batch["block"].to_pylist()):
            piece = piece.as_py() or b""
            if (file, block) != last:
                last, at = (file, block), 0
                if block == 0:
                    rows.append((file, block, -1, piece))
                    continue
            rows.append((file, block, at, piece))
            at += len(MAGIC) + len(piece)
        yield batch, rows


def _candidates(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in _CANDIDATE.split(", ")]
        kinds = [pa.string() if part.endswith("string") else pa.int64() for part in _CANDIDATE.split(", ")]
        for _, rows in _walk(batches):
            columns: list[list] = [[] for _ in names]
            for file, block, at, piece in rows:
                cells = [file, block, at, len(piece) + (len(MAGIC) if at >= 0 else 0), *[None] * 9]
                found = _header(piece) if at >= 0 else None
                if found:
                    fields, head, size = found
                    text = [fields.get(k, b"").decode("utf-8", "replace") or None for k in (
                        b"warc-type", b"warc-record-id", b"warc-refers-to", b"warc-target-uri", b"warc-payload-digest")]
                    payload, told = _payload(piece[head:head + size])
                    cells[4:] = [len(MAGIC) + head + size + len(END), *text, told, len(payload),
                                 hashlib.sha1(payload, usedforsecurity=False).hexdigest()]
                for column, cell in zip(columns, cells):
                    column.append(cell)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    found = stored(_pieces(spark, path).mapInArrow(run, _CANDIDATE), "candidates")
    # Where each part of a file begins: sums of the parts before it, a few rows for each file.
    parts = found.groupBy("file", "block").agg(F.sum("length").alias("bytes"), F.sum(
        F.when(F.col("at") < 0, F.col("length")).otherwise(0)).alias("before"))
    order = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    base = F.coalesce(F.sum("bytes").over(order), F.lit(0)) + F.col("before")
    parts = parts.select("file", "block", base.alias("base"))
    placed = found.where("at >= 0").join(parts, ["file", "block"])
    offset = F.col("base") + F.col("at")
    return stored(placed.select(
        "file", "block", "at", offset.alias("offset"), (offset + F.col("length")).alias("end"),
        (offset + F.col("reach")).alias("next"), *[part.split()[0] for part in FIELDS.split(", ")]), "placed")


def chain(links: DataFrame) -> DataFrame:
    """(file, offset) that are reached from offset 0 of each file over (file, offset, next) links.

    Pointer jumping: in each round the reached set doubles, and so does what a pointer spans.
    """
    reached = stored(links.where("offset = 0").select("file", "offset"), "reached")
    jump = links.where("next is not null").select("file", "offset", "next")
    while True:
        further = reached.join(jump, ["file", "offset"]).select("file", F.col("next").alias("offset"))
        size = stored(further.join(links.select("file", "offset"), ["file", "offset"], "left_semi"), "further")
        if not size.limit(1).count():
            return reached
        reached = stored(reached.unionByName(size).distinct(), "reached")
        target = jump.select("file", F.col("offset").alias("next"), F.col("next").alias("after"))
        jump = stored(jump.join(target, ["file", "next"]).select("file", "offset", F.col("after").alias("next")), "jump")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, type, record, refers, uri, digest, told, payload_bytes, sha1) of every record.

    ``told`` is the payload length that the record states, ``payload_bytes`` and ``sha1`` are those of the payload in
    the archive.
    """
    placed = _candidates(spark, path)
    real = placed.join(chain(placed.select("file", "offset", "next")), ["file", "offset"])
    # A record that ends inside its own piece is whole; anything behind it there is no record.
    whole = real.where(F.col("next") <= F.col("end"))
    torn = stored(real.where(F.col("next") > F.col("end")), "torn")
    fields = [part.split()[0] for part in FIELDS.split(", ")]
    if not torn.limit(1).count():
        return whole.select("file", "offset", *fields)

    # Records whose payload holds magic: their pieces lie between their offset and their successor.
    pieces = placed.select("file", "block", "at", "offset", "end")
    heads = torn.select("file", F.col("offset").alias("head"), "next")
    owner = F.last("head", ignorenulls=True).over(
        W.partitionBy("file").orderBy("offset").rowsBetween(W.unboundedPreceding, 0))
    reach = F.last("next", ignorenulls=True).over(
        W.partitionBy("file").orderBy("offset").rowsBetween(W.unboundedPreceding, 0))
    marked = pieces.join(heads, (pieces["file"] == heads["file"]) & (pieces["offset"] == heads["head"]), "left").select(
        pieces["file"], "block", "at", "offset", "end", "head", "next")
    parts = marked.withColumn("head", owner).withColumn("next", reach).where(
        F.col("head").isNotNull() & (F.col("offset") < F.col("next")))
    parts = stored(parts.select("file", "block", "at", "offset", "end", "head"), "parts")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _walk(batches):
            at = pa.array([r[2] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["file"], batch["block"], at, batch["piece"]], ["file", "block", "at", "piece"])

    bytes_ = _pieces(spark, path).mapInArrow(place, "file string, block long, at long, piece binary")
    joined = bytes_.join(parts, ["file", "block", "at"]).groupBy("file", "head").agg(
        F.array_sort(F.collect_list(F.struct("offset", "piece"))).alias("pieces"), F.max("end").alias("last"))
    mended = joined.join(torn.select("file", F.col("offset").alias("head"), "next", "type", "record", "refers", "uri", "digest"),
                         ["file", "head"]).where(F.col("last") >= F.col("next"))

    @F.arrow_udf("struct<told long, payload_bytes long, sha1 string>")
    def measure(pieces: pa.Array) -> pa.Array:
        rows = []
        for value in pieces:
            text = MAGIC.encode().join(p["piece"] for p in value.as_py())
            _, head, size = _header(text)
            payload, told = _payload(text[head:head + size])
            rows.append({"told": told, "payload_bytes": len(payload),
                         "sha1": hashlib.sha1(payload, usedforsecurity=False).hexdigest()})
        return pa.array(rows, pa.struct([("told", pa.int64()), ("payload_bytes", pa.int64()), ("sha1", pa.string())]))

    mended = mended.withColumn("m", measure("pieces")).select(
        "file", F.col("head").alias("offset"), "type", "record", "refers", "uri", "digest", "m.*")
    return whole.select("file", "offset", *fields).unionByName(mended.select("file", "offset", *fields))


def page_number(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, "<urn:page:(-?[0-9]*)>", 1), F.lit("")).cast("long")


def archive_round_trip(pages: DataFrame, compression: str = "gzip") -> DataFrame:
    """Write the pages, read the archives back, and give one row per record."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, compression)
    records = read_archives(pages.sparkSession, path)
    revisit = F.col("type") == "revisit"
    return records.select(
        page_number(F.col("record")).alias("page_id"),
        F.when(revisit, F.col("told")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.substring_index("digest", ":", -1)).otherwise(F.col("sha1")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(revisit, page_number(F.col("refers"))).alias("refers_to"),
    )
