"""A content-addressed WARC archive: payload bytes once, record headers apart, records through joins.

``write_archive`` keeps two tables in a folder:

* ``payloads``: each distinct payload once, addressed by its SHA-256. What is
  put under one digest is verified to be the same bytes by length and a
  second hash, map side first, so a payload that a third of all pages share
  leaves each map task once.
* ``headers``: one row per record, the exact bytes from ``WARC/1.1`` to the
  end of the HTTP header.

``read_archive`` joins them into records again; a stored payload whose bytes
don't give its address is an error. Of pages with equal payloads of
``LEAST`` bytes or more, the one of the smallest id is the response and the
others revisit it; smaller payloads are always responses.

``write_warc`` writes the records as WARC 1.1 files and ``read_warc`` reads
such files: both go through Spark's text files with the record separator as
line end, a record that holds the separator is put together again by its
content length.

The keys of the joins are digests; the side with hot digests holds small rows
(headers), which adaptive execution splits. No window or list gathers the
copies of a payload.

Defined results: a null html is the empty payload; a null url gives no target
line, a null page id no page line and the last place among equal payloads;
line ends in a url are percent-encoded; ties of the page id are broken by the
url, rows repeated in all three columns are records of their own with running
numbers, the first of them may be the response; a payload of any length is
one value; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyzone.llm.common import mapped, read_table, stored
from tallyzone.session import shared_dir

#: Payloads below this many bytes are never replaced by a revisit.
LEAST = 100
#: Pages carry no time of their capture.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
RECORDS_PER_FILE = 50_000


def page_rows(pages: DataFrame, id: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """``page_id, url, payload, digest, size`` of each page."""
    payload = F.coalesce(F.col(body).cast("binary"), F.lit(b"").cast("binary"))
    return (pages.select(F.col(id).alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
            .withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long")))


def _name(page: Column, url: Column, digest: Column, copy: Column) -> Column:
    """A record's id: a UUID drawn from what tells it from all others."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("?")) for c in (page, digest, copy, url)]
    h = F.sha2(F.concat_ws(" ", *parts).cast("binary"), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, nothing for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _uri(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _header(date: str) -> Column:
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("size").cast("string"), F.lit(END))
    first, revisit = F.col("first"), F.col("record_type") == "revisit"
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    again = F.concat(
        _line("WARC-Profile", F.lit(PROFILE)),
        _line("WARC-Refers-To", _name(first["page_id"], first["url"], F.col("digest"), F.lit(1))),
        _line("WARC-Refers-To-Target-URI", _uri(first["url"])), _line("WARC-Refers-To-Date", F.lit(date)),
        _line("Refers-To-Page-ID", first["page_id"].cast("string")))
    return F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _name(F.col("page_id"), F.col("url"), F.col("digest"), F.col("copy"))),
        _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", _uri(F.col("url"))),
        _line("Page-ID", F.col("page_id").cast("string")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, again).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), _line("Content-Length", length.cast("string")),
        F.lit("\r\n"), http)


def headers(rows: DataFrame, date: str = DATE, least: int = LEAST) -> DataFrame:
    """``header, digest`` of the record of each of :func:`page_rows`."""
    pages = stored(rows.groupBy("page_id", "url", "digest", "size").agg(F.count(F.lit(1)).alias("copies")), "pages")
    first = F.min(F.struct(F.col("page_id").isNull(), "page_id", F.col("url").isNull(), "url"))
    leaders = pages.where(F.col("size") >= least).groupBy("digest").agg(first.alias("first"))
    records = (pages.join(leaders, "digest", "left")
               .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))))
    leads = (F.col("page_id").eqNullSafe(F.col("first")["page_id"]) & F.col("url").eqNullSafe(F.col("first")["url"])
             & (F.col("copy") == 1))
    kind = F.when(F.col("first").isNull() | leads, F.lit("response")).otherwise(F.lit("revisit"))
    return records.withColumn("record_type", kind).select(_header(date).cast("binary").alias("header"), "digest")


def payloads(rows: DataFrame) -> DataFrame:
    """``digest, payload``: each distinct payload of :func:`page_rows` once, an error where a digest has two."""
    other = F.xxhash64("payload")
    once = rows.groupBy("digest").agg(
        F.first("payload").alias("payload"), F.min(other).alias("low"), F.max(other).alias("high"),
        F.min("size").alias("least"), F.max("size").alias("most"))
    same = (F.col("low") == F.col("high")) & (F.col("least") == F.col("most"))
    return once.select("digest", F.when(same, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("two payloads under digest "), F.col("digest"))).cast("binary")).alias("payload"))


def write_archive(pages: DataFrame, folder: str, date: str = DATE, least: int = LEAST, **columns) -> None:
    """The archive of ``pages`` in a new ``folder``."""
    rows = page_rows(pages, **columns)
    payloads(rows).write.parquet(f"{folder}/payloads")
    headers(rows, date, least).write.parquet(f"{folder}/headers")


def _field(name: str) -> Column:
    """A header field, null where there is none."""
    found = F.regexp_extract(F.col("header").cast("string"), f"\\r\\n{name}: ([^\\r\\n]*)\\r\\n", 1)
    return F.when(F.col("header").cast("string").contains(f"\r\n{name}: "), found)


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """``header`` of every record with the fields that are read from its bytes."""
    return spark.read.schema("header binary, digest string").parquet(f"{folder}/headers").select(
        "header", _field("WARC-Record-ID").alias("record_id"), _field("WARC-Type").alias("record_type"),
        _field("Page-ID").alias("page"), _field("Refers-To-Page-ID").alias("refers_to"),
        F.substring(_field("WARC-Payload-Digest"), 8, 64).alias("digest"))


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """``digest, payload``, every payload checked against its address."""
    found = spark.read.schema("digest string, payload binary").parquet(f"{folder}/payloads")
    return found.select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("binary")).alias("payload"))


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The records: header fields, full payload, and ``record``, the exact bytes with the closing line ends."""
    found = read_headers(spark, folder).join(read_payloads(spark, folder), "digest", "left")
    there = F.coalesce(F.col("payload"), F.raise_error(F.concat(F.lit("no payload "), F.col("digest"))).cast("binary"))
    body = F.when(F.col("record_type") == "revisit", F.lit(b"").cast("binary")).otherwise(F.col("payload"))
    return found.withColumn("payload", there).withColumn(
        "record", F.concat(F.col("header"), body, F.lit(END.encode()).cast("binary")))


def write_warc(records: DataFrame, folder: str, per_file: int = RECORDS_PER_FILE) -> None:
    """WARC files of ``records`` (:func:`read_archive`), at most ``per_file`` records each."""
    line = F.substring(F.col("record"), F.lit(1), F.octet_length("record") - len(END)).cast("string")
    records.select(line.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(folder)


def whole_records(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, bytes, bytes]]:
    """(file, header, block) of files cut at every separator: a block has as many bytes as its header says."""
    file, header, block, left = None, None, [], 0
    for own, piece in pieces:
        if own != file:
            if header is not None:
                raise ValueError(f"{file} ends inside a record")
            file = own
        if header is None:
            if not piece:
                continue
            length = re.search(rb"\r\nContent-Length: *(\d+)", piece)
            if not piece.startswith(b"WARC/") or length is None:
                raise ValueError(f"{own}: no record header")
            header, block, left = piece, [], int(length[1])
            if left:
                continue
        else:
            block.append(piece)
            left -= len(piece)
            if left > 0:
                block.append(END.encode())
                left -= len(END)
                if left >= 0:
                    continue
            if left < 0:
                raise ValueError(f"{own}: a block is longer than its header says")
        yield own, header + END.encode(), b"".join(block)
        header = None
    if header is not None:
        raise ValueError(f"{file} ends inside a record")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """``file, header, block`` of every record of WARC files; a file is read by one task, record by record."""
    lines = spark.read.option("lineSep", END).text(folder).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"), F.col("value").cast("binary").alias("value"))
    ordered = lines.repartition("file").sortWithinPartitions("file", "start", "line").select("file", "value")

    def run(batches):
        def pieces():
            for batch in batches:
                yield from zip(batch.column("file").to_pylist(), batch.column("value").to_pylist())

        out, held = [], 0
        for record in whole_records(pieces()):
            out.append(record)
            held += len(record[2])
            if held > 1_000_000:
                yield pa.record_batch([pa.array(c) for c in zip(*out)], ["file", "header", "block"])
                out, held = [], 0
        if out:
            yield pa.record_batch([pa.array(c) for c in zip(*out)], ["file", "header", "block"])

    return mapped(ordered, run, "file string, header binary, block binary")


def op12_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back from the archive."""
    pages, folder = read_table(spark, sf_dir, "pages"), shared_dir(spark, "archive")
    write_archive(pages, folder)
    kind = pages.schema["page_id"].dataType
    back = read_payloads(spark, folder).select("digest", F.sha2("payload", 256).alias("payload_digest"),
                                               F.octet_length("payload").cast("long").alias("payload_bytes"))
    found = read_headers(spark, folder).join(back, "digest", "left")
    return found.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        F.col("refers_to").cast(kind).alias("refers_to"), "record_id")
