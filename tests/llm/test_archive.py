"""The WARC archive against a plain version, and exact round trips."""

import hashlib
import re

import duckdb
import pytest

from tallyzone.llm import archive as A

SCHEMA = "page_id long, url string, html string, digest string, size int, header binary"
LONG = "<p>" + "long \r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 30


def plain(rows, least=A.LEAST):
    """(page, bytes, digest, type, page of the response), sorted."""
    out, first = [], {}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    for page, _, html in order:
        body = (html or "").encode()
        digest = hashlib.sha256(body).hexdigest()
        if len(body) < least or digest not in first:
            first.setdefault(digest, page)
            out.append((page, len(body), digest, "response", None))
        else:
            out.append((page, len(body), digest, "revisit", first[digest]))
    return sorted(out, key=str)


def asked(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "x", 1, b"y") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    got = A.op12_warc_archive(spark, str(tmp_path)).collect()
    assert len({r["record_id"] for r in got}) == len(rows)
    return sorted((tuple(r)[:5] for r in got), key=str)


ROWS = [(5, "http://a", LONG), (3, "http://b", LONG), (3, "http://b", LONG), (3, None, LONG), (None, None, LONG),
        (9, "http://a\r\nPage-ID: 1\r\n", "short"), (2, "http://c", "short"), (7, None, None), (8, "", ""),
        (10, "http://d", "ü" * 50), (11, "http://e", "ü" * 50), (12, "http://f", "ü" * 49 + "a"),
        (13, "http://g", "x" * 3_000_000), (14, "http://g", "x" * 3_000_000)]


def test_plain_version(spark, tmp_path):
    assert asked(spark, ROWS, tmp_path) == plain(ROWS)


def test_given_pages(spark):
    path = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select page_id, url, html from '{path}/pages.parquet'").fetchall()
    got = sorted((tuple(r)[:5] for r in A.op12_warc_archive(spark, path).collect()), key=str)
    assert got == plain(rows)


def test_empty_table(spark, tmp_path):
    assert asked(spark, [], tmp_path) == []


def test_records_and_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "x", 1, b"y") for r in ROWS], SCHEMA)
    A.write_archive(pages, f"{tmp_path}/archive")
    stored = spark.read.parquet(f"{tmp_path}/archive/payloads").count()
    assert stored == len({r[2] or "" for r in ROWS})  # payload bytes once
    records = A.read_archive(spark, f"{tmp_path}/archive")
    found = records.collect()
    assert len(found) == len(ROWS)
    for r in found:
        header, http, body = bytes(r["record"]).split(b"\r\n\r\n", 2)
        lines = dict(line.split(b": ", 1) for line in header.split(b"\r\n")[1:])
        assert header.startswith(b"WARC/1.1\r\nWARC-Type: ")
        assert body.endswith(b"\r\n\r\n")
        body = body[:-4]
        assert int(lines[b"Content-Length"]) == len(http) + 4 + len(body)
        assert int(re.search(rb"Content-Length: (\d+)", http)[1]) == len(r["payload"])
        assert lines[b"WARC-Payload-Digest"] == b"sha256:" + hashlib.sha256(r["payload"]).hexdigest().encode()
        assert body == (b"" if lines[b"WARC-Type"] == b"revisit" else bytes(r["payload"]))
    ids = {r["record_id"] for r in found}
    assert {re.search(r"WARC-Refers-To: (\S+)", bytes(r["header"]).decode())[1]
            for r in found if r["record_type"] == "revisit"} <= ids

    A.write_warc(records, f"{tmp_path}/files", per_file=3)
    files = A.read_warc(spark, f"{tmp_path}/files").collect()
    assert len({f["file"] for f in files}) >= 4
    assert sorted(bytes(f["header"]) + bytes(f["block"]) + b"\r\n\r\n" for f in files) == \
        sorted(bytes(r["record"]) for r in found)


def test_damage_is_noticed(spark, tmp_path):
    A.write_archive(spark.createDataFrame([(1, "u", "z" * 200)], "page_id long, url string, html string"),
                    f"{tmp_path}/a")
    bad = spark.createDataFrame([(hashlib.sha256(b"z" * 200).hexdigest(), b"y" * 200)], "digest string, payload binary")
    bad.write.mode("overwrite").parquet(f"{tmp_path}/a/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        A.read_archive(spark, f"{tmp_path}/a").collect()
    with pytest.raises(ValueError, match="longer"):
        list(A.whole_records([("f", b"WARC/1.1\r\nContent-Length: 2"), ("f", b"abc")]))


def test_two_payloads_under_one_digest(spark):
    rows = spark.createDataFrame([("d", b"aa", 2), ("d", b"ab", 2)], "digest string, payload binary, size long")
    with pytest.raises(Exception, match="two payloads"):
        A.payloads(rows).collect()
