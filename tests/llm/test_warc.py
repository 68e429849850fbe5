"""WARC files: round trips, derivation over what was read, and odd input."""

import gzip
import hashlib
import io
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from strandloom.llm import warc
from strandloom.llm.queries import queries

PAGES = "page_id long, url string, html string, block int, refers_to string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], PAGES)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_derivation_equals_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    want, got = c.sql(warc.DERIVE_SQL).df(), queries()["op8_warc"](spark, d).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    key = ["page_id", "warc_type"]
    for column in want.columns:
        assert want.sort_values(key)[column].astype(object).where(want.sort_values(key)[column].notna(), None).tolist() == got.sort_values(key)[column].astype(object).where(got.sort_values(key)[column].notna(), None).tolist(), column


def test_files_are_warc_files(spark, tmp_path):
    made = warc.derive(warc.response_records(pages(spark, [(i, f"http://a/{i}", f"<p>text {i}</p>") for i in range(40)])).repartition(3))
    path = str(tmp_path / "w")
    warc.write_warc(made, path)
    names = sorted(os.listdir(path))
    assert names and all(n.endswith(".warc.gz") for n in names)
    data = b"".join(gzip.open(f"{path}/{n}").read() for n in names)
    assert data.count(b"WARC/1.1\r\n") == 80 and data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n")
    assert b"WARC-Payload-Digest" not in data  # the payload's digest is the response's, not this record's
    warc.write_warc(made.limit(2), path)
    assert warc.read_warc(spark, path).count() == 2
    warc.write_warc(made.limit(1), path, mode="append")
    assert warc.read_warc(spark, path).count() == 3


def test_derivation_over_files(spark, tmp_path):
    made = warc.response_records(pages(spark, [(1, "http://a/", "<p>x &amp; y</p>"), (2, None, None), (3, "u", "é\r\n\r\nz")]))
    path = str(tmp_path / "w")
    warc.write_warc(made, path)
    back = warc.read_warc(spark, path).where("warc_type = 'response'")
    ours = {(r.refers_to, r.warc_type): r.asDict() for r in warc.derive(made).drop("page_id").collect()}
    theirs = {(r.refers_to, r.warc_type): r.asDict() for r in warc.derive(back, key="record_id").collect()}
    assert ours == theirs and len(ours) == 6


def test_values_do_not_end_their_lines(spark, tmp_path):
    url = "http://a/\r\nWARC-Target-URI: http://evil/ x"
    path = str(tmp_path / "w")
    warc.write_warc(warc.derive(warc.response_records(pages(spark, [(1, url, "t")]))), path)
    assert {r.target_uri for r in warc.read_warc(spark, path).collect()} == {"http://a/%0D%0AWARC-Target-URI:%20http://evil/%20x"}


def test_other_peoples_files(spark, tmp_path):
    """Plain and compressed files, one gzip member for all records, folded fields, unknown ones, a cut end."""
    body = "HTTP/1.0 404 Not Found\r\nServer: a\r\n\tb\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\ncaf\xe9".encode("latin-1")
    image = b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n<\x89PNG>\xff\x00"
    record = lambda kind, i, block: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{i}>\r\nX-Own: {i}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(record("warcinfo", 0, b"software: x\r\n") + record("response", 1, body))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record("response", 2, image) + record("response", 3, b"no blank line")[:-9]))
    got = {r.record_id: r for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["urn:x:0", "urn:x:1", "urn:x:2"] and got["urn:x:2"].fields == {"x-own": "2"} and bytes(got["urn:x:2"].block) == image
    made = {(r.refers_to, r.warc_type): r for r in warc.derive(warc.read_warc(spark, str(tmp_path)).where("warc_type = 'response'"), key="record_id").collect()}
    facts = made["urn:x:1", "metadata"].block
    assert made["urn:x:1", "conversion"].block == "café" and "http-status: 404\r\nsource-content-type: text/html\r\n" in facts and "source-header: Server: a b\r\n" in facts
    assert made["urn:x:1", "metadata"].source_payload_digest == "sha256:" + hashlib.sha256(b"caf\xe9").hexdigest()
    assert made["urn:x:2", "conversion"].block == "" and made["urn:x:2", "conversion"].content_length == 0


def test_odd_blocks(spark):
    rows = spark.createDataFrame([(1, "r1", None, None, None), (1, "r1", None, None, None), (2, None, "u", "d", b"HTTP/1.1 200 OK"), (3, "r3", "u", "d", b"\r\n\r\n\xff")], "page_id long, record_id string, target_uri string, warc_date string, block binary")
    got = warc.derive(rows).collect()
    assert len(got) == 8 and {r.block for r in got if r.page_id in (1, 2) and r.warc_type == "conversion"} == {""}
    assert {r.block for r in got if r.page_id == 3 and r.warc_type == "conversion"} == {"�"}
    assert warc.derive(rows.limit(0)).count() == 0 and warc.derive(rows.withColumn("warc_type", F.lit(1))).count() == 8


def test_a_large_record_comes_in_pieces():
    block = os.urandom(5_000_000)
    data = gzip.compress(warc.serialised({"warc_type": "resource", "block": block}) * 2, 1)
    got = list(warc.parsed(warc.inflated(io.BytesIO(data), 1000)))
    assert [x["block"] == block for x in got] == [True, True]


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        ("if a < b and c > d then <b>x</b>", "if a < b and c > d then x"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("<p title='x>y'>z</p>", "z"), ('<a href="a>b" x=1>c', "c"), ("<p title=don't>a</p>b", "a b"),
        ('<p title="5" screen">a', 'a'), ("a <b and c</p>d", "a <b and c d"), ("<!doctype html><p>x<!-- <p>y --> z", "x z"), ("x<script>if (a<b) c()</script>y", "x y"), ("x<script src=a>y", "x"), ("x<scripts>y", "x y"),
        ("a<br/>b&lt;c&amp;lt;", "a b<c&lt;"), ("<?xml v?>x </ y <1> <", "x </ y <1> <"), ("<p a='", "<p a='"),
    ],
)
def test_what_is_markup(markup, text):
    assert warc.plain_text(markup).decode() == text


def test_markup_takes_linear_time():
    for odd in ('<a x="1" ' * 50_000, "<a " * 100_000, "<a =" * 100_000, "<a x='" * 50_000, "<!--" * 50_000 + ">", "< " * 100_000):
        warc.plain_text(odd)


def test_pages_with_loose_signs_equal_sql(spark):
    import pandas as pd

    rows = [(i, f"http://a/{i}", x) for i, x in enumerate(["1 < 2 and 3 > 2 <b>x</b>", "<p title='x>y'>z</p> a <b and c</p>", "<p title=don't>a</p> < b", None, "", '<a href="q>r">s</a> <1>'])] + [(None, "5|u", "x"), (5, "u", "x")]
    c = duckdb.connect()
    table = pd.DataFrame(rows, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"})
    c.register("pages", table)
    want = c.sql(warc.DERIVE_SQL).df()
    got = warc.derive(warc.response_records(spark.createDataFrame(rows, "page_id long, url string, html string"))).toPandas()
    assert sorted(zip(want.record_id, want.block, want.refers_to, strict=True)) == sorted(zip(got.record_id, got.block, got.refers_to, strict=True))
    assert got.record_id.nunique() == len(got)


def record(i, block, eol=b"\r\n", length=None):
    length = str(len(block)).encode() if length is None else length
    return eol.join([b"WARC/1.0", b"WARC-Type: resource", b"WARC-Record-ID: <urn:x:%d>" % i, b"Content-Length: " + length, b"", b""]) + block + eol * 2


def found(data, size=64):
    return [(r["record_id"], r["block"]) for r in warc.parsed(warc.inflated(io.BytesIO(data), size))]


def test_damaged_records_are_passed_over():
    one, two, three = (record(i, b"block %d" % i) for i in (1, 2, 3))
    whole = [(f"urn:x:{i}", b"block %d" % i) for i in (1, 2, 3)]
    for wrong in (record(9, b"x", length=b"ten"), record(9, b"x", length=b"-4"), record(9, b"x", length=b""), record(9, b"x", length=b"900000"), b"\0" * 99, b"junk WARC/9 junk\r\n", record(9, b"x")[:40] + b"\r\n"):
        for size in (7, 64, 1 << 20):
            assert found(one + wrong + two + three, size) == whole, wrong
            assert found(b"".join(map(gzip.compress, (one, wrong, two, three))), size) == whole, wrong
            assert found(gzip.compress(one) + b"\0" * 50 + gzip.compress(two) + b"\0" * 3 + gzip.compress(three) + b"\0" * 512, size) == whole
            assert found(gzip.compress(one) + b"not gzip" + gzip.compress(two) + gzip.compress(three), size) == whole
    assert found(b"".join(record(i, b"block %d" % i, b"\n") for i in (1, 2, 3))) == whole
    assert found(one + three[:-8]) == whole[:1] and found(b"") == [] and found(b"\x1f\x8b") == []
    bad = bytearray(gzip.compress(two))
    bad[15] ^= 0xFF
    assert found(gzip.compress(one) + bytes(bad) + gzip.compress(three)) in ([whole[0], whole[2]], whole)


def test_no_file_raises():
    dice = random.Random(11)
    records = [record(i, os.urandom(dice.randint(0, 90)), dice.choice([b"\n", b"\r\n"])) for i in range(12)]
    for data in (b"".join(records), b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records))):
        assert len(found(data)) == 12
        for _ in range(600):
            other = bytearray(data)
            for _ in range(dice.randint(1, 5)):
                at = dice.randrange(len(other))
                kind = dice.random()
                if kind < 0.5:
                    other[at] = dice.randrange(256)
                elif kind < 0.75:
                    del other[at : at + dice.randint(1, 40)]
                else:
                    other[at:at] = os.urandom(dice.randint(1, 40))
                other = other or bytearray(b"x")
            found(bytes(other), dice.choice([5, 64, 4096]))
        for cut in range(0, len(data), 13):
            found(data[:cut])


def test_overwriting_leaves_other_files(spark, tmp_path):
    path = tmp_path / "w"
    path.mkdir()
    (path / "mine.txt").write_text("kept")
    made = warc.response_records(pages(spark, [(1, "http://a/", "x")]).coalesce(1))
    for _ in range(2):
        warc.write_warc(made, str(path))
        assert (path / "mine.txt").read_text() == "kept" and sum(n.endswith(".warc.gz") for n in os.listdir(path)) == 1
