import gzip
import json
import os
import time
import zlib

import pytest
from pyspark.sql import functions as F

from lineflow.llm import warc_derivatives as wd
from lineflow.workspace import scratch_path

TRAP = "a page about <b>WARC/1.0</b>\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\nnot a record\r\n\r\n\r\n\r\nWARC/1.0\r\n"
PAGES = [
    (1, "http://example.org/a", "<html><head><title>A &amp; b</title></head><body><p>One<p>Two <a href='/x?a=1&amp;b=2'>x</a></body>"),
    (2, "http://example.org/b c", TRAP),
    (2, "http://example.org/b c", TRAP),
    (3, None, None),
    (None, "http://example.org/n", ""),
    (4, "http://example.org/é", "é漢🙂\r\n\r\n" * 3000),
    (5, "http://example.org/long", "<p>word " * 60_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    table = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    return table.withColumn("head", F.lit("clash")).withColumn("block", F.lit("clash"))


def plain(record):
    return wd.fields_of(record.head), bytes(record.block), record.truncated


def all_of(df):
    return sorted((plain(r) for r in df.collect()), key=str)


def test_files_round_trip(spark, pages):
    path = scratch_path(spark, "warc")
    records = wd.responses_of(pages)
    wd.write_warc(records, path)
    assert all_of(wd.read_warc(spark, path)) == all_of(records)


def test_files_are_warc(spark, pages):
    path = scratch_path(spark, "warc")
    wd.write_warc(wd.responses_of(pages).coalesce(1), path)
    (name,) = [n for n in os.listdir(path) if n.endswith(".gz")]
    with gzip.open(f"{path}/{name}") as file:
        data, at, count = file.read(), 0, 0
    while at < len(data):
        assert data.startswith(b"WARC/1.0\r\n", at)
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        block = data[end + 4 : end + 4 + int(head["Content-Length"])]
        assert wd.sha1_of(block) == head["WARC-Block-Digest"]
        at = end + 4 + len(block)
        assert data[at : at + 4] == b"\r\n\r\n"
        at, count = at + 4, count + 1
    assert count == len(PAGES)


def test_derived_records_refer_to_their_response(spark, pages):
    responses = {dict(f)["WARC-Record-ID"]: (dict(f), b) for f, b, _ in all_of(wd.responses_of(pages))}
    derived = [(dict(f), b) for f, b, _ in all_of(wd.derive(wd.responses_of(pages)))]
    assert len(derived) == 2 * len(PAGES)
    for fields, block in derived:
        source, message = responses[fields["WARC-Refers-To"]]
        assert fields["WARC-Target-URI"] == source["WARC-Target-URI"]
        assert fields["WARC-Source-Payload-Digest"] == source["WARC-Payload-Digest"]
        assert fields["WARC-Block-Digest"] == wd.sha1_of(block)
        assert fields["WARC-Record-ID"] not in responses
        if fields["WARC-Type"] == "metadata":
            facts = json.loads(block)
            assert facts["digests_match"] and not facts["truncated"]
            assert ["Content-Type", "text/html; charset=utf-8"] in facts["headers"]
    by_type = {(f["X-Source-Id"], f["WARC-Type"]): b for f, b in derived}
    assert by_type["1", "conversion"] == b"One\nTwo x"
    facts = json.loads(by_type["1", "metadata"])
    assert (facts["title"], facts["links"]) == ("A & b", ["/x?a=1&b=2"])
    assert by_type["3", "conversion"] == b""


def test_other_records_and_bad_ones():
    assert wd.derivatives([("WARC-Type", "request")], b"GET", False) == []
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain; charset=nothing\r\n\r\nab\xff"
    fields = [("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:WRONG")]
    (_, facts, _), (_, text, _) = wd.derivatives(fields, block, True)
    facts = json.loads(facts)
    assert not facts["digests_match"] and facts["truncated"] and text == "ab�".encode()
    assert wd.derivatives([("WARC-Type", "response")], b"no head", False)[1][1] == b"no head"


def test_truncated_file(spark, pages):
    path = scratch_path(spark, "warc")
    wd.write_warc(wd.responses_of(pages.filter("page_id = 5")).coalesce(1), path)
    (name,) = [n for n in os.listdir(path) if n.endswith(".gz")]
    with gzip.open(f"{path}/{name}") as file:
        data = file.read()
    broken = scratch_path(spark, "broken")
    os.makedirs(broken)
    with gzip.open(f"{broken}/a.warc.gz", "wb") as file:
        file.write(data[:5000])
    (record,) = wd.read_warc(spark, broken).collect()
    assert record.truncated and len(record.block) < 5000


def test_digests_of_the_query(spark, pages):
    rows = wd.record_digests(wd.derive(wd.responses_of(pages))).collect()
    assert len(rows) == 2 * len(PAGES)
    assert {r.page_id for r in rows} == {1, 2, 3, None, 4, 5}
    assert {r.record_type for r in rows} == {"metadata", "conversion"}


def test_empty_table(spark, pages):
    path = scratch_path(spark, "warc")
    wd.write_warc(wd.derive(wd.responses_of(pages.filter("false"))), path)
    assert wd.read_warc(spark, path).collect() == []


def test_text_of_pages_whose_head_is_not_closed():
    head = "<html><head><meta charset=utf-8><title>A title</title><style>p{}</style>"
    for start in (head, head + "<body>", head + "</head>", head + "</head><body>", "<title>A title</title>", "<head><title>A title</head><body>"):
        assert wd.plain_text(start + "<p>One <b>two</b><p>Three</body></html>") == "One two\nThree"


# ---- what other writers leave ----------------------------------------------


def http(body, *headers):
    return b"\r\n".join([b"HTTP/1.1 200 OK", *headers, b"", body])


def derived_of(spark, tmp_path, *records):
    """Derivatives of a file with these heads and blocks: (type, refers to, block)."""
    content = b"".join(b"WARC/1.0\r\n" + head + b"\r\n\r\n" + block + b"\r\n\r\n" for head, block in records)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(gzip.compress(content))
    found = wd.derive(wd.read_warc(spark, str(tmp_path / "in"))).collect()
    return [(f["WARC-Type"], f["WARC-Refers-To"], bytes(r.block)) for r in found for f in [dict(wd.fields_of(r.head))]]


@pytest.mark.parametrize("length", [b"abc", b"-5", b"", "٣".encode(), b"1e3"])
def test_a_length_that_is_no_number(spark, tmp_path, length):
    block = http(b"<p>one")
    head = b"WARC-Type: response\r\nWARC-Record-ID: <r1>\r\nContent-Length: " + length
    good = b"WARC-Type: response\r\nWARC-Record-ID: <r2>\r\nContent-Length: " + str(len(block)).encode()
    found = derived_of(spark, tmp_path, (head, block), (good, block))
    assert [(t, of) for t, of, _ in found] == [(t, of) for of in ("<r1>", "<r2>") for t in ("metadata", "conversion")]
    assert found[1][2] == found[3][2] == b"one"


def test_names_and_media_types_have_no_case(spark, tmp_path):
    block = http(b"<p>one</p>two", b"CONTENT-TYPE: TEXT/HTML; CHARSET=UTF-8")
    head = b"warc-type: Response\r\nwarc-record-id: <r>\r\nwarc-target-uri: http://e.org/\r\nCONTENT-LENGTH: " + str(len(block)).encode()
    found = derived_of(spark, tmp_path, (head, block))
    assert [(t, of) for t, of, _ in found] == [("metadata", "<r>"), ("conversion", "<r>")]
    assert found[1][2] == b"one\ntwo"


PAGE = "<p>Grüße</p>".encode()


@pytest.mark.parametrize(
    "headers, body, text, decoded",
    [
        ([b"Content-Encoding: gzip"], gzip.compress(PAGE), "Grüße", True),
        ([b"content-encoding: X-GZIP"], gzip.compress(PAGE), "Grüße", True),
        ([b"Content-Encoding: deflate"], zlib.compress(PAGE), "Grüße", True),
        ([b"Content-Encoding: deflate"], zlib.compress(PAGE)[2:-4], "Grüße", True),
        ([b"Transfer-Encoding: chunked"], b"5\r\n<p>Gr\r\n9;x=1\r\n" + PAGE[5:14] + b"\r\n0\r\n\r\n", "Grüße", True),
        ([b"Content-Encoding: gzip"], gzip.compress(PAGE)[:-9], "", False),
        ([b"Content-Encoding: br"], b"whatever", "", False),
        ([b"Content-Encoding: identity"], PAGE, "Grüße", True),
    ],
)
def test_encoded_bodies(headers, body, text, decoded):
    found = wd.derivatives([("WARC-Type", "response")], http(body, b"Content-Type: text/html", *headers), False)
    assert found[1][1].decode() == text and json.loads(found[0][1])["body_decoded"] is decoded


def test_many_separators_in_a_block_take_linear_time():
    import pyarrow as pa

    piece = b"x" * 20
    head = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 100000000\r\n\r\n"
    table = pa.table({"value": [head] + [piece] * 60_000, "file": ["f"] * 60_001})
    start = time.perf_counter()
    (found,) = [r for b in wd._record_batches(iter(table.to_batches())) for r in b.to_pylist()]
    assert found["truncated"] and len(found["block"]) == 60_000 * (20 + 14)
    assert time.perf_counter() - start < 5
