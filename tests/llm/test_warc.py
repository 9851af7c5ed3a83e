import base64
import gzip
import hashlib

import pytest

from lodestar.llm import warc as W

ROWS = [
    (7, "http://a", "<p>x</p>"), (3, "http://b\r\nX: y", "<p>x</p>"), (9, None, None), (2, "u", ""), (5, "v", "é" * 5000), (6, "v", "é" * 5000),
    (11, "w: z", "only\r\n\r\nWARC/1.1"), (12, "", "<p>x</p>"),
]


def want(rows):
    body = {i: (h or "").encode() for i, _, h in rows}
    first = {}
    for i in sorted(body):
        first.setdefault(body[i], i)
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    return sorted((i, len(b), sha(b), "response" if first[b] == i else "revisit", None if first[b] == i else first[b]) for i, b in body.items())


def test_read_back(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in ROWS], "page_id long, url string, html string, digest string, id string").repartition(3)
    a = W.write_archive(df)
    assert sorted(tuple(r) for r in a.read().collect()) == want(ROWS)
    assert a.payloads().count() == 4
    assert {r.id: bytes(r.payload).decode() for r in a.records().collect()} == {i: h or "" for i, _, h in ROWS}


def test_records_are_exact(spark):
    a = W.write_archive(spark.createDataFrame(ROWS, "page_id long, url string, html string"))
    recs = {r.id: bytes(r.record) for r in a.warc_bytes().collect()}
    for i, _, h in ROWS:
        head, _, block = recs[i].partition(b"\r\n\r\n")
        fields = W.parse_header(head)
        block = block[:-4]
        assert len(block) == int(fields["Content-Length"]) and recs[i].endswith(b"\r\n\r\n")
        if fields["WARC-Type"] == "response":
            assert block.endswith((h or "").encode())
            assert fields["WARC-Block-Digest"] == "sha1:" + W.base32_sha1(block)


def test_damage_is_found(spark, tmp_path):
    a = W.write_archive(spark.createDataFrame(ROWS, "page_id long, url string, html string"))
    bad = a.payloads().selectExpr("digest", "cast('zz' as binary) payload")
    bad.write.parquet(f"file://{tmp_path}/payloads")
    a.headers().write.parquet(f"file://{tmp_path}/headers")
    with pytest.raises(Exception, match="does not match its digest"):
        W.Archive(spark, f"file://{tmp_path}").read().collect()


def test_empty(spark):
    a = W.write_archive(spark.createDataFrame([], "page_id long, url string, html string"))
    assert a.read().collect() == []
    assert a.warc_bytes().collect() == []


def test_repeated_rows(spark):
    a = W.write_archive(spark.createDataFrame([(1, "u", "h"), (1, "u", "h"), (2, "u", "h")], "page_id long, url string, html string"))
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in a.read().collect()) == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]


def test_false_headers_are_found(spark, tmp_path):
    a = W.write_archive(spark.createDataFrame(ROWS, "page_id long, url string, html string"))
    a.payloads().write.parquet(f"file://{tmp_path}/payloads")
    a.headers().selectExpr("id", "digest", "kind", "cast(replace(cast(header as string), 'X-Refers-To-Page: 3', 'X-Refers-To-Page: 9') as binary) header").write.parquet(f"file://{tmp_path}/headers")
    with pytest.raises(ValueError, match="does not describe"):
        W.Archive(spark, f"file://{tmp_path}").read()
    rec = bytes(a.warc_bytes().filter("id = 3").first().record)
    for bad in (rec.replace(b"<p>x", b"<p>y"), rec[:-1], rec.replace(b"X-Payload-Length: 8", b"X-Payload-Length: 9")):
        with pytest.raises(ValueError):
            W.facts_of(bad)


def test_export(spark, tmp_path):
    """The files hold all records one after the other, readable by any gzip reader."""
    a = W.write_archive(spark.createDataFrame(ROWS, "page_id long, url string, html string"))
    files = a.export(f"file://{tmp_path}/out", file_records=3).collect()
    assert sum(r.records for r in files) == len(ROWS) and len(files) > 1
    want = {bytes(r.record) for r in a.warc_bytes().collect()}
    got = b"".join(gzip.decompress((tmp_path / "out" / r.file).read_bytes()) for r in files)
    assert len(got) == sum(map(len, want)) and all(r in got for r in want)


def test_hot_payload_is_split(spark, monkeypatch):
    """A payload that most rows share is joined in parts, with the same result."""
    from lodestar.llm import common

    monkeypatch.setattr(W, "salted_join", lambda *x: common.salted_join(*x, size=7))
    rows = [(k, "u", None if k % 3 else "p" * (k % 5)) for k in range(100)]
    assert sorted(tuple(r) for r in W.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string")).read().collect()) == want(rows)
