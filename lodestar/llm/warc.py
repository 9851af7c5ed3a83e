"""WARC records in a content-addressed archive.

An archive is two tables in one folder: ``payloads`` holds each distinct
payload once, under its verified SHA-256, and ``headers`` the exact header bytes
of every record with the digest of its payload. Joins on the digest give the
original records back, byte for byte; revisit records have no block of their own.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_map, dropped, new_path, put, salted_join, texts_of, written

#: WARC-Date of records whose rows have no time of their own.
DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("8f0c6f3e-3f0e-4a53-9a62-1f1f5b0c8a10")
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def record_id(page: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(page))}>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_of(page: int, url: str | None, refers_to: int | None, size: int, sha1: str, block_sha1: str) -> bytes:
    """The header of a WARC 1.1 record, with the empty line that ends it. Line breaks in the url are escaped."""
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    revisit = refers_to is not None
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"X-Page-ID: {page}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"X-Payload-Length: {size}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}", "Content-Length: 0"]
    else:
        lines += ["Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha1:{block_sha1}", f"Content-Length: {len(_HTTP % size) + size}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def parse_header(header: bytes) -> dict[str, str]:
    lines = header.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:] if x)


def facts_of(record: bytes) -> tuple[int, int, str, str, int | None]:
    """(page, payload bytes, payload digest, type, page referred to) of a WARC record, checked against its block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    h = parse_header(head)
    size = int(h["Content-Length"])
    block, kind, digest = rest[:size], h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record does not end where its header says")
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if h["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}" or digest != base32_sha1(payload) or int(h["X-Payload-Length"]) != len(payload):
            raise ValueError("a header does not describe its payload")
    return int(h["X-Page-ID"]), int(h["X-Payload-Length"]), digest, kind, int(h["X-Refers-To-Page"]) if kind == "revisit" else None


class Archive:
    """A written archive in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def headers(self) -> DataFrame:
        return self.spark.read.schema("id long, digest binary, kind string, header binary").parquet(f"{self.path}/headers")

    def payloads(self) -> DataFrame:
        return self.spark.read.schema("digest binary, payload binary").parquet(f"{self.path}/payloads")

    def records(self) -> DataFrame:
        """Rows (id, digest, kind, header, payload): every record with its full payload, also where it only revisits one."""
        return self.headers().join(self.payloads(), "digest").select("id", "digest", "kind", "header", "payload")

    def warc_bytes(self) -> DataFrame:
        """Rows (id, record): the exact bytes of each WARC record, revisits without a block. Every payload is hashed again."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for kind, digest, header, payload in zip(*(b.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
                    if kind == "response" and hashlib.sha256(payload).digest() != digest:
                        raise ValueError("a stored payload does not match its digest")
                    out.append(header + (_HTTP % len(payload) + payload if kind == "response" else b"") + b"\r\n\r\n")
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "record"])

        # One record for each payload, but for repeated ids, takes it from the store: no digest is hot here.
        stored = self.headers().filter("kind = 'response'").join(self.payloads(), "digest").select("id", "kind", "digest", "header", "payload")
        bare = self.headers().filter("kind = 'revisit'").select("id", "kind", "digest", "header", F.lit(b"").alias("payload"))
        return arrow_map(stored.unionAll(bare), run, "id long, record binary")

    def export(self, path: str, file_records: int = 50_000) -> DataFrame:
        """Write the records as WARC files of about ``file_records`` each, a gzip member for each record; rows (file, records)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            members = [gzip.compress(r, mtime=0) for b in batches for r in b.column(0).to_pylist()]
            if members:
                name = f"part-{TaskContext.get().partitionId():08d}.warc.gz"
                put(f"{path}/{name}", b"".join(members))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(members)])], names=["file", "records"])

        rows = written(self.warc_bytes(), "records")
        dealt = rows.repartition(max(1, -(-rows.count() // file_records)), F.xxhash64("id")).sortWithinPartitions("id").select("record")
        return written(arrow_map(dealt, run, "file string, records long"), "files")

    def read(self) -> DataFrame:
        """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to) parsed from the bytes of the rebuilt records.

        A response must hold the block and payload that its header describes, and
        a revisit must name a response with the payload that it describes itself;
        anything else is an error.
        """

        def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [facts_of(r) for r in b.column(0).to_pylist()]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

        out = written(arrow_map(self.warc_bytes().select("record"), parsed, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"), "pages")
        told = out.filter("record_type = 'revisit'").select("payload_digest", "payload_bytes", F.col("refers_to").alias("page_id")).distinct()
        there = out.filter("record_type = 'response'").select("payload_digest", "payload_bytes", "page_id")
        if told.join(there, ["payload_digest", "payload_bytes", "page_id"], "left_anti").head(1):
            raise ValueError("a revisit does not describe the payload of its response")
        return out


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", path: str | None = None) -> Archive:
    """Write one record for each row; of equal payloads the one with the smallest id is the response, the others revisit it.

    Null bodies are empty payloads, which are stored and revisited like any
    other; a null url is an empty target; repeated ids are records of their own
    (if they hold the smallest id of a payload, all of them are responses);
    ids must not be null; an empty table gives an empty archive; other columns
    are not read.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for p in texts_of(b.column(2)):
                block = hashlib.sha1(_HTTP % len(p))
                block.update(p)
                rows.append((hashlib.sha256(p).digest(), len(p), base32_sha1(p), base64.b32encode(block.digest()).decode()))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            types = [pa.binary(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(list(c), t) for c, t in zip(cols, types, strict=True))], names=["id", "url", "digest", "size", "sha1", "block"])

    seen = written(arrow_map(src, facts, "id long, url string, digest binary, size long, sha1 string, block string"), "records")
    # Map tasks keep one body of each payload before the shuffle, so that copies are not moved.
    body = F.encode("body", "utf-8")
    check = F.struct(F.octet_length("body"), F.xxhash64("body"))
    once = src.select(F.unhex(F.sha2(body, 256)).alias("digest"), "id", body.alias("payload"), check.alias("check")).groupBy("digest")
    once = once.agg(F.min("id").alias("first"), F.first("payload").alias("payload"), F.count(F.lit(1)).alias("n"), (F.min("check") == F.max("check")).alias("same"))
    once.write.option("compression", "zstd").parquet(f"{path}/payloads")
    first = spark.read.schema("digest binary, first long, n long, same boolean").parquet(f"{path}/payloads")
    if first.filter("not same").head(1):
        raise ValueError("different payloads share a digest")

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, kinds = [], []
            for i, url, size, sha1, block, f in zip(*(b.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6)), strict=True):
                out.append(header_of(i, url, None if i == f else f, size, sha1, block))
                kinds.append("response" if i == f else "revisit")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(kinds, pa.string()), pa.array(out, pa.binary())], names=["id", "digest", "kind", "header"])

    joined = salted_join(seen, first.drop("same"), "digest", "n", F.col("id")).select("id", "url", "digest", "size", "sha1", "block", "first")
    arrow_map(joined, headed, "id long, digest binary, kind string, header binary").write.parquet(f"{path}/headers")
    dropped(seen)
    return Archive(spark, path)
