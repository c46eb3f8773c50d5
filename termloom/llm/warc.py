"""A content-addressed WARC archive.

Two tables hold the records: ``payloads`` has each payload once under its SHA-256, and
``headers`` each record's header block byte for byte, with the address of its payload.
Joining them on the address gives back the original records; every payload that is read
is hashed again and must match both its address and the SHA-1 that its header names.

Of the records with equal payloads that with the smallest page_id is the response, the
others are revisits of it. A null payload is an empty one; a null url gives a header
without a target; rows that repeat page_id and payload are all responses; null ids are
never the smallest where there are others. Control characters in a url are escaped. An
empty table makes an empty archive. Payloads of any length are hashed and stored whole.
Further columns, whatever their names, are not read.

The block of a response is the html alone, without an HTTP head, as its source has none.
Record ids name the page_id, so they are as unique as it is.
"""

from __future__ import annotations

import gzip
import io
import re
from base64 import b16decode, b32encode
from dataclasses import dataclass
from hashlib import sha1, sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import arrow_map, cut, ready, write
from termloom.runtime import work_path

#: Records carry this date unless the caller names another; an archive is the same each time it is written.
DATE = "2000-01-01T00:00:00Z"
IDENTITY = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
UNSAFE = re.compile(r"[\x00-\x20\x7f]")


@dataclass(frozen=True)
class Archive:
    """Where an archive's two tables are."""

    headers: str
    payloads: str


def header_block(page_id: int | None, url: str | None, digest: str, n_bytes: int, refers_to: int | None, revisit: bool, date: str) -> bytes:
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{IDENTITY}{page_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{IDENTITY}{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(0 if revisit else n_bytes))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def parse_header(block: bytes) -> dict[str, str]:
    """The fields of a header block, names in lower case."""
    lines = re.split("\r?\n", block.decode())
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC header")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def page_of(identity: str | None) -> int | None:
    number = (identity or "").strip("<>").removeprefix(IDENTITY)
    return int(number) if number.lstrip("-").isdigit() else None


def write_archive(pages: DataFrame, folder: str, min_bytes: int = 0, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", date: str = DATE) -> Archive:
    """Write one record per row; payloads of fewer than min_bytes are never revisited.

    Hashing stays in the JVM. The smallest ids come from a partial aggregation, so a
    group of copies of any size leaves each task as one row.
    """
    payload = F.encode(F.coalesce(F.col(html_column).cast("string"), F.lit("")), "utf-8")
    records = pages.select(F.col(id_column).cast("bigint").alias("page_id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload")).select("*", F.sha2("payload", 256).alias("address"), F.octet_length("payload").cast("bigint").alias("n_bytes"))
    narrow = records.select("page_id", "url", "address", "n_bytes", F.upper(F.sha1("payload")).alias("sha1"))
    rows = records.select("address", "page_id").groupBy("address", "page_id").agg(F.count("*").alias("n"))
    firsts = cut(rows.groupBy("address").agg(F.min("page_id").alias("first_id"), F.max("n").alias("n")))
    revisit = (F.col("n_bytes") >= F.lit(min_bytes)) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    typed = narrow.join(firsts.drop("n"), "address").select("page_id", "url", "address", "n_bytes", "sha1", "first_id", revisit.alias("revisit"))

    def make():
        def block(columns):
            ids, urls, addresses, sizes, digests, firsts, revisits = columns
            blocks = [header_block(i, u, b32encode(b16decode(d)).decode(), n, f, r, date) for i, u, d, n, f, r in zip(ids, urls, digests, sizes, firsts, revisits, strict=True)]
            return [ids, addresses, blocks]

        return block

    archive = Archive(f"{folder}/headers", f"{folder}/payloads")
    write(arrow_map(typed, make, [("page_id", "bigint"), ("address", "string"), ("header", "binary")], rows=4096), archive.headers)
    repeated = not firsts.where("n > 1").isEmpty()
    own = firsts.select(F.col("address").alias("own"), "first_id")
    once = records.join(own, (F.col("address") == F.col("own")) & F.col("page_id").eqNullSafe(F.col("first_id")), "left_semi").select("address", "payload")
    # Each address has one first row, unless whole rows are repeated: only then a second shuffle makes them one.
    write(once.dropDuplicates(["address"]) if repeated else once, archive.payloads)
    return archive


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """page_id, header, payload and address of every record: each header joined to its payload, a revisit's to that of its response."""
    headers, payloads = spark.read.parquet(archive.headers), spark.read.parquet(archive.payloads)
    return headers.join(payloads, "address").select("page_id", "header", "payload", "address")


def original_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """page_id and record: the bytes of each record as in a WARC file, revisits without a block."""
    full = read_archive(spark, archive)
    block = F.when(F.instr(F.col("header").cast("string"), "WARC-Type: revisit\r\n") > 0, F.lit(b"")).otherwise(F.col("payload"))
    return full.select("page_id", F.concat("header", block, F.lit(b"\r\n\r\n")).alias("record"))


def verified_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to of every record that is read back."""

    def make():
        def block(columns):
            _, headers, payloads, addresses = columns
            rows = []
            for header, payload, address in zip(headers, payloads, addresses, strict=True):
                fields = parse_header(header)
                digest = b32encode(sha1(payload).digest()).decode()
                if sha256(payload).hexdigest() != address or fields["warc-payload-digest"] != f"sha1:{digest}":
                    raise ValueError(f"the payload of {fields['warc-record-id']} does not match its digests")
                rows.append((page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], len(payload), digest, page_of(fields.get("warc-refers-to"))))
            return list(map(list, zip(*rows, strict=True))) if rows else [[]] * 6

        return block

    schema = [("page_id", "bigint"), ("url", "string"), ("record_type", "string"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("refers_to", "bigint")]
    return arrow_map(read_archive(spark, archive), make, schema)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write an archive in the shared folder and read every record back."""
    spark = pages.sparkSession
    archive = write_archive(pages, work_path(spark), min_bytes)
    return verified_records(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def parse_file(data: bytes):
    """(fields, block) of each record in the bytes of a WARC file, gzipped or not; it is decompressed record by record."""
    file = io.BytesIO(data)
    if data[:2] == b"\x1f\x8b":
        file = gzip.GzipFile(fileobj=file)
    while line := file.readline():
        if not line.startswith(b"WARC/"):
            continue
        header = [line]
        while (line := file.readline()) not in (b"\r\n", b"\n", b""):
            header.append(line)
        fields = parse_header(b"".join(header))
        yield fields, file.read(int(fields.get("content-length", 0)))


#: Bytes of blocks that go to the JVM together, about.
BATCH_BYTES = 8_000_000


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, url and block of every record of .warc or .warc.gz files.

    A file is one row that is read by one task, so it may have 2 GB at most; its records
    are passed on in batches as they are parsed.
    """
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("block", pa.binary())])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for content in batch.column(0):
                for fields, block in parse_file(content.as_py()):
                    rows.append((fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), block))
                    size += len(block)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), schema.types)], schema=schema)

    ready(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "record_id string, record_type string, url string, block binary")
