"""A content-addressed WARC archive: payload bytes once per digest, record headers apart, records by joining them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurelens.llm.common import named

_URN = "urn:x-page:"
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """Where the two parts of an archive lie."""

    headers: str
    payloads: str


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base32 without padding: five hex digits at a time become four characters."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substr(digest, F.lit(i), F.lit(5)), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archive(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> Archive:
    """Write one WARC/1.1 record per page under ``folder``.

    ``payloads`` has each distinct payload once, addressed by its SHA-256. ``headers`` has every record's exact header
    bytes (WARC header and HTTP header) and the address of its payload. Of pages with equal payloads the one with the
    largest key is a response, the others are revisits that refer to it.

    Defined results: a null payload is empty and has a record like any other; a null key is smaller than all keys and
    is written as ``null``; a null URL has no target line, line breaks in a URL are percent-encoded. Rows alike in key
    and payload are all responses, with one stored payload. Extra columns are not archived.
    """
    out = Archive(f"{folder}/headers", f"{folder}/payloads")
    data = F.coalesce(named(payload), F.lit("")).cast("binary")
    addressed = pages.select(
        named(key).cast("long").alias("page"), named(url).cast("string").alias("url"), data.alias("payload"),
    ).withColumn("address", F.sha2("payload", 256))
    newest = addressed.groupBy("address").agg(F.max("page").alias("newest"))
    light = addressed.select("page", "url", "address", F.length("payload").alias("n"), base32_sha1(F.col("payload")).alias("sha1"))
    records = light.join(newest, "address")
    records.select("address", _header_bytes().alias("header")).write.parquet(out.headers)
    addressed.select("address", "payload").dropDuplicates(["address"]).write.parquet(out.payloads)
    return out


def _header_bytes() -> Column:
    """The exact bytes before a record's payload."""
    eol = F.lit("\r\n")
    is_response = F.col("page").eqNullSafe(F.col("newest"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"),
        eol, eol,
    )
    block = F.octet_length(http) + F.when(is_response, F.col("n")).otherwise(F.lit(0))
    safe = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(is_response, F.lit("response")).otherwise(F.lit("revisit")), eol,
        F.lit("WARC-Record-ID: "), _record_id(F.col("page")), eol,
        F.lit(f"WARC-Date: {_DATE}\r\n"),
        F.when(safe.isNull(), F.lit("")).otherwise(F.concat(F.lit("WARC-Target-URI: "), safe, eol)),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1"), eol,
        F.when(is_response, F.lit("")).otherwise(
            F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("newest")), F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\n"))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), block.cast("string"), eol, eol,
        http,
    ).cast("binary")


def _record_id(page: Column) -> Column:
    return F.concat(F.lit(f"<{_URN}"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def verified_payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    """Stored payloads whose bytes still have the digest they are filed under; any other one ends the job."""
    payloads = spark.read.parquet(archive.payloads)
    sound = F.sha2("payload", 256) == F.col("address")
    broken = F.raise_error(F.concat(F.lit("payload does not match its address "), F.col("address")))
    return payloads.select(F.when(sound, F.col("address")).otherwise(broken.cast("string")).alias("address"), "payload")


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """What the records say and what their payloads are, one row per record.

    ``page_id``, ``record_type`` and ``refers_to`` are parsed from the header bytes; ``payload_bytes`` and
    ``payload_digest`` are measured again on the stored payload, and must equal what the header declares.
    """
    measured = verified_payloads(spark, archive).select(
        "address", F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    text = F.col("header").cast("string")
    field = lambda name, value: F.regexp_extract(text, f"\\r\\n{name}: {value}", 1)
    page = lambda name: F.expr(f"try_cast({name} as bigint)")
    parsed = spark.read.parquet(archive.headers).select(
        "address", F.regexp_extract(text, "^WARC/1.1\\r\\nWARC-Type: (\\w+)", 1).alias("record_type"),
        field("WARC-Record-ID", f"<{_URN}([^>]*)>").alias("id"), field("WARC-Refers-To", f"<{_URN}([^>]*)>").alias("refers"),
        field("WARC-Payload-Digest", "sha1:(\\w+)").alias("declared"),
    )
    wrong = F.raise_error(F.concat(F.lit("record and payload differ: "), F.col("id")))
    return parsed.join(measured, "address").select(
        page("id").alias("page_id"), "payload_bytes",
        F.when(F.col("declared") == F.col("payload_digest"), F.col("payload_digest")).otherwise(wrong.cast("string")).alias("payload_digest"),
        "record_type", page("refers").alias("refers_to"),
    )


def reconstruct_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """The exact bytes of every record as it stands in a WARC file: ``page_id, record_type, record, payload``.

    A response carries its payload; a revisit's record ends with its HTTP header, its ``payload`` is the full one.
    """
    text = F.col("header").cast("string")
    kind = F.regexp_extract(text, "^WARC/1.1\\r\\nWARC-Type: (\\w+)", 1)
    body = F.when(kind == "response", F.col("payload")).otherwise(F.lit(b""))
    return spark.read.parquet(archive.headers).join(verified_payloads(spark, archive), "address").select(
        F.expr("try_cast(regexp_extract(cast(header as string), '<urn:x-page:([^>]*)>', 1) as bigint)").alias("page_id"),
        kind.alias("record_type"), F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"), "payload",
    )
