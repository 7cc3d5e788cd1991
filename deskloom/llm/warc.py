"""Content-addressed WARC archive as two Parquet tables.

``payloads`` holds each distinct payload once under its SHA-256; ``records`` holds the exact
header bytes of every record (WARC header block and HTTP header block, up to the payload) and
the payload's SHA-256. A record is rebuilt by joining the two; payloads are verified against
their digest when they are read.

Of records with equal payloads of at least ``least`` bytes the one with the largest page id is
the response and the others are revisits that refer to it; smaller payloads are always
responses. Null html is an empty payload, a null url an empty target. Rows that tie for the
largest id are all responses; without any id in a group, all its rows are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskloom.session import scratch_path

#: Smallest payload that is worth a revisit record.
LEAST = 1000
CRLF = "\r\n"


@dataclass(frozen=True)
class Archive:
    records: str
    payloads: str


def _record_name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _header(kind: Column, page_id: Column, refers_to: Column, url: Column, sha1: Column, size: Column, date: str) -> Column:
    """WARC and HTTP header blocks of a record, up to the first byte of its payload."""
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        size.cast("string"),
        F.lit(CRLF * 2),
    )
    block = F.length(http) + F.when(kind == "response", size).otherwise(0)
    refers = F.when(
        kind == "revisit",
        F.concat(
            F.lit("WARC-Refers-To: "),
            _record_name(refers_to),
            F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}"),
        ),
    ).otherwise("")
    target = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", "")
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "),
        kind,
        F.lit(f"{CRLF}WARC-Record-ID: "),
        _record_name(page_id),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "),
        target,
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"),
        sha1,
        F.lit(CRLF),
        refers,
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        block.cast("string"),
        F.lit(CRLF * 2),
        http,
    ).cast("binary")


def write_archive(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    least: int = LEAST,
    date: str = "1970-01-01T00:00:00Z",
) -> Archive:
    """Write one record per row of ``pages``."""
    archive = Archive(f"{folder}/records", f"{folder}/payloads")
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    # Copies meet once per map task already: an aggregate with a partial step.
    distinct = rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.max("page_id").alias("holder"))
    distinct.write.option("compression", "zstd").parquet(archive.payloads)
    holders = pages.sparkSession.read.parquet(archive.payloads).select("digest", "holder")
    size = F.octet_length("payload")
    slim = rows.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), size.cast("long").alias("size"))
    kind = F.when(
        (F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("holder")) & F.col("holder").isNotNull(), "revisit"
    ).otherwise("response")
    records = slim.join(holders, "digest").withColumn("kind", kind)
    header = _header(F.col("kind"), F.col("page_id"), F.col("holder"), F.col("url"), F.col("sha1"), F.col("size"), date)
    records.select(header.alias("header"), "digest").write.option("compression", "zstd").parquet(archive.records)
    return archive


def _field(name: str) -> Column:
    return F.regexp_extract(F.col("header").cast("string"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def _page(name: str) -> Column:
    text = F.regexp_extract(_field(name), r"^<urn:page:(.*)>$", 1)
    return F.when(text != "", text).cast("long")


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """(page_id, record_type, refers_to, target, header, payload) of every record; payload is
    the full one, also of revisits. A payload that doesn't fit its digest is an error."""
    stored = spark.read.parquet(archive.payloads).select("digest", "payload")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload doesn't fit its digest "), F.col("digest")))
    )
    joined = spark.read.parquet(archive.records).join(stored.select("digest", sound.alias("payload")), "digest")
    return joined.select(
        _page("WARC-Record-ID").alias("page_id"),
        _field("WARC-Type").alias("record_type"),
        _page("WARC-Refers-To").alias("refers_to"),
        _field("WARC-Target-URI").alias("target"),
        _field("WARC-Payload-Digest").alias("stated"),
        "header",
        "payload",
    )


def record_bytes(read: DataFrame) -> Column:
    """The original record: header, the payload unless it is a revisit, and the end mark."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return F.concat(F.col("header"), body, F.lit((CRLF * 2).encode()))


def archived(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` below the shared folder and read the archive back."""
    spark = pages.sparkSession
    return read_archive(spark, write_archive(pages, scratch_path(spark, "warc"), **options))
