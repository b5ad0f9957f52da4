"""Content-addressed web archive: payload bytes once per digest, exact record heads apart.

`write` makes two tables under one path:
  heads     record_no, digest, head: the exact WARC and HTTP header bytes of one record
  payloads  digest, payload: every distinct payload once; digest is SHA-256 of the bytes
`records` joins them and gives back each original record, byte for byte. The digest of every payload
is computed again on reading and a difference raises an error.

Equal payloads of at least `min_revisit_bytes` are one response (the row with the largest page_id;
among repeated rows of that id, one of them) and revisits that refer to it. Smaller ones are all
responses; their bytes are still stored once.

Nulls: a null payload is empty, a null url has no WARC-Target-URI, a null page_id sorts below all
others and has no id in its head. Line ends inside a url are percent-encoded, so that a head can't be
split. An empty table gives two empty tables. Other columns of the input are not stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import staged

MIN_REVISIT_BYTES = 1000
DATE = "2026-01-01T00:00:00Z"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the WARC standard


def _lines(*parts: Column | str) -> Column:
    """Header lines with their ends; a null line is left out."""
    return F.concat(F.concat_ws(CRLF, *[F.lit(p) if isinstance(p, str) else p for p in parts]), F.lit(CRLF + CRLF))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"))


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))


def write(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str = DATE,
) -> None:
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    slim = staged(rows.select(
        F.monotonically_increasing_id().alias("record_no"), "page_id", "url", "digest",
        F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("bigint").alias("bytes")), "warc-rows")
    # record_no is kept in a written table, so it stays the same however often it is read.
    holders = slim.where(F.col("bytes") >= min_revisit_bytes).groupBy("digest").agg(
        F.max(F.struct("page_id", "record_no")).alias("holder"))
    heads = slim.join(holders, "digest", "left")
    revisit = F.col("holder").isNotNull() & (F.col("holder.record_no") != F.col("record_no"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", _line("Content-Length", F.col("bytes")))
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    warc = _lines(
        "WARC/1.1", _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))), _line("WARC-Target-URI", uri), F.lit(f"WARC-Date: {date}"),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, _line("WARC-Refers-To", _record_id(F.col("holder.page_id")))), F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        "Content-Type: application/http; msgtype=response", _line("Content-Length", block))
    heads.select("record_no", "digest", F.concat(warc, http).cast("binary").alias("head")).write.parquet(f"{path}/heads")
    rows.select("digest", "payload").dropDuplicates(["digest"]).write.parquet(f"{path}/payloads")


def _field(name: str) -> Column:
    """A header field of the WARC head; null where the head has none."""
    return F.nullif(F.regexp_extract("__head", rf"\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def _page(name: str) -> Column:
    return F.nullif(F.regexp_extract("__head", rf"\n{name}: <urn:page:(-?\d+)>\r\n", 1), F.lit("")).cast("bigint")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every record: what its head says, its payload, and `record`, the bytes of the original record."""
    stored = spark.read.parquet(f"{path}/payloads")
    same = F.sha2("payload", 256) == F.col("digest")
    stored = stored.select(
        "digest", F.when(same, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("digest"))).cast("binary")).alias("payload"))
    stored = stored.select("digest", "payload", F.sha1("payload").alias("payload_digest"), F.octet_length("payload").cast("bigint").alias("payload_bytes"))
    heads = spark.read.parquet(f"{path}/heads").withColumn("__head", F.col("head").cast("string"))
    heads = heads.select(
        "record_no", "digest", "head", _page("WARC-Record-ID").alias("page_id"), _field("WARC-Target-URI").alias("url"),
        _field("WARC-Type").alias("record_type"), _page("WARC-Refers-To").alias("refers_to"), _field("WARC-Payload-Digest").alias("stated_digest"))
    full = heads.join(stored, "digest")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    stated = F.concat(F.lit("sha1:"), F.col("payload_digest")) == F.col("stated_digest")
    return full.withColumn("record", F.concat(F.col("head"), body, F.lit(CRLF + CRLF).cast("binary"))).withColumn(
        "payload_digest", F.when(stated, F.col("payload_digest")).otherwise(F.raise_error(F.lit("head and payload disagree")).cast("string"))).drop("stated_digest")
