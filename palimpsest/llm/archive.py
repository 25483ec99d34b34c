"""Operator 9: a content-addressed WARC archive, written and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.shared import Workspace

#: Fixed value: the profile that the WARC standard names for revisits with an identical payload.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Digits of Spark's base 32 numbers and, in the same order, those of RFC 4648.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


#: So many of a repeated row's copies are made at once.
COPIES = 10_000


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: five hexadecimal digits at a time become four of base 32."""
    digits = F.sha1(payload)
    return F.translate(F.concat(*(F.lpad(F.conv(F.substring(digits, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5))), DIGITS, BASE32)


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """One header line; none for a null value. Line ends in a value are percent-encoded."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def write_archive(ws: Workspace, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  date: str = "2024-01-01T00:00:00Z", min_revisit_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """Write one WARC record per row; returns the written tables (records, payloads).

    payloads holds each different payload once under its SHA-256, records the exact header of every
    record and the key of its payload. Of records with equal payloads of at least min_revisit_bytes the
    one with the largest id (then the largest URL) is the response, the others are revisits of it. A null
    payload is empty; a null id or URL leaves out its header line and sorts lowest; of repeated rows the
    first is the response; an empty table gives an empty archive; other columns aren't read.

    Rows are summed to (id, URL, digest, copies) before anything is joined, and a hot payload is
    one row of the winners' table, so adaptive skew-join splitting can divide its records.
    """
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("id", "url", F.unhex(F.sha2("payload", 256)).alias("key"), base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("n"), "payload")
    held = ws.table(rows.groupBy("id", "url", "key", "sha1", "n").agg(F.count("*").alias("copies")), "digests")
    one = held.groupBy("key").agg(F.max(F.struct("id", "url")).alias("first"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("sha1").alias("a"), F.max("sha1").alias("z"))
    same = (F.col("low") == F.col("high")) & (F.col("a") == F.col("z"))
    one = one.select("key", F.when(same, F.col("first")).otherwise(F.raise_error(F.lit("different payloads share a SHA-256"))).alias("first"))
    each = held.join(one, "key").withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES))))
    each = each.withColumn("copy", F.explode(F.sequence(F.col("part") * COPIES + 1, F.least(F.col("copies"), (F.col("part") + 1) * COPIES))))
    response = (F.col("n") < min_revisit_bytes) | ((F.col("copy") == 1) & F.struct("id", "url").eqNullSafe(F.col("first")))
    name = lambda i, u, c: _uuid(F.coalesce(i.cast("string"), F.lit("-")), F.coalesce(u, F.lit("-")), F.hex("key"), c)
    each = each.withColumn("response", response).select(
        "key",
        F.encode(F.concat(
            F.lit("WARC/1.1\r\n"), _field("WARC-Type", F.when(F.col("response"), "response").otherwise("revisit")),
            _field("WARC-Record-ID", name(F.col("id"), F.col("url"), F.col("copy").cast("string"))), _field("WARC-Date", F.lit(date)), _field("WARC-Target-URI", F.col("url")),
            _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), _field("X-Page-ID", F.col("id")),
            _field("WARC-Profile", F.when(~F.col("response"), REVISIT_PROFILE)),
            _field("WARC-Refers-To", F.when(~F.col("response"), name(F.col("first.id"), F.col("first.url"), F.lit("1")))),
            _field("X-Refers-To-Page-ID", F.when(~F.col("response"), F.col("first.id"))),
            _field("Content-Type", F.lit("text/html")), _field("Content-Length", F.when(F.col("response"), F.col("n")).otherwise(F.lit(0))), F.lit("\r\n")), "UTF-8").alias("header"))
    records = ws.table(each, "records")
    payloads = ws.table(rows.select("key", "payload").dropDuplicates(["key"]), "payloads")
    return records, payloads


def _value(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def read_archive(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """Every record as it was: header fields, record (the exact bytes) and payload (a revisit's is its response's).

    Stored payloads are checked against their key; a header that disagrees with its payload's SHA-1
    or that has no payload raises an error. Null URLs and ids are null again, null and empty payloads are both
    empty, repeated records stay, an empty archive gives no rows.
    """
    sound = F.unhex(F.sha2("payload", 256)) == F.col("key")
    stored = payloads.select("key", F.when(sound, F.octet_length("payload").cast("long")).otherwise(F.raise_error(F.lit("a stored payload is damaged"))).alias("payload_bytes"),
                             base32_sha1(F.col("payload")).alias("payload_digest"), "payload")
    text = F.decode("header", "UTF-8")
    whole = records.join(stored, "key", "left").withColumn("text", text)
    agrees = _value(F.col("text"), "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))
    body = F.when(_value(F.col("text"), "WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return whole.select(
        _value(F.col("text"), "X-Page-ID").cast("long").alias("page_id"), _value(F.col("text"), "WARC-Target-URI").alias("url"), "payload_bytes",
        F.when(agrees, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a record disagrees with its payload"))).alias("payload_digest"),
        _value(F.col("text"), "WARC-Type").alias("record_type"), _value(F.col("text"), "X-Refers-To-Page-ID").cast("long").alias("refers_to"),
        F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"), "payload")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark)
    records, payloads = write_archive(ws, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return read_archive(records, payloads).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.octet_length("record").cast("long").alias("record_bytes"), F.md5("record").alias("record_md5"))


_GROUPS = " || ".join(f"substr('{BASE32}', ((('0x' || substr(h, {at}, 5))::INTEGER >> {shift}) & 31) + 1, 1)" for at in range(1, 41, 5) for shift in (15, 10, 5, 0))
_ID = "regexp_replace(md5(concat_ws('|', CAST({i} AS VARCHAR), coalesce({u}, '-'), upper(sha256(body)), '1')), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '<urn:uuid:\\1-\\2-\\3-\\4-\\5>')"
OP9_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
w AS (SELECT body AS b, max(page_id) AS first, arg_max(url, page_id) AS first_url FROM p GROUP BY body),
r AS (SELECT *, strlen(body) AS n, {_GROUPS} AS digest, page_id = first AS own, chr(13) || chr(10) AS eol FROM p JOIN w ON body = b),
records AS (SELECT *, 'WARC/1.1' || eol || 'WARC-Type: ' || CASE WHEN own THEN 'response' ELSE 'revisit' END || eol || 'WARC-Record-ID: ' || {_ID.format(i='page_id', u='url')} || eol
    || 'WARC-Date: 2024-01-01T00:00:00Z' || eol || coalesce('WARC-Target-URI: ' || replace(replace(url, chr(13), '%0D'), chr(10), '%0A') || eol, '') || 'WARC-Payload-Digest: sha1:' || digest || eol
    || 'X-Page-ID: ' || page_id || eol || CASE WHEN own THEN '' ELSE 'WARC-Profile: {REVISIT_PROFILE}' || eol || 'WARC-Refers-To: ' || {_ID.format(i='first', u='first_url')} || eol
    || 'X-Refers-To-Page-ID: ' || first || eol END || 'Content-Type: text/html' || eol || 'Content-Length: ' || CASE WHEN own THEN n ELSE 0 END || eol || eol
    || CASE WHEN own THEN body ELSE '' END || eol || eol AS record FROM r)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN own THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN NOT own THEN first END AS refers_to, CAST(strlen(record) AS BIGINT) AS record_bytes, md5(record) AS record_md5
FROM records
"""
