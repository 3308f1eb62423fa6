"""Operator 8, a content-addressed WARC archive.

The archive is two tables in the shared folder. `payloads` has the bytes of each distinct payload once, under
their SHA-256; `records` has the exact header of each record and the key of its payload. Of the records with
equal payloads the one with the smallest page id is the response, the others revisit it. Reading joins the two:
a response's record is its header and its payload, and a payload counts only if its SHA-256 is the key it is
stored under and its SHA-1 and length are what the header says.

Only keys and lengths are shuffled to find equal payloads, with partial minima before the shuffle, so a payload
that a third of all pages share is no hot spot; its bytes are stored and joined once.

Null html is an empty payload. Rows that repeat the smallest page id of a payload are responses as well and share
the stored bytes; a null page id never is the smallest unless all are null, and its record has no id. An empty table
gives an empty archive. Control characters of a url are written as spaces. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import released, written

# Digits of Spark's base 32 and those of RFC 4648, and the parts of a WARC header.
BASE_32, RFC_4648 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Archive:
    records: DataFrame
    payloads: DataFrame


def base32_sha1(data: Column) -> Column:
    """SHA-1 in upper-case base 32: four times ten hex digits are eight base 32 digits."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(data), 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), BASE_32, RFC_4648)


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.col("head"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def archived(pages: DataFrame, least: int = 0, date: str = DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> Archive:
    """Writes a record for each page; payloads of `least` bytes or more are stored once and revisited."""
    rows = pages.select(F.col(id_col).cast("string").alias("page"), F.col(id_col).alias("order"), F.regexp_replace(F.col(url_col).cast("string"), "[\\x00-\\x1f]", " ").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    narrow = rows.select("page", "order", "url", "key", "size", base32_sha1(F.col("payload")).alias("digest"))
    narrow = written(narrow, "digests")
    firsts = written(narrow.groupBy("key", "size").agg(F.min("order").alias("first"), F.count("*").alias("n")), "firsts")
    # Records carry no payload to the rows of their key, so a payload that many pages share is many small rows.
    copies = firsts.where((F.col("n") > 1) & (F.col("size") >= least)).select("key", "first")
    chosen = narrow.join(copies, "key", "left").withColumn("revisits", F.coalesce(F.col("order").isNull() & F.col("first").isNotNull() | (F.col("order") != F.col("first")), F.lit(False)))
    # Payloads go to the place of their page and key, not of their key alone; only the first page's is there to be met.
    at = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    places = firsts.select("key", at("first").alias("at"))
    stored = rows.select("key", at("order").alias("at"), "payload", "size").join(places, ["key", "at"])
    payloads = written(stored.dropDuplicates(["key", "at"]).select("key", "payload", "size"), "payloads")

    kind = F.when(F.col("revisits"), "revisit").otherwise("response")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce("page", F.lit("")), F.lit(">"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Profile", F.when(F.col("revisits"), F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(F.col("revisits") & F.col("first").isNotNull(), F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(F.col("revisits"), F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit("\r\n"),
    )
    records = written(chosen.select(head.cast("binary").alias("header"), "key"), "records")
    released(narrow, firsts)
    return Archive(records, payloads)


def read_back(archive: Archive, id_type: str = "long") -> DataFrame:
    """(page_id, record_type, refers_to, payload_digest, payload_bytes, record: the original bytes; verified) for each record."""
    heads = archive.records.withColumn("head", F.col("header").cast("string"))
    number = lambda name: F.regexp_extract(_field(name), "<urn:page:(.*)>", 1)
    heads = heads.select("header", "key", F.nullif(number("WARC-Record-ID"), F.lit("")).cast(id_type).alias("page_id"), _field("WARC-Type").alias("record_type"), F.nullif(number("WARC-Refers-To"), F.lit("")).cast(id_type).alias("refers_to"), F.regexp_extract(_field("WARC-Payload-Digest"), "sha1:(.*)", 1).alias("payload_digest"), _field("Content-Length").cast("long").alias("length"))
    heads = heads.withColumn("revisits", F.col("record_type") == "revisit")
    end = F.lit("\r\n\r\n").cast("binary")
    full = heads.where(~F.col("revisits")).join(archive.payloads, "key", "left")
    good = (F.sha2("payload", 256) == F.col("key")) & (base32_sha1(F.col("payload")) == F.col("payload_digest")) & (F.octet_length("payload") == F.col("length"))
    names = ["page_id", "record_type", "refers_to", "payload_digest", F.col("size").alias("payload_bytes")]
    responses = full.select(*names, F.concat("header", "payload", end).alias("record"), F.coalesce(good, F.lit(False)).alias("verified"))
    again = heads.where("revisits").join(archive.payloads.select("key", "size"), "key", "left")
    revisits = again.select(*names, F.concat("header", end).alias("record"), F.col("size").isNotNull().alias("verified"))
    return responses.unionByName(revisits)
