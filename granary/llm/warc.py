"""A content-addressed WARC archive: payload bytes stored once, record headers kept apart, records joined again.

``write_archive`` makes two tables in a folder that Spark writes: ``payloads`` (content_key, payload), one row per
distinct payload under its SHA-256, and ``records``, one row per record with its exact WARC and HTTP header text.
``reconstruct`` joins headers and payloads into the bytes of each original record.  ``read_archive`` answers from these:
it checks every stored payload against its key, reads the record's header lines, checks block length, payload digest and
payload length against them, and follows WARC-Refers-To to the record with that id.

Of the records with equal payloads that with the least page_id is the response and the others revisit it.  Payloads
are compared by SHA-256, SHA-1 and length together; page bytes are shuffled once, by page_id, so a payload shared by
any share of all pages never meets in one task.

Defined results: a null html is an empty payload; payloads under ``least`` bytes are all responses; rows that repeat
a page_id and payload are one record shown once per row; a null page_id is a response only when nothing else has its
payload; a null url leaves the target URI empty, line breaks and other control characters in one are percent-encoded;
extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.scratch import new_path

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(hex40: Column) -> Column:
    """Base32 of a digest of 160 bits given as 40 hex digits: four groups of 40 bits, eight letters each."""
    letters = []
    for g in range(4):
        bits = F.conv(F.substring(hex40, 10 * g + 1, 10), 16, 10).cast("long")
        letters += [F.substr(F.lit(BASE32), (F.shiftright(bits, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for k in range(8)]
    return F.concat(*letters)


def _record_id(page_id: Column, key: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), key))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _one_line(text: Column) -> Column:
    """Control characters percent-encoded, so that a value can't end its header line."""
    for code in (*range(32), 127):
        text = F.replace(text, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.when(F.regexp_like(F.col("url"), F.lit(r"[\x00-\x1F\x7F]")), text).otherwise(F.coalesce("url", F.lit("")))


def write_archive(pages: DataFrame, path: str, *, least: int = 0, date: str = "1970-01-01T00:00:00Z") -> str:
    """Write the archive of (page_id, url, html) to ``path`` and return it."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(html, "UTF-8").alias("payload"))
    rows = rows.withColumn("content_key", F.sha2("payload", 256))
    facts = rows.select("page_id", "url", "content_key", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    first = facts.groupBy("content_key", "sha1", "payload_bytes").agg(F.min("page_id").alias("first"))
    told = facts.join(first, ["content_key", "sha1", "payload_bytes"])
    response = F.col("page_id").eqNullSafe(F.col("first")) | (F.col("payload_bytes") < least)
    told = told.withColumn("record_type", F.when(response, "response").otherwise("revisit"))
    told = told.withColumn("payload_digest", base32_of_hex(F.col("sha1")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    told = told.withColumn("http_header", http)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    body = F.length("http_header") + F.when(response, F.col("payload_bytes")).otherwise(F.lit(0))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("content_key"))),
        line("WARC-Target-URI", _one_line(F.coalesce("url", F.lit("")))), line("WARC-Date", F.lit(date)), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(response, F.lit("")).otherwise(F.concat(line("WARC-Profile", F.lit(REVISIT)), line("WARC-Refers-To", _record_id(F.col("first"), F.col("content_key"))))),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", body.cast("string")), F.lit("\r\n"),
    )
    records = told.select("page_id", "content_key", header.alias("header"), "http_header")
    records.write.parquet(f"{path}/records")
    spark = pages.sparkSession
    owners = spark.read.parquet(f"{path}/records").filter(_field("header", "WARC-Type") == "response")
    # Where small payloads are all responses, the least page_id stores the bytes.  The keys are never null, so the
    # join and the removal of repeated rows share one exchange of the payloads.
    no_id = F.lit(-(1 << 63))
    owners = owners.groupBy("content_key").agg(F.coalesce(F.min("page_id"), no_id).alias("owner"))
    stored = rows.select("content_key", F.coalesce("page_id", no_id).alias("owner"), "payload").join(owners, ["content_key", "owner"], "left_semi")
    stored = stored.dropDuplicates(["content_key", "owner"])
    stored.select("content_key", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")
    return path


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored payloads, each verified against its key."""
    rows = spark.read.parquet(f"{path}/payloads")
    return rows.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("content_key"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload differs from its digest")).cast("binary")))


def _field(header: str, name: str) -> Column:
    return F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """Records with their payloads: page_id, content_key, header, http_header, payload, and what their key tells of the response."""
    records = spark.read.parquet(f"{path}/records").select("page_id", "content_key", "header", "http_header")
    responses = records.filter(_field("header", "WARC-Type") == "response").select("content_key", F.struct(F.col("page_id").alias("page"), _field("header", "WARC-Record-ID").alias("id")).alias("r"))
    of_key = responses.groupBy("content_key").agg(F.min("r").alias("response"))
    return records.join(_payloads(spark, path).join(of_key, "content_key"), "content_key")


def _block(whole: DataFrame) -> Column:
    """The bytes behind a record's header: HTTP header, and in a response the payload."""
    body = F.when(_field("header", "WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return F.concat(F.encode("http_header", "UTF-8"), body)


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, record, payload): the bytes of every WARC record, and the full payload also of revisits."""
    rows = _whole(spark, path)
    return rows.select("page_id", _field("header", "WARC-Type").alias("record_type"), F.concat(F.encode("header", "UTF-8"), _block(rows), F.lit(b"\r\n\r\n")).alias("record"), "payload")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Per record: page_id, payload_bytes and payload_digest, record_type, refers_to, as the records themselves say."""
    rows = _whole(spark, path)
    rows = rows.select(
        "page_id", "response", _field("header", "WARC-Type").alias("record_type"), _field("header", "WARC-Payload-Digest").alias("told"), _field("header", "WARC-Refers-To").alias("refers"),
        _field("header", "Content-Length").cast("long").alias("length"), F.regexp_extract("http_header", r"\r\nContent-Length: ([0-9]+)\r\n", 1).cast("long").alias("payload_length"),
        F.octet_length(_block(rows)).cast("long").alias("block_length"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_of_hex(F.sha1("payload")).alias("digest"),
    )
    revisit = F.col("record_type") == "revisit"
    same = (F.col("told") == F.concat(F.lit("sha1:"), F.col("digest"))) & (F.col("length") == F.col("block_length")) & (F.col("payload_length") == F.col("payload_bytes"))
    same = same & (~revisit | (F.col("refers") == F.col("response.id")))
    digest = F.when(same, F.col("digest")).otherwise(F.raise_error(F.lit("a record differs from its payload or refers to no response")).cast("string"))
    return rows.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", F.when(revisit, F.col("response.page")).alias("refers_to"))


def archive_round_trip(pages: DataFrame, *, least: int = 0) -> DataFrame:
    """Write the archive to a new folder in the shared place and read its records back."""
    spark = pages.sparkSession
    return read_archive(spark, write_archive(pages, new_path(spark, "warc"), least=least))
