import base64
import hashlib

import pytest

from granary.functions.scratch import new_path
from granary.llm.warc import archive_round_trip, read_archive, reconstruct, write_archive

SCHEMA = "page_id long, url string, html string"
ROWS = [(4, "http://a/", "<p>é</p>"), (2, "http://b/", "<p>é</p>"), (9, None, "<p>é</p>"), (3, "http://c/", ""), (5, "http://d/", None), (7, "x", "only"), (7, "x", "only"), (None, "n", "solo"), (None, "n", "only")]


def brute(rows):
    first = {}
    for i, _, h in rows:
        k = h or ""
        if i is not None and (k not in first or first[k] is None or i < first[k]):
            first[k] = i
        first.setdefault(k, None)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        f = first[h or ""]
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == f else "revisit", None if i == f else f))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    got = archive_round_trip(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(ROWS)
    assert archive_round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_records_are_whole_and_payloads_stored_once(spark):
    path = write_archive(spark.createDataFrame(ROWS, SCHEMA), new_path(spark, "warc-test"))
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    for r in reconstruct(spark, path).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        assert len(rest) - 4 == int(fields[b"Content-Length"]) and rest.endswith(b"\r\n\r\n")
        if r.record_type == "response":
            body = rest[:-4].partition(b"\r\n\r\n")[2]
            assert body == bytes(r.payload)
            assert base64.b32encode(hashlib.sha1(body).digest()) == fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:")


def test_a_damaged_payload_is_found(spark):
    from pyspark.sql import functions as F

    path = write_archive(spark.createDataFrame(ROWS, SCHEMA), new_path(spark, "warc-test"))
    bad = new_path(spark, "warc-bad")
    spark.read.parquet(f"{path}/records").write.parquet(f"{bad}/records")
    spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit(b"x"))).write.parquet(f"{bad}/payloads")
    with pytest.raises(Exception, match="differs from its digest"):
        read_archive(spark, bad).collect()


@pytest.mark.parametrize("old,new", [("WARC-Type: revisit", "WARC-Type: response"), ("Content-Length: ", "Content-Length: 1"), ("sha1:", "sha1:A"), ("Refers-To: <", "Refers-To: <x")])
def test_a_damaged_header_is_found(spark, old, new):
    from pyspark.sql import functions as F

    path = write_archive(spark.createDataFrame(ROWS, SCHEMA), new_path(spark, "warc-test"))
    bad = new_path(spark, "warc-bad")
    spark.read.parquet(f"{path}/records").withColumn("header", F.replace("header", F.lit(old), F.lit(new))).write.parquet(f"{bad}/records")
    spark.read.parquet(f"{path}/payloads").write.parquet(f"{bad}/payloads")
    with pytest.raises(Exception, match="a record differs"):
        read_archive(spark, bad).collect()


def test_hard_urls_long_pages_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    rows = [(1, "http://a/\r\nWARC-Type: revisit\r\n\r\n", "a"), (2, "http://é/%", "b" * 3_000_000), (3, "", "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("payload", "content_key", "header", "first", "sha1", "owner", "record_type", "response"):
        df = df.withColumn(c, F.lit(1))
    assert sorted((tuple(r) for r in archive_round_trip(df).collect()), key=str) == brute(rows)
