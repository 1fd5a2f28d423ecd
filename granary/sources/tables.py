"""Scans and sinks: samples, keyed reads, CSV, profile store, resumable loads."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.scratch import delete, drop, save
from granary.operators.profile import content_mark


def capped_scan(df: DataFrame, key: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The first n rows by key, and the exact count of all."""
    return df.orderBy(key).limit(n), df.agg(F.count(F.lit(1)).alias("n_rows"))


def threshold_sample(df: DataFrame, key: str, threshold: int, sample: int, cap: int) -> DataFrame:
    """All rows, or min(sample, cap, rows) of them by hash of the key when there are over ``threshold``."""
    n = df.count()
    return df if n <= threshold else df.orderBy(F.md5(F.col(key).cast("string")), key).limit(max(1, min(sample, cap, n)))


def keyed_fetch(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key is in a key set; Spark broadcasts the set while it is under its threshold."""
    return df.join(keys.select(F.col(keys.columns[0]).alias(key)), key, "left_semi")


def predicate_fetch(df: DataFrame, predicate: Column) -> DataFrame:
    return df.filter(predicate)


def csv_sink(df: DataFrame, path: str, columns: list[str]) -> None:
    """One CSV in canonical column order; NULL is bare, empty text is quoted; CRLF ends a line."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", '""').option("lineSep", "\r\n").csv(path)


def export_manifest(tables: dict[str, DataFrame], declared: set[str]) -> DataFrame:
    """(table, columns, n_rows, provenance) per exported table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), F.lit(",".join(df.columns)).alias("columns"), "n_rows", F.lit("declared" if name in declared else "referenced").alias("provenance"))
        out = row if out is None else out.unionByName(row)
    return out


#: Header aliases of user lists.
INVENTORY = {"id": ["id", "userid"], "username": ["username", "user_name"], "email": ["email", "e_mail", "emailaddress"], "name": ["name"], "external_id": ["external_id"], "is_active": ["is_active"], "creation_date": ["creation_date"], "last_login": ["last_login"]}


def read_user_inventory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Users with normalised columns, trimmed; second: rows without an id."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    by = {c.strip().lower(): c for c in raw.columns}
    cols = []
    for name, aliases in INVENTORY.items():
        found = [F.trim(F.col(f"`{by[a]}`")) for a in aliases if a in by]
        cols.append((F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name))
    rows = raw.select(*cols)
    ok = F.coalesce(F.col("id"), F.lit("")) != ""
    return rows.filter(ok), rows.filter(~ok)


def read_user_map(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).schema("SourceUserId string, TargetUserId string, Rationale string").csv(path)
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return raw.select(blank(F.col("SourceUserId")).alias("source_key"), blank(F.col("TargetUserId")).alias("target_key"), F.col("Rationale").alias("rationale"))


def save_profile(profile: DataFrame, path: str, env: str) -> None:
    """Store a profile under its environment; others stay."""
    profile.withColumn("env", F.lit(env)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("env").parquet(path)


def load_profile(spark: SparkSession, path: str, env: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if env is None else df.filter(F.col("env") == env)


def distribution_export(dist: DataFrame, path: str) -> None:
    dist.write.mode("overwrite").json(path)


def wipe_and_load(df: DataFrame, path: str) -> int:
    """Full refresh; returns the captured changes it costs, two per existing row."""
    spark = df.sparkSession
    try:
        old = spark.read.parquet(path).count()
    except Exception as e:  # an absent table only
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = 0
    df.write.mode("overwrite").parquet(path)
    return 2 * old


def resumable_load(df: DataFrame, path: str, key: str, chunk: int, table: str, jobs: int = 16) -> DataFrame:
    """Load in key ranges of ``chunk``; finished chunks of the journal are skipped, a changed source is refused.

    Returns the journal (table, chunk, first_key, last_key, n_rows).  Chunks are folders.  At most ``jobs`` jobs write them, each
    all unfinished chunks of its share of the key range; they replace the folders they write, and a job's journal
    entries, one per chunk, come after it.  So a crash repeats one job's chunks at most, and what is finished is found by an
    anti-join with the journal, never by a list on the driver.  Rows with a NULL key are the chunk NULL.
    """
    spark = df.sparkSession
    facts = df.agg(F.count(F.lit(1)), F.min(key), F.max(key), content_mark(df)).first()
    mark = json.dumps([str(x) for x in facts] + [chunk])
    journal, folder = f"{path}/_journal/{table}", f"{path}/{table}"
    schema = "table string, chunk long, first_key long, last_key long, n_rows long, mark string"
    try:
        done = spark.read.schema(schema).parquet(journal)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = spark.createDataFrame([], schema)
    if done.filter(F.col("mark") != mark).limit(1).count():
        raise ValueError("the source changed since the load began")
    low, high = facts[1] or 0, facts[2] or 0
    parts = df.withColumn("chunk", F.floor((F.col(key) - F.lit(low)) / chunk).cast("long"))
    finished = done.select(F.col("chunk").alias("_done"))
    share = max(1, -(-int((high - low) // chunk + 1) // jobs))
    ranges = [F.col(key).between(low + a * chunk, low + (a + share) * chunk - 1) for a in range(0, int((high - low) // chunk) + 1, share)] if facts[1] is not None else []
    for rows in [*ranges, F.col(key).isNull()]:  # conditions on the key itself, so that the scan skips row groups
        left = parts.filter(rows).join(finished, F.col("chunk").eqNullSafe(F.col("_done")), "left_anti")
        entries = left.groupBy("chunk").agg(F.min(key).cast("long").alias("first_key"), F.max(key).cast("long").alias("last_key"), F.count(F.lit(1)).alias("n_rows"))
        entries = save(entries.select(F.lit(table).alias("table"), "chunk", "first_key", "last_key", "n_rows", F.lit(mark).alias("mark")), "entries")
        if entries.limit(1).count():
            left.write.partitionBy("chunk").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)
            entries.write.mode("append").parquet(journal)
        drop(entries)
    return spark.read.schema(schema).parquet(journal)


def reset_load(spark: SparkSession, path: str, table: str) -> None:
    delete(spark, f"{path}/_journal/{table}")
    delete(spark, f"{path}/{table}")
