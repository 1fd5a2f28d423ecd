"""Intermediate tables in the folder that driver and executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where it is unset on one machine (tests) a temporary folder."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-granary-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back with the same schema."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._granary_path = path  # type: ignore[attr-defined]
    return out


def save_buckets(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """``save`` as a bucketed table, a file per bucket: joins on the column move the other side only.

    ``df`` should be dealt by ``repartition(buckets, column)``.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    table = "granary_" + path.rsplit("-", 1)[1]
    df.write.bucketBy(buckets, column).option("path", path).saveAsTable(table, format="parquet")
    out = spark.table(table)
    out._granary_path, out._granary_table = path, table  # type: ignore[attr-defined]
    return out


def compact(parts: list[DataFrame], name: str, most: int = 16) -> list[DataFrame]:
    """Tables of one schema as one, once there are ``most`` of them, so that plans over many rounds stay short."""
    if len(parts) < most:
        return parts
    out = [save(union(parts), name)]
    for p in parts:
        drop(p)
    return out


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drop(df: DataFrame | None) -> None:
    """Delete a table made by ``save`` or ``save_buckets`` that no later step reads."""
    path = getattr(df, "_granary_path", None)
    if df is not None and path:
        if table := getattr(df, "_granary_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
