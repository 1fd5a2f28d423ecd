"""A corpus pipeline of five stages over ``documents``; each stage works on all that its predecessor kept.

Defined results: extra columns go at the first stage; documents with a null or empty text go there too, for want of words;
a null doc_id is kept as a document of its own by every stage; equal rows of a doc_id are one document from the near-dedup
on; a document that line dedup leaves empty stays (it is like no other and takes a place in a bin); empty tables pass
through, and an empty benchmark or no labels remove nothing of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.scratch import save
from granary.llm.decontaminate import remove_leaks
from granary.llm.line_dedup import dedup_lines
from granary.llm.near_dedup import near_duplicates
from granary.llm.packing import pack
from granary.llm.quality import quality_rules

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs.select(*COLUMNS), labels).filter("kept").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that other documents keep; n_chars follows the text."""
    left = dedup_lines(docs.select(*COLUMNS)).select(*COLUMNS)
    return left.withColumn("n_chars", F.length("text").cast("long"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingles 0.8 alike; equal rows of a doc_id are one document."""
    found = near_duplicates(docs.select("doc_id", "text"), width=5, per_cent=80)
    keep = found.filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.select(*COLUMNS).join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.select(*COLUMNS).filter("doc_id IS NULL"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return remove_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its bin."""
    return pack(docs.select(*COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]

#: The log-likelihood score, near duplicates and packing aren't SQL; tests compare each stage's operator with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
