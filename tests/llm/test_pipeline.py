"""The pipeline's stages: each takes effect, keeps the columns, and equals its operator run apart."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm.decontaminate import find_leaks

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = [r.text for r in corpus_pipeline.keep_quality(spark, docs, SF).orderBy("doc_id").limit(4).collect()]
    copies = spark.createDataFrame([(90_000 + k, good[0] + " " + good[1], "en", "x", 1) for k in range(3)], docs.schema)
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first()
    dirty = spark.createDataFrame([(91_000, good[2] + " " + leak.text + " " + good[3], "en", "y", 1), (91_001, "too short", "en", "z", 1), (91_002, None, None, None, None)], docs.schema)
    now = docs.unionByName(copies).unionByName(dirty)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF).cache()
        seen.append({r.doc_id for r in now.select("doc_id").collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == corpus_pipeline.COLUMNS
    quality, lines, near, clean, packed = seen
    assert 91_001 not in quality and 91_002 not in quality and 90_002 in quality
    assert lines == quality
    assert {90_000} == near & {90_000, 90_001, 90_002} or len(near & {90_000, 90_001, 90_002}) == 1
    assert 91_000 in near and 91_000 not in clean
    assert packed == clean
    assert {"doc_id", "bin_id", "n_words"} <= set(now.columns)


def test_run_reads_the_folder(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        corpus_pipeline.run(spark, "/nowhere")
    assert find_leaks(spark.read.parquet(f"{SF}/documents.parquet").join(out.select("doc_id").distinct(), "doc_id", "left_semi"), spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0


def folder(spark, path, docs, benchmark=(), labels=()):
    """A folder with the tables that the pipeline reads."""
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_run_of_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, spark.createDataFrame([], SCHEMA))).collect() == []


def test_run_of_hard_rows(spark, tmp_path):
    """Null ids and cells, very long and repeated texts, a leak, and columns with the names that stages use."""
    rng = random.Random(4)
    words = [f"word{k}" for k in range(3000)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    item, long = prose(40), "\n".join(prose(30) for _ in range(3000))
    fine = [(k, prose(60), "en", f"s{k % 3}", 1) for k in range(30)]
    rows = [*fine, (100, fine[0][1], None, None, None), (5, fine[5][1], "en", "s2", 1), (101, long, "en", "s1", 1), (None, prose(50), "en", "s1", 1), (102, None, None, None, None), (103, "", "en", "s", 0), (104, prose(30) + " " + item + " " + prose(30), "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("score", "kept", "n_words", "component_id", "bin_id", "a.b", "keeper"):
        docs = docs.withColumn(c, F.lit("x"))
    got = corpus_pipeline.run(spark, folder(spark, tmp_path, docs, [(1, item), (2, None), (3, "")])).collect()  # without labels no score rejects
    kept = {r.doc_id for r in got}
    assert {r[0] for r in fine} <= kept | {0} and len(kept & {0, 100}) == 1  # of two equal documents one
    assert not kept & {102, 103, 104} and 101 in kept and None in kept
    size = lambda i: sum(r.n_words for r in got if r.doc_id == i)
    assert size(101) == 90_000 and size(5) == 60 and size(None) == 50
