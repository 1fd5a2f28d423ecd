import re

import pytest
from pyspark.sql import functions as F

from granary.llm.near_dedup import _needed, _wanted, near_duplicates

SCHEMA = "doc_id long, text string"


def brute(rows, width=3, per_cent=85):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets, best = [], {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append((i, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
        best[i] = i
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[x + 1 :] if s and t and 100 * len(s & t) >= per_cent * len(s | t)]
    for _ in sets:
        for a, b in links:
            best[a] = best[b] = min(best[a], best[b])
    return sorted((i, len(s), best[i], best[i] == i) for i, s in sets)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.mark.parametrize("hot,block", [(256, 256), (3, 2)])
def test_equals_brute_force_with_near_copies(spark, sample, hot, block):
    rows = list(sample)
    words = sample[0][1].split()
    for k in range(30):  # near copies of one text around the threshold, and chains of them
        w = list(words)
        for j in range(k % 9):
            w[(37 * j + 11 * k) % len(w)] = f"changed{k}x{j}"
        rows.append((10_000 + k, " ".join(w)))
    got = rows_of(near_duplicates(spark.createDataFrame(rows, SCHEMA), hot=hot, block=block))
    assert got == brute(rows)


def test_edges_nulls_ties_and_extra_columns(spark):
    rows = [(5, None), (6, ""), (7, "  \n"), (8, "One two"), (9, "one TWO"), (3, "one two three"), (2, "one two three"), (2, "one two three"), (None, "one two three")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_shingles", F.lit("clash")).withColumn("value", F.lit(1))
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == {(5, 0): (5, True), (6, 0): (6, True), (7, 0): (7, True), (8, 1): (8, True), (9, 1): (8, False), (3, 1): (2, False), (2, 1): (2, True), (None, 1): (None, True)}
    assert near_duplicates(df).count() == len(rows)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("width,per_cent,sizes", [(3, 85, [(32, 37), (31, 36), (30, 35)]), (5, 80, [(32, 39), (32, 40), (30, 37)])])
def test_whole_sets_within_sets_longer_than_a_sketch(spark, width, per_cent, sizes):
    rows = []
    for seed in range(240):
        n, m = sizes[seed % len(sizes)]
        words = [f"w{seed}x{k}" for k in range(m + width - 1)]
        rows += [(2 * seed, " ".join(words[: n + width - 1])), (2 * seed + 1, " ".join(words))]
    got = rows_of(near_duplicates(spark.createDataFrame(rows, SCHEMA), width=width, per_cent=per_cent))
    assert got == brute(rows, width, per_cent)
    assert sum(not r[3] for r in got) == 240


@pytest.mark.parametrize("per_cent", [80, 85])
def test_short_prefixes_follow_from_the_sizes(per_cent):
    for n in range(1, 33):
        shared = [c - max(0, m - 32) for m in range(1, 60) for c in range(1, min(n, m) + 1) if 100 * c >= per_cent * (n + m - c)]
        assert _needed(n, per_cent, 32) == min(shared)
        assert n < 32 * per_cent / 100 or min(shared) >= _wanted(per_cent / 100, 32)


@pytest.mark.parametrize("width,per_cent", [(3, 85), (5, 80)])
def test_sizes_around_the_length_of_a_sketch(spark, width, per_cent):
    """All pairs of sizes from 25 to 45, one set within the other or shifted against it."""
    rows = []
    for n in range(25, 46):
        for m in range(n, min(46, n + 12)):
            words = [f"w{n}x{m}x{k}" for k in range(m + width + 1)]
            i = 10 * len(rows)
            rows += [(i, " ".join(words[: n + width - 1])), (i + 1, " ".join(words[(n + m) % 3 : m + width - 1]))]
    got = rows_of(near_duplicates(spark.createDataFrame(rows, SCHEMA), width=width, per_cent=per_cent))
    assert got == brute(rows, width, per_cent)
    assert sum(not r[3] for r in got) > 60
