"""Importance resampling against a plain computation, its checksums and its radix sort."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from granary.llm import resample
from granary.llm.resample import importance_resample, radix_ranks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(folded)
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def bucket(x):
    return zlib.crc32(x.encode()) % 10_000


def brute(docs, target):
    s, t = (Counter(bucket(x) for text in side for x in runs(text)[1]) for side in ([d[1] for d in docs], target))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + 10_000) / ((s[b] + 1) * (nt + 10_000))))
    out = []
    for i, text in docs:
        words, found = runs(text)
        weight = sum(gain(bucket(x)) for x in found)
        score = None
        if i is not None:
            u = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None, words])
    may = sorted((r for r in out if r[5] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(may[: 5 * len(may) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def texts(rng, n):
    words = ["alpha", "Beta", "ÄÖü", "7", "x" * 63, "x" * 64, "x" * 65, "y" * 66, "z" * 300, "日本", "a", "I"]
    return [rng.choice([" ", "-", "\n", "  ", "_"]).join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 19, 20, 60]))) for _ in range(n)]


def test_resample_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    docs = [(k * 3 - 100, x) for k, x in enumerate(texts(rng, 400))] + [(None, "a b " * 30), (10**12, None), (10**12 + 1, ""), (10**12 + 2, "ab " * 300_000), (7, "a b c"), (7, "a b c")]
    target = texts(rng, 30) + [None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for c in ("score", "rank", "weight", "n_words", "k1", "_at", "_block", "bucket", "side"):
        df = df.withColumn(c, F.lit("x"))
    got = importance_resample(df, spark.createDataFrame([(k, t, 1) for k, t in enumerate(target)], "item_id long, text string, side int"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target)


def test_slices_of_words_lose_no_run(monkeypatch):
    monkeypatch.setattr(resample, "SLICE", 7)
    rng = random.Random(6)
    some = texts(rng, 60)
    found = [Counter() for _ in some]
    for first, _, words, slices in resample.features(pa.array(some)):
        assert [runs(x)[0] for x in some[first : first + len(words)]] == words.tolist()
        for row, b in slices:
            for r, x in zip(row.tolist(), b.tolist(), strict=True):
                found[first + r][x] += 1
    assert found == [Counter(map(bucket, runs(x)[1])) for x in some]


def test_shifts_equal_zero_bytes():
    rng = np.random.default_rng(1)
    by = np.array([0, 1, 2, 63, 64, 65, 66, 67, 1000, 70_001])
    c = rng.integers(0, 1 << 32, len(by), np.uint32)
    want = [zlib.crc32(bytes(int(n)), int(x) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for x, n in zip(c, by, strict=True)]
    assert resample.shift(c, by).tolist() == want


def test_radix_ranks_are_stable(spark):
    rng = random.Random(7)
    rows = [(k, rng.choice([0, 5, 5, 5, 1 << 40, rng.randrange(1 << 20)]), rng.randrange(5000)) for k in range(3000)]
    df = spark.createDataFrame(rows, "k long, a long, b long").repartitionByRange(6, "k").sortWithinPartitions("k")
    got = sorted((r["rank"], r.k) for r in radix_ranks(df, ["a", "b"], digit=5, block=100).collect())
    assert got == [(n + 1, r[0]) for n, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2], r[0])))]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    target = none.withColumnRenamed("doc_id", "item_id")
    assert importance_resample(none, target).collect() == []
    some = spark.createDataFrame([(k, "a b c d e f g h i j k l m n o p q r s t u") for k in range(40)], "doc_id long, text string")
    got = importance_resample(some, target).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2] and {r.n_features for r in got} == {60}
