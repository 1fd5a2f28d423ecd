"""Near-duplicate embeddings against all pairs, with tiles of a few rows, and the cases of the docstring."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from granary.llm import embed_dedup
from granary.llm.embed_dedup import embedding_duplicates, linked_pairs, principal_axes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    sound = []
    for k, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            x /= np.abs(x).max()
            sound.append((k, x / np.sqrt((x * x).sum()), label))
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for at, (a, u, x) in enumerate(sound):
        for b, v, y in sound[at + 1 :]:
            if x == y and len(u) == len(v) and (u * v).sum() >= 0.98:
                n[a] += 1
                n[b] += 1
                root[find(b)] = find(a)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(r[0], least.get(find(k), r[0]))
    out = [(r[0], n[k], least.get(find(k)) if r[0] is not None else None) for k, r in enumerate(rows)]
    return sorted(((i, m, c, c == i if i is not None else True) for i, m, c in out), key=str)


def vectors(rng, n, size=16):
    """Random directions, near copies at all distances around the threshold, chains and equal rows."""
    rows = []
    for k in range(n):
        kind = rng.random()
        if rows and kind < 0.5:
            _, v, label = rng.choice(rows[-40:])
            step = rng.choice([0.0, 0.01, 0.03, 0.05, 0.06, 0.2])
            v = [x + step * rng.gauss(0, 1) for x in v]
        else:
            v, label = [rng.gauss(0, 1) for _ in range(size)], rng.randrange(3)
        rows.append((k * 3 + 1, [float(np.float32(x)) for x in v], label))
    return rows


EDGES = [
    (1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [float("nan")] + [1.0] * 15, 1), (1004, [float("inf")] * 16, 1), (1005, [None] + [1.0] * 15, 1), (None, [1.0] * 16, 1), (None, [1.0] * 16, 1),
    (1006, [1.0] * 16, None), (1007, [1.0] * 16, None), (1008, [1e-30] * 16, 2), (1009, [1e30] * 16, 2), (1010, [2.0] * 16, 2), (1011, [1.0] * 8, 2), (1012, [1.0] * 8, 2), (1013, [-0.0] + [1.0] * 7, 2), (1014, [0.0] + [1.0] * 7, 2), (1015, [3.0], 2), (1016, [4.0], 2), (1017, [-4.0], 2),
    (1018, [1.0] * 16, 0), (1018, [1.0] * 16, 0), (1018, [-1.0] * 16, 0), (900, [-1.0] * 16, 0),
]


def test_links_equal_all_pairs(spark):
    rows = vectors(random.Random(1), 400) + EDGES
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in ("rep", "cls", "members", "h1", "tile", "angle", "size", "part", "l_of", "i", "i_at"):
        df = df.withColumn(c, F.lit("x"))
    for tile, sample in ((1024, 4096), (16, 50), (7, 1)):
        assert sorted(map(tuple, embedding_duplicates(df, tile=tile, sample=sample).collect()), key=str) == brute(rows)


def test_copies_of_a_vector_are_one_row(spark):
    rows = [(k, [1.0, 2.0, 3.0], 1) for k in range(1500)] + [(5000, [1.0, 2.0, 3.01], 1), (5001, [3.0, -2.0, 0.0], 1)]
    got = {r.vec_id: tuple(r) for r in embedding_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k] == (k, 1500, 0, k == 0) for k in range(1500))
    assert got[5000] == (5000, 1500, 0, False) and got[5001] == (5001, 0, 5001, True)


def test_bounds_stop_products_early_and_lose_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 64))
    x[250:] = x[:250] + rng.normal(size=(250, 64)) * rng.uniform(0, 0.3, (250, 1))
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    want = {(a, b) for a, b in np.argwhere(np.triu(u @ u.T >= 0.98, 1)).tolist()}
    for dense in (0.0, 0.05, 1.0):
        monkeypatch.setattr(embed_dedup, "DENSE", dense)
        assert {(a, b) for p in linked_pairs(x, x, principal_axes(x), 0.98, True) for a, b in zip(*(v.tolist() for v in p), strict=True)} == want
    assert len(want) > 50


def test_empty_table(spark):
    assert embedding_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
