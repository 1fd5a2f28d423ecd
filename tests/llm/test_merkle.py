"""The dataset manifest against a plain computation, its persistent trees, and the cases of its docstring."""

import random
import zlib
from hashlib import sha256

from pyspark.sql import functions as F

from granary.llm.merkle import build, climb, dataset_manifest, fold, siblings, with_leaf, without_line_breaks

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves):
    """(root, for each leaf the runs that it and its ancestors stand in, with their places)."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    ways = []
    for i in range(len(leaves)):
        way = []
        for level in levels[:-1]:
            run = level[i // 3 * 3 : i // 3 * 3 + 3]
            way.append((run[: i % 3], run[i % 3 + 1 :]))
            i //= 3
        ways.append(way)
    return levels[-1][0], ways


def leaf_of(row, text):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], text))


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(b"" if r[1] is None else b"=" + r[1].encode(), []).append(r)
    order = sorted(trees)
    for k in order:
        trees[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[4])))
    built = {k: plain_tree([leaf_of(r, r[4]) for r in trees[k]]) for k in order}
    root, over = plain_tree([built[k][0] for k in order])
    out = []
    for at, k in enumerate(order):
        for i, r in enumerate(trees[k]):
            way = built[k][1][i] + over[at]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = leaf_of(r, r[4].replace("\n", "") if hit and r[4] is not None else r[4])
            for a, b in way:
                now = h([*a, now, *b])
            out.append((r[0], leaf_of(r, r[4]), built[k][0], root, h(x for a, b in way for x in a + b), now, now == root))
    return sorted(out, key=str)


def collected(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_manifest_equals_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for k in range(1500):
        source = rng.choice(["hot"] * 6 + ["b", "é", "Z", "", None, "=", "￿", "\U0001f600"])
        rows.append((k * 7 - 30, source, rng.choice(["en", None]), rng.choice([None, k]), rng.choice([None, "", "a\nb\n", f"text {k}", "\n", "ü\n" * 50])))
    rows += [(None, "b", None, None, None), (None, "b", None, None, "x\n"), (5, None, "en", 1, "x"), (5, None, "en", 1, "x"), (5, None, "en", 2, "x\n"), (10**15, "lone", "en", 1, "a\n" * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for c in ("tree", "i", "size", "digest", "other", "block", "path", "leaf", "root"):
        df = df.withColumn(c, F.lit(1))
    assert collected(without_line_breaks(df)) == brute(rows)


def test_trees_of_several_rounds(spark):
    trees = {"big": [h([str(k)]) for k in range(2000)], "small": [h([f"s{k}"]) for k in range(4)], "lone": [h(["x"])]}
    nodes = [(name, i, len(leaves), d) for name, leaves in trees.items() for i, d in enumerate(leaves)]
    paths, roots = climb(spark.createDataFrame(nodes, "tree string, i long, size long, digest string").repartition(5))
    root = {r.tree: r.digest for r in roots.collect()}
    assert root == {name: plain_tree(leaves)[0] for name, leaves in trees.items()}
    found = {(r.tree, r.i): [(x.l, x.r) for x in r.path] for r in paths.collect()}
    assert set(found) == {(n[0], n[1]) for n in nodes}
    assert all(fold(trees[name][i], way) == root[name] for (name, i), way in found.items())


def test_versions_share_untouched_nodes():
    top, height = build([h([str(k)]) for k in range(100)], 100)
    version = with_leaf(top, height, 40, "x" * 64)
    assert version.digest != top.digest == plain_tree([h([str(k)]) for k in range(100)])[0]
    assert fold("x" * 64, siblings(top, height, 40)) == version.digest
    copied, a, b = 0, top, version
    at = 40
    while height:
        height -= 1
        own, at = divmod(at, 3**height)
        assert all(x is y for k, (x, y) in enumerate(zip(a.children, b.children, strict=True)) if k != own)
        a, b, copied = a.children[own], b.children[own], copied + 1
    assert copied == 5 and b.digest == "x" * 64


def test_manifest_of_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert without_line_breaks(empty).collect() == []
    assert [r.verified for r in dataset_manifest(spark.createDataFrame([(1, "a", "en", 1, "x\n")], SCHEMA)).collect()] == [True]
