"""Comparisons of tables by key range and as multisets."""

import random
from collections import Counter

import pytest

from granary.operators import diff
from granary.operators.diff import KeyRanges, classify_changes, differing_ranges, fidelity_report, row_diff

SCHEMA = "k long, j int, v string, x double"


def plain(a, b):
    """(key, state) of what is left when equal rows of both sides cancel out."""
    left, right = Counter(a), Counter(b)
    one, two = left - right, right - left
    out = []
    for key in {r[:2] for r in [*one, *two]}:
        m, n = (sum(c for r, c in side.items() if r[:2] == key) for side in (one, two))
        out += [(key, "differs")] * min(m, n) + [(key, "missing")] * max(0, m - n) + [(key, "extra")] * max(0, n - m)
    return Counter(out)


@pytest.mark.parametrize("seed", range(3))
def test_row_diff_equals_multisets(spark, seed):
    rng = random.Random(seed)
    row = lambda: (rng.choice([None, *range(40)]), rng.choice([None, 0, 1]), rng.choice([None, "", "a", "b"]), rng.choice([None, 0.0, float("nan"), 1.5]))
    canon = lambda rows: [tuple("nan" if c != c else c for c in r) for r in rows]
    a = [row() for _ in range(300)]
    b = [r for r in a if rng.random() < 0.9] + [row() for _ in range(20)]
    da, db = spark.createDataFrame(a, SCHEMA).repartition(3), spark.createDataFrame(b, SCHEMA)
    assert Counter(((r.k, r.j), r.state) for r in row_diff(da, db, ["k", "j"]).collect()) == plain(canon(a), canon(b))
    assert row_diff(da, da.repartition(5), ["k", "j"]).collect() == []
    assert row_diff(da, da.repartition(5), ["v"]).collect() == []
    found = Counter(r.change for r in classify_changes(da, db, ["k", "j"]).collect())
    left, right = Counter(canon(a)), Counter(canon(b))
    want = Counter(s for (_, s), n in plain(canon(a), canon(b)).items() for _ in range(n))
    assert found == Counter({"Unchanged": sum((left & right).values()), "Changed": want["differs"], "Deleted": want["missing"], "Added": want["extra"]})
    assert {r.change for r in classify_changes(da, da, ["k", "j"]).collect()} == {"Unchanged"}


def test_only_differing_ranges_are_read_again(spark, tmp_path):
    df = spark.range(200_000).selectExpr("id AS k", "0 AS j", "cast(id % 7 AS string) AS v", "id * 0.5D AS x").repartitionByRange(8, "k").sortWithinPartitions("k")
    df.write.option("parquet.block.size", 65536).parquet(f"{tmp_path}/a")
    a = spark.read.parquet(f"{tmp_path}/a")
    b = a.selectExpr("k", "j", "CASE WHEN k BETWEEN 50000 AND 50300 THEN 'new' ELSE v END AS v", "x")
    ranges = KeyRanges.of(a, b, ["k"])
    some = differing_ranges(a, b, ranges, a.columns)
    assert ranges.n == 1562 and 1 <= len(some) <= 4
    rows = ranges.rows_of(a, some)
    assert rows.count() <= 0.01 * 200_000
    assert "GreaterThanOrEqual(k" in rows._jdf.queryExecution().executedPlan().toString()
    got = row_diff(a, b, ["k"]).collect()
    assert {r.k for r in got} == set(range(50000, 50301)) and {tuple(r["columns"]) for r in got} == {("v",)}


def test_ranges_as_intervals_and_as_numbers(spark, monkeypatch):
    df = spark.range(-500, 20_000).selectExpr("id AS k", "0 AS j", "'' AS v", "0D AS x").union(spark.sql("SELECT null, 1, '', 0D"))
    ranges = KeyRanges.of(df, df, ["k"])
    some = [-1, 0, 1, 7, ranges.n - 1]
    want = {r.k for r in df.select("k", ranges.number().alias("r")).filter("r IN (-1, 0, 1, 7, %d)" % (ranges.n - 1)).collect()}
    assert {r.k for r in ranges.rows_of(df, some).collect()} == want and None in want and -500 in want
    monkeypatch.setattr(diff, "INTERVALS", 0)
    assert {r.k for r in ranges.rows_of(df, some).collect()} == want


def test_null_cells_in_other_places_differ(spark):
    a = spark.createDataFrame([(1, None, "2", 0.5)], "k long, p string, q string, x double")
    b = spark.createDataFrame([(1, "2", None, 0.5)], "k long, p string, q string, x double")
    assert row_diff(a, b, ["k"]).collect()[0]["columns"] == ["p", "q"]
    report = fidelity_report({"t": (a, a, ["k"]), "u": (a, b, ["k"])}).collect()
    assert [(r.n_differences, r.verdict) for r in report] == [(0, "identical"), (1, "different")]


def test_empty_sides(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(None, 1, "a", 0.0)], SCHEMA)
    assert row_diff(none, none, ["k"]).collect() == []
    assert [(r.k, r.state) for r in row_diff(one, none, ["k"]).collect()] == [(None, "missing")]
    assert [(r.k, r.state) for r in row_diff(none, one, ["v", "j"]).select("v", "state").withColumnRenamed("v", "k").collect()] == [("a", "extra")]


def test_server_digests_refuse_keys_without_one_order(spark):
    df = spark.createDataFrame([(1, 2, "a", 0.5)], SCHEMA)
    assert diff.server_digest(df, ["k"]).collect() == diff.table_digest(df).collect()
    for key in ([], ["k", "j"], ["v"], ["x"]):
        with pytest.raises(ValueError, match="key"):
            diff.server_digest(df, key)


def test_scattered_differences_leave_most_rows_alone(spark, monkeypatch):
    a = spark.range(100_000).selectExpr("CASE WHEN id % 89 <> 0 THEN id END AS k", "cast(id % 3 AS int) AS j", "'' AS v", "id * 0.5D AS x")
    b = a.filter("x % 100 <> 7")
    monkeypatch.setattr(diff, "RANGES", 100)  # more ranges differ than come to the driver
    seen = []
    paired = diff.paired_rows
    monkeypatch.setattr(diff, "paired_rows", lambda x, y, key, **more: seen.append(x.count()) or paired(x, y, key, **more))
    got = row_diff(a, b, ["k", "j"])
    want = a.filter("x % 100 = 7").select("k", "j")
    assert Counter((r.k, r.j, r.state) for r in got.collect()) == Counter((r.k, r.j, "missing") for r in want.collect())
    assert seen[0] < 0.25 * 100_000
