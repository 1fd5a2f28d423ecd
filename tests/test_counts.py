"""Order statistics, moments and top lists against plain computations; the plan of the profile."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.contract import Contract, Reference, Table
from granary.operators import counts as vc
from granary.operators import profile
from granary.plans import decide
from granary.operators.profile import PERCENTILES


def test_quantiles_equal_sorted_values(spark):
    rng = random.Random(1)
    groups = {0: [rng.gauss(0, 100) for _ in range(3000)], 1: [rng.choice([1.0, 2.0, 2.0, 7.0]) for _ in range(2000)], 2: [5.0], 3: [1.0, 2.0], 4: [float(k) for k in range(100)], 5: [-0.5] * 1000 + [9.0]}
    rows = [(g, v, n) for g, vs in groups.items() for v, n in Counter(vs).items()]
    df = spark.createDataFrame(rows, "g int, value double, n long").repartition(6)
    shares = (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)
    found = {r.g: r for r in vc.distributions(df.union(df.filter("value > 1").withColumn("n", F.lit(0))), "g", shares).collect()}
    assert {g: pytest.approx([np.quantile(vs, p) for p in shares]) for g, vs in groups.items()} == {g: r.p for g, r in found.items()}
    twice = {r.g: r.p for r in vc.distributions(df.union(df), "g", (0.5,)).collect()}
    assert twice == {g: pytest.approx([np.quantile(vs * 2, 0.5)]) for g, vs in groups.items()}
    for g, vs in groups.items():
        assert (found[g].sample_size, found[g].min, found[g].max) == (len(vs), min(vs), max(vs))
        assert found[g].mean == pytest.approx(np.mean(vs)) and found[g].stddev == pytest.approx(np.std(vs), abs=1e-9)


def test_percentiles_have_no_single_task(spark):
    df = spark.range(5000).select((F.col("id") % 1000).cast("double").alias("v"), F.col("id").alias("w"))
    plan = profile.numeric_distribution(df, "t", ["v", "w"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "percentile(" not in plan
    assert profile.percentile_cont(df, "v", 0.5).collect()[0].value == 499.5
    assert profile.percentile_cont(df.limit(0), "v", 0.5).collect() == []


def star(spark):
    rng = random.Random(2)
    parent = [(k, k % 3, f"n,{k % 5}") for k in range(60)]
    child = [(k, rng.choice([None, *range(70)]), rng.choice([None, 0, 1, 2]), rng.choice([None, "a,b", "a\\,b", "c"]), rng.choice([None, 0.5, 1e300, -2.0]), rng.randrange(4)) for k in range(900)]
    tables = {
        "parent": spark.createDataFrame(parent, "p_key int, p_part long, p_name string"),
        "child": spark.createDataFrame(child, "c_key long, c_parent long, c_part int, c_text string, c_value double, `c.odd` int"),
        "empty": spark.createDataFrame([], "e_key int, e_name string"),
    }
    contract = Contract(
        {"parent": Table("parent", ("p_key",), unique=(("p_name",), ("p_key", "p_part"))), "child": Table("child", ("c_key",)), "empty": Table("empty", ("e_key",))},
        (Reference("child", ("c_parent", "c_part"), "parent", ("p_key", "p_part")), Reference("child", "c_parent", "parent", "p_key"), Reference("child", "c_part", "gone", "g_key")),
    )
    return tables, contract, parent, child


def test_full_profile_of_composite_references_nulls_and_empty_tables(spark):
    tables, contract, parent, child = star(spark)
    axes = {k: df.collect() for k, df in profile.full_profile(tables, contract, top=2).items()}
    columns = {(r.table, r.column): r for r in axes["column_profile"]}
    assert len(columns) == 11 and columns["empty", "e_name"].n_rows == 0 and columns["empty", "e_name"].zero_null
    assert columns["child", "c_text"].n_nulls == sum(r[3] is None for r in child) and columns["child", "c_text"].max_length == 4
    assert columns["child", "c_value"].max_length is None
    assert {(r.table, r.columns): r.n_duplicate_keys for r in axes["unique_candidate"]} == {("parent", "p_key"): 0, ("parent", "p_name"): 5, ("parent", "p_key,p_part"): 0, ("child", "c_key"): 0, ("empty", "e_key"): 0}
    held, both = {p[0] for p in parent}, {p[:2] for p in parent}
    want = {"child.c_parent+c_part": sum(None not in r[1:3] and r[1:3] not in both for r in child), "child.c_parent": sum(r[1] is not None and r[1] not in held for r in child), "child.c_part": 0}
    assert {r.reference: r.n_orphans for r in axes["fk_reality"]} == want
    assert {r.reference: r.outcome for r in axes["fk_reality"]}["child.c_part"] == "AmbiguousMapping"
    pairs = Counter(r[1:3] for r in child if None not in r[1:3])
    best = sorted(pairs.items(), key=lambda x: (-x[1], ",".join(map(str, x[0]))))[:2]
    assert [(r.parent_key, r.n) for r in sorted(axes["fk_selectivity"], key=lambda r: r["rank"]) if r.reference == "child.c_parent+c_part"] == [(",".join(map(str, k)), n) for k, n in best]
    texts = Counter(r[3] for r in child if r[3])
    assert {r.value: r.n for r in axes["categorical_distribution"] if r.column == "c_text"} == dict(sorted(texts.items(), key=lambda x: (-x[1], x[0]))[:2])
    numbers = {(r.table, r.column): r for r in axes["numeric_distribution"]}
    values = [r[4] for r in child if r[4] is not None]
    assert [numbers["child", "c_value"][f"p{int(p * 100)}"] for p in PERCENTILES] == pytest.approx([float(np.quantile(values, p)) for p in PERCENTILES])
    assert ("child", "c.odd") in numbers and not any(t == "empty" for t, _ in numbers)
    assert {r.table for r in axes["fk_cardinality"]} >= {"child.c_parent+c_part", "child.c_parent"}


def test_full_profile_reads_every_table_once(spark, tmp_path):
    tables, contract, _, _ = star(spark)
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}")
    read = {name: spark.read.parquet(f"{tmp_path}/{name}") for name in tables}
    jobs = profile.full_profile(read, contract)
    plans = "".join(df._jdf.queryExecution().executedPlan().toString() for df in jobs.values())
    assert not any(f"{tmp_path}/{name}" in plans for name in tables)  # all axes come from the counts


def test_orphans_are_not_joined_with_all_counts(spark):
    tables, contract, _, _ = star(spark)
    plan = profile.full_profile(tables, contract)["fk_reality"]._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan  # all counts of all tables went through this join


def test_times_without_zone_and_whole_tuples_are_counted_as_numbers(spark):
    times = ["1969-12-31 23:59:59.999999", "2024-03-31 02:30:00", "2024-03-31 03:30:00", "2024-03-31 02:30:00", None, "0001-01-01 00:00:00.000001"]
    df = spark.createDataFrame([(t, k % 2, None if k == 5 else 7) for k, t in enumerate(times)], "t string, a int, b long").withColumn("t", F.col("t").cast("timestamp_ntz"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")  # 02:30 doesn't exist there on that day
    try:
        counts, subjects = vc.count_values({"x": (df, [("t",), ("a", "b")])})
        rows = counts.collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert subjects == [("x", ("t",)), ("x", ("a", "b"))]
    micros = lambda t: round((np.datetime64(t.replace(" ", "T"), "us") - np.datetime64("1970-01-01T00:00:00", "us")).astype(int))
    assert Counter({r.whole: r.n for r in rows if r.subject == 0}) == Counter(t and micros(t) for t in times)
    assert {r.text: r.n for r in rows if r.subject == 1} == {"0,7": 3, "1,7": 2, None: 1}


@pytest.mark.parametrize("times", [1, 40])
def test_top_lists_sort_few_rows_and_keep_every_tie(spark, times):
    rng = random.Random(3)
    rows = [(0, k, None, None, rng.choice([1] * 50 + [2])) for k in range(20_000)] + [(1, None, None, f"v{k * 7919 % 1_000_003}", times) for k in range(20_000)] + [(2, None, float(k), None, k) for k in range(60)] + [(0, None, None, None, 99)]
    df = spark.createDataFrame(rows, "subject int, whole long, real double, text string, n long").repartition(5)
    want = {}
    for subject, *value, n in rows:
        if value != [None] * 3:
            want.setdefault(subject, []).append((-n, *[x for x in value if x is not None], *value))
    got = {k: [(-r.n, r.whole, r.real, r.text) for r in sorted(vc.top_lists(df, 10).filter(F.col("subject") == k).collect(), key=lambda r: r["rank"])] for k in want}
    assert got == {k: [(x[0], *x[2:]) for x in sorted(v, key=lambda x: x[:2])[:10]] for k, v in want.items()}
    assert vc.contenders(df, 10).count() < 20_000


def test_composite_references_in_every_operator(spark):
    tables, contract, parent, child = star(spark)
    ref = contract.references[0]
    both = {p[:2] for p in parent}
    lost = Counter(r[1:3] for r in child if None not in r[1:3] and r[1:3] not in both)
    sample = profile.fk_orphan_sample(tables["child"], ref, tables["parent"], 3).collect()
    assert [(tuple(r.value), r.n_rows) for r in sample] == sorted(lost.items())[:3]
    split = profile.sentinel_split(tables["child"].fillna(0, ["c_parent", "c_part"]), ref, tables["parent"].filter("p_key > 0")).first()
    assert split.n_sentinel == sum((r[1] or 0, r[2] or 0) == (0, 0) for r in child)
    assert profile.reference_value_counts(tables, list(contract.references[:1])).agg(F.sum("n")).first()[0] == sum(None not in r[1:3] for r in child)
    assert profile.fk_cardinality(tables["child"], ref).first().sample_size == len({r[1:3] for r in child if None not in r[1:3]})
    assert profile.fk_selectivity(tables["child"], ref, 1).first().n == max(Counter(r[1:3] for r in child if None not in r[1:3]).values())


def test_merged_profiles_don_t_depend_on_their_order_and_keep_the_larger_evidence(spark):
    tables, contract, _, _ = star(spark)
    half = {t: df.filter(F.col(df.columns[0]) % 2 == 0) for t, df in tables.items()}
    one, two = profile.full_profile(tables, contract, top=3), profile.full_profile(half, contract, top=3)
    rows = lambda m: {axis: sorted(map(str, df.select(*sorted(df.columns)).collect())) for axis, df in m.items()}
    merged = rows(profile.merge_profiles([one, two]))
    assert merged == rows(profile.merge_profiles([two, one])) == rows(profile.merge_profiles([one, two, two]))
    alone = rows(one)
    assert all(merged[axis] == alone[axis] for axis in ("numeric_distribution", "categorical_distribution", "fk_selectivity", "joint_distribution", "column_profile"))


def test_every_check_of_profiles(spark):
    ok = {"n_rows": 10, "n_nulls": 0, "not_null": False, "has_duplicates": False, "unique": False, "n_orphans": 0, "outcome": "Succeeded", "unique_outcome": None, "fk_outcome": None, "composite": None, "no_check": None}
    cases = {
        "null_count_over_rows": {"n_nulls": 11}, "probe_failed": {"outcome": "FallbackTimeout"}, "nulls_in_not_null": {"not_null": True, "n_nulls": 1}, "duplicates": {"unique": True, "has_duplicates": True}, "orphans": {"n_orphans": 2},
        "composite_duplicates": {"unique": True, "has_duplicates": True, "composite": True}, "unique_probe_failed": {"unique_outcome": "Cancelled"}, "fk_probe_failed": {"fk_outcome": "Cancelled"}, "no_check": {"no_check": True},
    }
    rows = [{"env": "dev", "table": "t", "column": name, **ok, **change} for name, change in cases.items()]
    rows += [{"env": "prod", "table": "t", "column": name, **ok, **change} for name, change in cases.items()]
    rows += [{"env": "dev", "table": "gone", "column": "c", **ok}, {"env": "dev", "table": "Case", "column": "c", **ok}, {"env": "prod", "table": "case", "column": "c", **ok}]
    rows += [{"env": e, "table": "t", "column": "mixed", **ok, "unique": e == "dev"} for e in ("dev", "prod")] + [{"env": e, "table": "t", "column": "varied", **ok, "n_rows": 9000, "n_nulls": 0 if e == "dev" else 5000} for e in ("dev", "prod")]
    schema = "env string, table string, column string, n_rows long, n_nulls long, not_null boolean, has_duplicates boolean, unique boolean, n_orphans long, outcome string, unique_outcome string, fk_outcome string, composite boolean, no_check boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    got = {(r.env, r.table, r.column, r.finding) for r in decide.validate_profiles(spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)).collect()}
    want = {(e, "t", name, name) for name in cases for e in ("dev", "prod")}
    want |= {("*", "gone", "*", "table_missing"), ("*", "case", "*", "name_case"), ("*", "t", "mixed", "unique_disagreement"), ("*", "t", "varied", "null_variance")}
    assert got == want and len({f for *_, f in got}) == 13
