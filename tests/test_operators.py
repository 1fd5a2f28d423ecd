"""Laws and edges that the SQL comparison doesn't reach."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.contract import STAR, Contract, Reference, Table
from granary.functions.scratch import new_path
from granary.operators import closure, diff, graph, reconcile, synth, upsert
from granary.operators.components import connected_components
from granary.operators.profile import numeric_distribution, table_fingerprint, unique_candidate
from granary.plans import correct
from granary.sources import tables as src

SF = "/root/testdata/sf0.001"


def test_digest_ignores_order_and_partitions(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    one = diff.table_digest(o).first()
    assert one == diff.table_digest(o.orderBy(F.rand(3)).repartition(7)).first()
    assert one != diff.table_digest(o.filter("o_orderkey > 1")).first()


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.sampled_from(["", "a", "b"]))), max_size=8))
def test_digest_is_a_sum(spark, rows):
    df = lambda r: spark.createDataFrame(r, "k int, v string")
    parts = [int(diff.table_digest(df(r)).first().digest, 16) for r in (rows[::2], rows[1::2])]
    assert int(diff.table_digest(df(rows)).first().digest, 16) == sum(parts) % 2**256


def test_null_and_empty_text_differ_in_a_digest(spark):
    d = lambda v: diff.table_digest(spark.createDataFrame([(1, v)], "k int, v string")).first().digest
    assert d(None) != d("")


def test_upsert_twice_changes_nothing(spark):
    rng = random.Random(1)
    make = lambda: spark.createDataFrame([(k, rng.choice(["x", "y", None])) for k in range(40) if rng.random() < 0.7], "k int, v string")
    target, source = make(), make()
    once = upsert.merge_upsert(target, source, ["k"]).drop("action")
    assert {r.action for r in upsert.merge_upsert(once, source, ["k"]).collect()} == {"keep"}


def test_sync_mode_refuses_a_drifted_target(spark):
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b")], "k int, v string")
    with pytest.raises(ValueError, match="drifted"):
        upsert.sync_modes(a, b, ["k"], "validate_then_apply")


def test_components_ranks_and_labels_equal_plain_python(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 160)]
    df = spark.createDataFrame([*edges, (None, 3)], "src long, dst long")
    best = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            best[a] = best[b] = min(best[a], best[b])
    got = {r.node: r.component for r in connected_components(df).collect()}
    loops = {x for x in best if all(a == b for a, b in edges if x in (a, b))}
    assert got == {x: c for x, c in best.items() if x not in loops}
    e = {(a, b) for a, b in edges}
    nodes = sorted({x for p in e for x in p})
    score = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(60):
        out = {x: sum(a == x for a, _ in e) for x in nodes}
        lost = sum(score[x] for x in nodes if not out[x])
        score = {x: 0.15 / len(nodes) + 0.85 * lost / len(nodes) + 0.85 * sum(score[a] / out[a] for a, b in e if b == x) for x in nodes}
    ranks = {r.node: r.score for r in graph.pagerank(df.dropna(), rounds=60).collect()}
    assert ranks == pytest.approx(score, abs=1e-6)
    labels = {r.node: r.label for r in graph.label_propagation(df.dropna(), rounds=1).collect()}
    near = {x: {b for a, b in e if a == x} | {a for a, b in e if b == x} for x in nodes}
    assert labels == {x: min(near[x] - {x}) for x in nodes if near[x] - {x}}


def test_rounds_go_on_to_the_end(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(70, 71), (71, 70)], "src long, dst long")
    assert {r.node: r.level for r in graph.dependency_levels(chain).collect()} == {**{k: k for k in range(21)}, 70: None, 71: None}
    reach = graph.reachable_sets(chain, spark.createDataFrame([(0,), (15,), (70,)], "node long"), 3)
    assert sorted(map(tuple, reach.collect())) == sorted([(0, k) for k in range(1, 21)] + [(15, k) for k in range(16, 21)])


def test_labels_that_swap_for_ever_are_at_rest(spark):
    star = spark.createDataFrame([(1, k) for k in range(2, 6)], "src long, dst long")
    labels = {r.node: r.label for r in graph.label_propagation(star).collect()}
    assert labels == dict.fromkeys(range(1, 6), 1)


def test_closure_by_composite_keys_and_long_chains(spark):
    c = Contract({"p": Table("p", ("a", "b")), "c": Table("c", ("id",))}, (Reference("c", ("x", "y"), "p", ("a", "b")), Reference("p", ("ua", "ub"), "p", ("a", "b"))))
    p = spark.createDataFrame([(1, k, 1, k + 1 if k < 22 else None) for k in range(23)] + [(2, k, None, None) for k in range(23)], "a int, b int, ua int, ub int")
    ch = spark.createDataFrame([(1, 1, 5), (2, 2, 7), (3, 2, None)], "id int, x int, y int")
    held = closure.referential_closure(c, {"p": p, "c": ch}, {"c": ch})
    assert sorted(map(tuple, held["p"].collect())) == [(1, k) for k in range(5, 23)] + [(2, 7)]
    rows = closure.closed_rows(c, {"p": p, "c": ch}, held)
    assert rows["p"].count() == 19
    assert {(r.kind, r.name): r.n for r in closure.closure_report(c, rows, {"c.x+y"}).collect()}[("dangling", "c.x+y")] == 0


def test_upsert_refuses_a_repeated_source_key(spark):
    t = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(Exception, match="more than once"):
        upsert.merge_upsert(t, spark.createDataFrame([(1, "b"), (1, "c")], "k int, v string"), ["k"]).collect()


def test_digests_tell_hard_values_apart(spark):
    d = lambda *v: diff.table_digest(spark.createDataFrame([(x,) for x in v], "v double")).first().digest
    values = [0.0, 3e-7, float("nan"), float("inf"), None, 1e300, 0.1 + 0.2, 0.3]
    assert len({d(v) for v in values}) == len(values)
    text = lambda *rows: diff.table_digest(spark.createDataFrame(rows, "a string, b string")).first().digest
    assert text(("x\x1eb=3:y", "z")) != text(("x", "y\x1eb=1:z"))
    mark = lambda *v: table_fingerprint(spark.createDataFrame([(x,) for x in v], "v string"), "t", "v").first().checksum
    assert mark("a", "a") != mark("b", "b") and mark("a", "b") == mark("b", "a")


def test_levels_leave_cycles_open(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (7, 8), (8, 7), (8, 9)], "src long, dst long")
    assert {r.node: r.level for r in graph.dependency_levels(df).collect()} == {1: 0, 2: 1, 3: 2, 7: None, 8: None, 9: None}


def test_numbers_are_the_same_at_any_partitioning(spark):
    c = spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey")
    rows = lambda n: sorted(map(tuple, reconcile.numbered(c.repartition(n), ["c_custkey"]).collect()))
    assert rows(2) == rows(9) and [r[1] for r in rows(2)] == list(range(1, c.count() + 1))
    draw = lambda n: sorted(map(tuple, synth.mint_keys(spark, 50, "k").repartition(n).select("k", synth.draw_categorical(3, "t", "c", [("a", 1), ("b", 2)])).collect()))
    assert draw(2) == draw(20)


def test_small_samples_have_no_distribution_and_nulls_are_no_duplicates(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (None, "a")], "x double, s string")
    assert numeric_distribution(df, "t", ["x"]).collect() == []
    assert not unique_candidate(df, "t", ["s"]).first().has_duplicates
    assert unique_candidate(df, "t", ["s"], nulls_together=True).first().has_duplicates


def test_corrections_refuse(spark):
    c = spark.read.parquet(f"{SF}/customer.parquet")
    with pytest.raises(correct.Refused, match="expected_count"):
        correct.correct_constant(c, "c_custkey", "c_name", "x", correct.Guards(where=F.col("c_custkey") < 10, expected=1))
    with pytest.raises(correct.Refused, match="inbound"):
        correct.correct_exclude(c, "c_custkey", F.col("c_custkey") == 7, [(spark.createDataFrame([(7,)], "o_custkey long"), "o_custkey")])


def test_csv_keeps_null_apart_from_empty(spark, tmp_path):
    src.csv_sink(spark.createDataFrame([(1, None), (2, ""), (3, "x")], "b int, a string").coalesce(1), str(tmp_path / "o"), ["a", "b"])
    text = next((tmp_path / "o").glob("*.csv")).read_bytes()
    assert text == b'a,b\r\n,1\r\n"",2\r\nx,3\r\n'


def test_user_files(spark, tmp_path):
    (tmp_path / "u.csv").write_text("Id,UserName,EMail\n 1 , ann ,A@x\n,bob,b@x\n")
    (tmp_path / "m.csv").write_text("SourceUserId,TargetUserId,Rationale\n1,2,same\n3,,open\n")
    good, bad = src.read_user_inventory(spark, str(tmp_path / "u.csv"))
    assert [(r.id, r.username, r.email) for r in good.collect()] == [("1", "ann", "A@x")] and bad.count() == 1
    assert [(r.source_key, r.target_key) for r in src.read_user_map(spark, str(tmp_path / "m.csv")).collect()] == [("1", "2"), ("3", None)]


def test_profile_store_and_exports(spark, tmp_path):
    p = spark.createDataFrame([("t", 1)], "table string, n int")
    src.save_profile(p, str(tmp_path / "p"), "dev")
    src.save_profile(p.withColumn("n", F.lit(2)), str(tmp_path / "p"), "prod")
    src.save_profile(p.withColumn("n", F.lit(3)), str(tmp_path / "p"), "dev")
    assert {(r.env, r.n) for r in src.load_profile(spark, str(tmp_path / "p")).collect()} == {("dev", 3), ("prod", 2)}
    src.distribution_export(p, str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).count() == 1
    assert src.wipe_and_load(p, str(tmp_path / "w")) == 0 and src.wipe_and_load(p, str(tmp_path / "w")) == 2


def test_load_resumes_and_refuses_a_changed_source(spark):
    path = new_path(spark, "load")
    o = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey")
    first = src.resumable_load(o, path, "o_orderkey", 500, "orders")
    again = src.resumable_load(o, path, "o_orderkey", 500, "orders")
    assert first.count() == again.count() and again.agg(F.sum("n_rows")).first()[0] == o.count()
    assert spark.read.parquet(f"{path}/orders").count() == o.count()
    with pytest.raises(ValueError, match="changed"):
        src.resumable_load(o.filter("o_orderkey > 3"), path, "o_orderkey", 500, "orders")


def test_a_load_keeps_rows_without_a_key(spark):
    path = new_path(spark, "load")
    df = spark.createDataFrame([(1, "a"), (7, "b"), (None, "c"), (None, None)], "k int, v string")
    journal = src.resumable_load(df, path, "k", 5, "t")
    assert {(r.chunk, r.n_rows) for r in journal.collect()} == {(0, 1), (1, 1), (None, 2)}
    assert {(r.k, r.v, r.chunk) for r in spark.read.parquet(f"{path}/t").collect()} == {(1, "a", 0), (7, "b", 1), (None, "c", None), (None, None, None)}
    assert src.resumable_load(df, path, "k", 5, "t").count() == 3


def test_load_order_of_the_star():
    levels = STAR.levels()
    assert levels[0] == ["region", "part"] and levels[-1] == ["lineitem"]


def test_the_entry_stands_without_the_llm_folder(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == len(STAR.references)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
