"""Strong components, orders with cycles, forecasts, ranked draws, profile distances, documents, units, reverts, loads."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from granary.contract import STAR, Contract, Reference, Table
from granary.functions.scratch import new_path
from granary.operators import diff, graph, reconcile, synth, upsert
from granary.sources import tables as src


def reached(edges):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    found = {}
    for root in {x for e in edges for x in e}:
        seen, todo = set(), list(out[root])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out[x]
        found[root] = seen
    return found


@pytest.mark.parametrize("seed", range(1))
def test_strong_components_and_order_equal_plain_reach(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(75)] + [(100 + k, 101 + k) for k in range(5)] + [(105, 100), (200, 200), (200, 201)]
    reach = reached(edges)
    component = {x: min({y for y in reach[x] if x in reach[y]} | {x}) for x in reach}
    df = spark.createDataFrame([*edges, (None, 3), (3, None)], "src long, dst long")
    assert {(r.node, r.component) for r in graph.strong_components(df).collect()} == set(component.items())
    got = {r.node: r for r in graph.dependency_order(df).collect()}
    cyclic = {x for x in reach if x in reach[x]}
    assert set(got) == set(reach)
    for x, r in got.items():
        below = any(x in reach[y] for y in cyclic)
        assert r.state == ("cycle" if x in cyclic else "below_cycle" if below else "ordered")
    for a, b in edges:
        assert got[a].level == got[b].level if component[a] == component[b] else got[a].level < got[b].level
    for x in reach:
        parents = [got[a].level for a, b in edges if component[b] == component[x] != component[a]]
        assert got[x].level == (1 + max(parents) if parents else 0)


def test_strong_components_of_nothing(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert graph.strong_components(none).collect() == [] and graph.dependency_order(none).collect() == []


def test_cycles_of_tables_are_resolved_or_refused():
    refs = (Reference("a", "b_id", "b", "id"), Reference("b", "a_id", "a", "id"), Reference("c", "c_id", "c", "id"), Reference("d", "a_id", "a", "id"), Reference("e", "f_id", "f", "id"), Reference("f", "e_id", "e", "id"))
    contract = Contract({t: Table(t, ("id",)) for t in "abcdef"}, refs)
    assert upsert.load_cycles(contract, {"a.b_id", "c.c_id"}) == [(["a", "b"], "Resolved", ["a.b_id"]), (["c"], "Resolved", ["c.c_id"]), (["e", "f"], "Refused", ["e.f_id", "f.e_id"])]
    assert upsert.load_cycles(STAR, set()) == []


def test_composite_references_are_deferred_whole(spark):
    contract = Contract({"p": Table("p", ("x", "y")), "c": Table("c", ("k",))}, (Reference("c", ("x", "y"), "p", ("x", "y")), Reference("p", "k", "c", "k")))
    tables = {"p": spark.createDataFrame([(1, 2, 3)], "x int, y long, k int"), "c": spark.createDataFrame([(3, 1, 2)], "k int, x int, y long")}
    order, first, stuck = upsert.two_phase_load(contract, tables, {"c.x+y"})
    late = order.index("c") > order.index("p")
    assert [tuple(r) for r in first["c"].collect()] == [(3, 1, 2) if late else (3, None, None)] and (stuck == ["p.k"]) == late


def test_forecast_of_siblings(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, *range(10)]), rng.choice([None, *range(6)]), rng.choice(["", "0", "1", "7"])) for k in range(500)]
    df = spark.createDataFrame(rows, "k int, a int, b int, c string")
    keys = lambda ks: spark.createDataFrame([(x,) for x in ks], "source_key string")
    held = {("t", "few"): {"1", "2", "3", "0"}, ("t", "all"): {str(x) for x in range(10)}, ("t", "none"): set(), ("u", "odd"): {"1", "3", "5"}, ("u", "none"): set()}
    answers = {"t": {"few": keys(held["t", "few"]), "all": keys(held["t", "all"]), "none": None}, "u": {"odd": keys(held["u", "odd"]), "none": None}}
    of, chosen = {"a": "t", "b": "u", "c": "t"}, {"t": "few", "u": "odd"}
    got = {(r.target, r.answer): (r.n_rekeyed, r.n_dropped, r.n_entering, r.chosen) for r in reconcile.forecast_candidates(df.withColumns({c: F.col(c).cast("string") for c in "ab"}), of, answers, chosen, {"t": {"all": df}}).collect()}
    for (t, answer), own in held.items():
        at = {**{x: held[x, chosen[x]] for x in chosen}, t: own}
        rekeyed = dropped = 0
        for r in rows:
            refs = [(of[c], str(v)) for c, v in zip("abc", r[1:], strict=True) if v not in (None, "")]
            ok = all(v in at[x] for x, v in refs)
            rekeyed += sum(x == t and ok for x, _ in refs)
            dropped += sum(x == t and v not in own for x, v in refs)
        assert got[t, answer] == (rekeyed, dropped, 500 if (t, answer) == ("t", "all") else 0, chosen[t] == answer)


def test_draws_by_rank_have_no_orphans_and_keep_frequencies(spark):
    parents = synth.mint_keys(spark, 5, "id", "string")
    rows = synth.mint_keys(spark, 4000, "k")
    got = Counter(r.p for r in synth.draw_fk_weighted(rows, 1, "t", "p", [(901, 60), (77, 30), (5, 10)], parents, "id").collect())
    assert set(got) == {"k:1", "k:2", "k:3"} and abs(got["k:1"] / 4000 - 0.6) < 0.03 and abs(got["k:3"] / 4000 - 0.1) < 0.03
    few = synth.draw_fk_weighted(rows, 1, "t", "p", [(901, 60), (77, 30)], parents.limit(1), "id")
    assert {r.p for r in few.collect()} == {"k:1"}
    tuples = spark.createDataFrame([(10, "x", 50), (10, "y", 30), (20, "y", 20)], "a int, b string, n long")
    joint = Counter((r.a, r.b) for r in synth.draw_fk_joint(rows, 1, "t", ["a", "b"], tuples, {"a": (parents, "id"), "b": (parents, "id")}).collect())
    assert set(joint) == {("k:1", "k:1"), ("k:1", "k:2"), ("k:2", "k:2")}
    assert abs(joint["k:1", "k:1"] / 4000 - 0.5) < 0.03
    none = synth.draw_fk_weighted(rows, 1, "t", "p", [(901, 60)], parents.limit(0), "id")
    assert none.count() == 4000 and none.filter("p IS NOT NULL").count() == 0


def test_distances_are_zero_for_the_same_and_one_for_the_disjoint(spark):
    lists = spark.createDataFrame([("t", "c", "x", 3, 1), ("t", "c", "y", 1, 2)], "table string, column string, value string, n long, rank long")
    other = lists.withColumn("value", F.concat("value", F.lit("!")))
    numbers = spark.createDataFrame([("t", "v", 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], "table string, column string, min double, p25 double, p50 double, p75 double, p95 double, p99 double, max double")
    shifted = numbers.select("table", "column", *[(F.col(c) + 100).alias(c) for c in numbers.columns[2:]])
    same = synth.reprofile_distances({"categorical_distribution": lists, "numeric_distribution": numbers}, {"categorical_distribution": lists, "numeric_distribution": numbers})
    assert {r.distance for r in same.collect()} == {0.0}
    apart = synth.reprofile_distances({"categorical_distribution": lists, "numeric_distribution": numbers}, {"categorical_distribution": other, "numeric_distribution": shifted})
    assert {r.distance for r in apart.collect()} == {1.0}
    flat = numbers.select("table", "column", *[F.lit(2.0).alias(c) for c in numbers.columns[2:]])
    assert synth.reprofile_distances({"numeric_distribution": numbers}, {"numeric_distribution": flat}).first().distance == 0.5


def test_pii_stems_are_names_of_people():
    assert synth.pii_columns(["p_name", "last_update", "FirstName", "e_mail", "ZipCode", "city", "mobile_no"]) == {"FirstName": "person", "e_mail": "email", "ZipCode": "address", "mobile_no": "phone"}


def test_documents_nest_to_any_depth_and_cycles_end(spark):
    contract = Contract({t: Table(t, ("id",)) for t in ("a", "b", "c", "ref")}, (Reference("b", "a_id", "a", "id"), Reference("c", "b_id", "b", "id"), Reference("a", "c_id", "c", "id"), Reference("c", "r_id", "ref", "id")))
    tables = {
        "a": spark.createDataFrame([(1, None), (2, None)], "id int, c_id int"), "b": spark.createDataFrame([(10, 1), (11, 1), (12, None)], "id int, a_id int"),
        "c": spark.createDataFrame([(100, 10, 7), (101, 10, None)], "id int, b_id int, r_id int"), "ref": spark.createDataFrame([(7, "seven")], "id int, name string"),
    }
    got = {r.id: r for r in diff.nested_documents(contract, tables, "a", {"ref"}).collect()}
    assert got[2]["b.a_id"] is None and [x.id for x in got[1]["b.a_id"]] == [10, 11]
    inner = got[1]["b.a_id"][0]["c.b_id"]
    assert [(x.id, x.r_id_row and x.r_id_row.name) for x in inner] == [(100, "seven"), (101, None)] and got[1]["b.a_id"][1]["c.b_id"] is None


def test_units_tie_changed_rows_only(spark):
    contract = Contract({t: Table(t, ("id",)) for t in ("a", "b", "out")}, (Reference("b", "a_id", "a", "id"), Reference("b", "o_id", "out", "id")))
    a = spark.createDataFrame([(1, "Changed"), (2, "Unchanged"), (3, "Added")], "id int, change string")
    b = spark.createDataFrame([(10, 1, None, "Added"), (11, 1, None, "Deleted"), (12, 2, None, "Changed"), (13, None, 5, "Added"), (14, 3, None, "Unchanged")], "id int, a_id int, o_id int, change string")
    got = {r.unit: (r.n_added, r.n_deleted, r.n_changed, r.escapes) for r in diff.change_units(contract, {"a": a, "b": b}, {"a", "b"}).collect()}
    assert got == {"a:1": (1, 1, 1, False), "b:12": (0, 0, 1, False), "b:13": (1, 0, 0, True), "a:3": (1, 0, 0, False)}
    ranked = diff.impact_triage(diff.change_units(contract, {"a": a, "b": b}, {"a", "b"})).collect()
    assert ranked[0].unit == "b:13" and ranked[1].unit == "a:1"


def test_reverts_go_children_first_or_not_at_all(spark):
    contract = Contract({t: Table(t, ("id",)) for t in ("p", "c")}, (Reference("c", "p_id", "p", "id"),))
    tables = {"p": spark.createDataFrame([(1,), (2,), (3,)], "id int"), "c": spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id int, p_id int")}
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "assigned_key int")
    steps, held = upsert.revert_sequence(contract, tables, {"p": keys(1, 3, 99), "c": keys(10)})
    assert [t for t, _ in steps] == ["c", "p"] and held.collect() == []
    assert {r.id for r in upsert.revert_load(contract, tables, {"p": keys(1, 3, 99), "c": keys(10)})["p"].collect()} == {2}
    with pytest.raises(ValueError, match="c.p_id \\(1\\)"):
        upsert.revert_load(contract, tables, {"p": keys(2)})


def test_a_load_writes_many_chunks_in_few_jobs_and_repairs_a_crash(spark):
    path = new_path(spark, "load")
    df = spark.range(-5, 995).selectExpr("id AS k", "cast(id AS string) AS v")
    journal = src.resumable_load(df, path, "k", 10, "t", jobs=4)
    assert journal.count() == 100 and spark.read.parquet(f"{path}/t").count() == 1000
    # A crash before a job's entries: its chunks are written again, not twice.
    kept = journal.filter("chunk < 50").collect()
    schema = journal.schema
    src.delete(spark, f"{path}/_journal/t")
    spark.createDataFrame(kept, schema).write.parquet(f"{path}/_journal/t")
    assert src.resumable_load(df, path, "k", 10, "t", jobs=3).count() == 100
    assert sorted(r.k for r in spark.read.parquet(f"{path}/t").collect()) == list(range(-5, 995))
