"""What rounds of the graph operators move."""

from granary.operators import graph


def plans(monkeypatch, name):
    found, save = [], graph.save
    monkeypatch.setattr(graph, "save", lambda df, n: (found.append(df._jdf.queryExecution().executedPlan().toString()) if n == name else None) or save(df, n))
    return found


def test_scores_pass_no_driver(spark, monkeypatch):
    seen = plans(monkeypatch, "pr")
    edges = spark.range(60).selectExpr("id AS src", "(id + 1) % 60 AS dst")
    ranks = graph.pagerank(edges, rounds=2).collect()
    assert len(ranks) == 60 and all(abs(r.score - 1 / 60) < 1e-12 for r in ranks)
    assert len(seen) == 3 and not any("BroadcastHashJoin" in p for p in seen[1:])
    assert not spark.catalog.listTables()


def test_votes_are_dealt_before_they_are_counted(spark, monkeypatch):
    seen = plans(monkeypatch, "lp")
    edges = spark.range(1, 6).selectExpr("0L AS src", "id AS dst").union(spark.range(20, 23).selectExpr("id AS src", "id + 1 AS dst"))
    labels = {r.node: r.label for r in graph.label_propagation(edges, rounds=1).collect()}
    assert labels == {0: 1, **dict.fromkeys(range(1, 6), 0), 20: 21, 21: 20, 22: 21, 23: 22}
    assert "REPARTITION_BY_NUM" in seen[1] and "BroadcastHashJoin" not in seen[1]
