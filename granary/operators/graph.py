"""Iterative graph operators over edge tables (src, dst); each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from granary.functions.scratch import compact, drop, save, save_buckets, union
from granary.operators.components import connected_components

__all__ = ["connected_components", "dependency_levels", "dependency_order", "label_propagation", "pagerank", "reachable_sets", "strong_components"]


#: Edges in a bucket, about; memory of a task follows it, not the graph.
BUCKET = 1 << 20


def _dealt(edges: DataFrame, column: str, name: str) -> tuple[DataFrame, int]:
    """Distinct edges as a table bucketed by one end, and the number of buckets; rounds read it without moving it."""
    n = max(edges.sparkSession.sparkContext.defaultParallelism, -(-edges.count() // BUCKET))
    return save_buckets(edges.repartition(n, column).distinct(), name, column, n), n


def pagerank(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-9, rounds: int | None = None) -> DataFrame:
    """(node, score): scores sum to 1; dangling mass is spread evenly; ends when the largest change is under ``tolerance``.

    Changes shrink by ``damping`` each round, so the end comes.  ``rounds`` asks for so many iterations instead.  A round is
    one job: it writes the scores, and the lost mass and the largest change are observed on the way.  Scores go to the
    edges by a shuffle; a broadcast would pass the driver in every round.
    """
    e, _ = _dealt(edges.select("src", "dst"), "src", "pr-edges")
    nodes = save(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().join(e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out")), "node", "left"), "pr-nodes")
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("score"))
    ranks = save(nodes.select("node", "out", F.lit(1.0 / n).alias("score")), "pr")
    lost = ranks.filter("out IS NULL").count() / n
    done = 0
    while rounds is None or done < rounds:
        done += 1
        given = e.join(ranks.filter("out IS NOT NULL").hint("shuffle_hash"), e["src"] == ranks["node"]).groupBy("dst").agg(F.sum(F.col("score") / F.col("out")).alias("got"))
        score = F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("got", F.lit(0.0))
        now = ranks.join(given.hint("merge"), ranks["node"] == given["dst"], "left").select("node", "out", score.alias("score"), F.col("score").alias("was"))
        # What the next round and its end need is taken along by the job that writes.
        seen = Observation()
        now = now.observe(seen, F.max(F.abs(F.col("score") - F.col("was"))).alias("change"), F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("score"))), F.lit(0.0)).alias("lost"))
        new = save(now.select("node", "out", "score"), "pr")
        change, lost = seen.get["change"], seen.get["lost"]
        drop(ranks)
        ranks = new
        if rounds is None and change < tolerance:
            break
    drop(nodes)
    drop(e)
    return ranks.select("node", "score")


def label_propagation(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, label): each round a node takes its neighbours' most frequent label, the smallest of equals.

    All nodes move at once, until none does.  Labels may end in a cycle of two (two sides of a graph that swap theirs);
    then both are states of rest, and each node has the smaller of its two.  ``rounds`` asks for so many rounds instead.
    Votes are dealt before they are counted, in parts of about ``BUCKET`` edges, so no task counts more than that of them.
    """
    e, n = _dealt(edges.select("src", "dst").union(edges.select("dst", "src")).filter("src <> dst"), "dst", "lp-edges")
    start = e.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    older, old = None, save(start, "lp")
    done = 0
    while rounds is None or done < rounds:
        done += 1
        votes = e.join(old.hint("shuffle_hash"), e["dst"] == old["node"]).select("src", "label").repartition(n, "src", "label").groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy(F.col("src").alias("node")).agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select("node", F.col("b.label").alias("label"))
        new = save(best, "lp")
        if rounds is None and _same(new, old):
            drop(e)
            return new
        if rounds is None and older is not None and _same(new, older):
            drop(e)
            both = new.alias("a").join(old.alias("b"), "node")
            return both.select("node", F.least("a.label", "b.label").alias("label"))
        drop(older)
        older, old = old, new
    drop(e)
    return old


def _same(a: DataFrame, b: DataFrame) -> bool:
    return not a.alias("a").join(b.alias("b").hint("merge"), "node").filter(F.col("a.label") != F.col("b.label")).limit(1).count()


def reachable_sets(edges: DataFrame, roots: DataFrame, least: int = 3) -> DataFrame:
    """(root, node): everything reachable from each root, for roots that reach ``least`` nodes or more.

    Ends when a round finds nothing new, however long the paths.
    """
    e = save(edges.select("src", "dst").distinct(), "reach-edges")
    first = roots.select(F.col("node").alias("root")).distinct().join(e, F.col("root") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
    frontier = save(first, "reach")
    found = [frontier]
    while True:
        step = frontier.join(e, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct().join(union(found), ["root", "node"], "left_anti")
        frontier = save(step, "reach")
        if not frontier.limit(1).count():
            break
        found = [*compact(found, "reach"), frontier]
    every = union(found)
    big = every.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("root")
    return every.join(big, "root")


def dependency_levels(edges: DataFrame) -> DataFrame:
    """(node, level): 0 without parents, else one more than the highest parent; NULL on or below a cycle.

    An edge goes from a parent (src) to its dependent (dst).  Ends when no node is ready, however deep the levels.
    """
    e = save(edges.select("src", "dst").distinct(), "levels")
    left = save(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), "levels")
    done: list[DataFrame] = []
    level = 0
    while True:
        # Edges of nodes that are done block nothing any more.
        blocked = e.select(F.col("dst").alias("node")).distinct()
        ready = save(left.join(blocked, "node", "left_anti").withColumn("level", F.lit(level)), "levels")
        if not ready.limit(1).count():
            break
        rest, edges_left = left.join(ready, "node", "left_anti"), e.join(ready.select(F.col("node").alias("src")), "src", "left_anti")
        old = (left, e)
        left, e = save(rest, "levels"), save(edges_left, "levels")
        for t in old:
            drop(t)
        done = [*compact(done, "levels"), ready]
        level += 1
    return union([*done, left.withColumn("level", F.lit(None).cast("int"))])


def _trimmed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Without the nodes that nothing points to or that point to nothing, again and again: each of them stands alone."""
    alone: list[DataFrame] = []
    while True:
        both = edges.select(F.col("src").alias("node")).intersect(edges.select("dst"))
        gone = save(nodes.join(both, "node", "left_anti"), "scc-alone")
        if not gone.limit(1).count():
            drop(gone)
            return nodes, edges, alone
        alone = [*compact(alone, "scc-alone"), gone]
        rest = save(both, "scc-nodes")
        left = save(edges.join(rest.select(F.col("node").alias("src")), "src", "left_semi").join(rest.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"), "scc-edges")
        drop(nodes)
        drop(edges)
        nodes, edges = rest, left


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of (src, dst): the least node that it reaches and that reaches it; alone, itself.

    Each round trims the nodes that are on no cycle, hands the least node that reaches a node forward as its colour, and
    goes backward from the node that gave a colour, within the colour: what it meets is its component.  The rest goes into the
    next round.  Every step is a join that ends when nothing changes; NULL ends are left out.
    """
    known = edges.select("src", "dst").dropna()
    nodes = save(known.select(F.col("src").alias("node")).union(known.select("dst")).distinct(), "scc-nodes")
    left = save(known.filter("src <> dst").distinct(), "scc-edges")
    done: list[DataFrame] = []
    while True:
        nodes, left, alone = _trimmed(nodes, left)
        done += [x.select("node", F.col("node").alias("component")) for x in alone]
        if not left.limit(1).count():
            break
        colours = save(nodes.select("node", F.col("node").alias("colour")), "scc-colours")
        while True:
            told = left.join(colours, F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("least"))
            now = save(colours.join(told, "node", "left").select("node", F.least("colour", F.coalesce("least", "colour")).alias("colour"), (F.col("least") < F.col("colour")).alias("moved")), "scc-colours")
            moved = now.filter("moved").limit(1).count()
            drop(colours)
            colours = now
            if not moved:
                break
        colours = colours.select("node", "colour")
        inside = left.join(colours.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("d")), "dst").filter("c = d")
        inside = save(inside.select("src", "dst", F.col("c").alias("colour")), "scc-inside")
        front = save(colours.filter("node = colour"), "scc-found")
        found = [front]
        while True:
            step = inside.join(front.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "colour").distinct().join(union(found).select("node"), "node", "left_anti")
            front = save(step.select("node", "colour"), "scc-found")
            if not front.limit(1).count():
                break
            found = [*compact(found, "scc-found"), front]
        met = save(union(found), "scc-done")
        done.append(met.select("node", F.col("colour").alias("component")))
        rest = save(nodes.join(met, "node", "left_anti"), "scc-nodes")
        smaller = save(left.join(met.select(F.col("node").alias("src")), "src", "left_anti").join(met.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"), "scc-edges")
        for t in (nodes, left, inside):
            drop(t)
        nodes, left = rest, smaller
    return union([*done, nodes.select("node", F.col("node").alias("component"))]).distinct()


def dependency_order(edges: DataFrame) -> DataFrame:
    """(node, component, level, state) of (parent src, dependent dst): an order that holds with cycles too.

    Nodes of a cycle are one component and share a level; a component is one above the highest that it depends on.  ``state``
    is cycle for nodes on one (a node that depends on itself too), below_cycle for those that depend on one, else ordered.
    """
    e = save(edges.select("src", "dst").dropna().distinct(), "order-edges")
    of = save(strong_components(e), "order-components")
    ends = e.join(of.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(of.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
    between = save(ends.filter("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct(), "order-between")
    loops = ends.filter("a = b").select(F.col("a").alias("component")).distinct()  # a component with an edge inside is a cycle
    cycles = save(loops, "order-cycles")
    levels = dependency_levels(between)
    below = reachable_from(between, cycles.select(F.col("component").alias("node")))
    out = of.join(levels.withColumnRenamed("node", "component"), "component", "left").join(cycles.withColumn("_cycle", F.lit(True)), "component", "left").join(below.select(F.col("node").alias("component"), F.lit(True).alias("_below")), "component", "left")
    state = F.when(F.col("_cycle"), "cycle").when(F.col("_below"), "below_cycle").otherwise("ordered")
    return out.select("node", "component", F.coalesce("level", F.lit(0)).alias("level"), state.alias("state"))


def reachable_from(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): what any root reaches over (src, dst), the roots themselves only where an edge leads to them."""
    e = save(edges.select("src", "dst").distinct(), "reach-edges")
    front = save(e.join(roots.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct(), "reach")
    found = [front]
    while front.limit(1).count():
        step = e.join(front.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(union(found), "node", "left_anti")
        front = save(step, "reach")
        found = [*compact(found, "reach"), front]
    return union(found)
