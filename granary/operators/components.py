"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.scratch import drop, save


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang every node's larger (large star) or smaller (small star) neighbours, and itself, on its least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    hung = joined.filter("v > u") if large else joined.filter("v <> m")
    out = hung.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge to another node; component is the least node reachable.

    Edges are undirected; null ends, loops and repeats are ignored.  Each round is written to the shared folder, and
    the work ends when a round leaves the edges as they were (a logarithmic number of rounds).
    """
    now = save(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v").distinct(), "edges")
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = None
    for _ in range(max_rounds):
        after = save(_star(_star(now, True), False), "edges")
        drop(now)
        now, found = after, mark(after)
        if found == before:
            break
        before = found
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
