"""Near-duplicate embeddings: tiles in the order of the first principal axis, products that stop when they can't reach.

Vectors of a label are scaled to length 1 and turned onto principal axes, most spread first; a rotation leaves every
cosine as it is.  By Cauchy-Schwarz what the axes from k on add to a product is at most the product of the two suffix norms.
For k = 1 the bound says that the angles to the first axis differ by no more than the angle of the threshold: vectors are
sorted by that angle and cut into tiles of ``TILE`` rows, and a tile meets only the tiles within reach of its own
angles.  Each pair of tiles is a task of bounded size.  It multiplies the leading axes first, adds the next ones only for
pairs whose product so far plus the bound still reaches the threshold, and decides the rest by the cosine of the
vectors as they were given, in double precision.

Equal vectors of a label are one row with a count, so copies cost nothing.  A task returns per linked row the number of its
partners and one edge to the least row that it is connected with in the task, so groups of near copies are counted in
full but never written as pairs.  Components of the edges are the classes.

The axes are fitted on about ``SAMPLE`` vectors picked by hash; they decide the amount of work, never a result.  Where
vectors don't lie along few axes, all tiles of a label meet, and the work is quadratic in the label's different vectors.

Defined results: vectors that are null, empty, zero or hold null, NaN or infinite components, and rows with a null label or
vec_id, link with nothing (0 links, component vec_id, kept); vectors of unequal lengths don't link; rows are vectors
of their own though they share a vec_id.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.scratch import drop, save
from granary.llm.ranks import ranked_in
from granary.operators.components import connected_components

TILE = 1024
SAMPLE = 4096
#: Axes after which the bound is looked at, besides the first and the last.
STOPS = (8, 16, 32, 64, 128, 256, 512)
#: Pairs at once where few are left; a share of pairs from which whole matrices are cheaper.
SLAB, DENSE = 1 << 16, 0.05
_SLACK = 1e-9
#: A class of more copies is looked up in so many parts.
LARGE, SPREAD = 1000, 256


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that neither huge nor tiny components overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column, all of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def principal_axes(vectors: np.ndarray) -> np.ndarray:
    """Orthogonal axes as columns, from the largest spread of unit vectors to the least."""
    u = unit_rows(vectors)
    return np.ascontiguousarray(np.linalg.eigh(u.T @ u)[1][:, ::-1])


def linked_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray | None, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (x of a, y of b) with a cosine of at least the threshold, in slabs; each pair once where ``same``."""
    a, b = unit_rows(a), unit_rows(b)
    left, right = (a, b) if axes is None else (a @ axes, b @ axes)
    size = a.shape[1]
    stops = [s for s in STOPS if s < size] + [size]
    rest = [[np.sqrt(np.maximum(0.0, 1.0 - np.cumsum(v * v, axis=1)[:, s - 1])) for s in stops] for v in (left, right)]
    least = threshold - _SLACK
    product, done = np.zeros((len(a), len(b))), 0
    alive = np.triu(np.ones(product.shape, bool), 1) if same else np.ones(product.shape, bool)
    for k, stop in enumerate(stops):
        product += left[:, done:stop] @ right[:, done:stop].T
        alive &= product + rest[0][k][:, None] * rest[1][k] >= least
        done = stop
        if np.count_nonzero(alive) <= DENSE * alive.size:
            break
    some_x, some_y = np.nonzero(alive)
    for at in range(0, len(some_x), SLAB):
        x, y = some_x[at : at + SLAB], some_y[at : at + SLAB]
        own, low = product[x, y], done
        for k, stop in enumerate(stops):
            if stop > low and len(x):
                own = own + np.einsum("ij,ij->i", left[x, low:stop], right[y, low:stop])
                keep = own + rest[0][k][x] * rest[1][k][y] >= least
                x, y, own, low = x[keep], y[keep], own[keep], stop
        keep = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
        yield x[keep], y[keep]


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that pairs (x, y) connect it with."""
    root = np.arange(n)
    while len(x):
        least = np.minimum(root[x], root[y])
        now = root.copy()
        np.minimum.at(now, root[x], least)
        np.minimum.at(now, root[y], least)
        now = now[now]
        if (now == root).all():
            break
        root = now
    return root


_FOUND = "cls long, rep long, n long, root_cls long, root_rep long"


def _compare(axes: dict[int, np.ndarray], threshold: float):
    """Links of a pair of tiles: per linked row its number of partners, counted with their copies, and its root."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("tile", "ascending"), ("rep", "ascending"), ("cls", "ascending")])
        tile, cls, rep, members = (t[c].to_numpy() for c in ("tile", "cls", "rep", "members"))
        vectors = _matrix(t["embedding"])
        cut = int(np.searchsorted(tile, tile[0], "right"))
        same = cut == len(tile)
        a, b, shift = (vectors, vectors, 0) if same else (vectors[:cut], vectors[cut:], cut)
        n, root = np.zeros(len(tile), np.int64), np.arange(len(tile))
        order = np.lexsort((cls, rep))  # roots by least rep, then class
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        for x, y in linked_pairs(a, b, axes.get(vectors.shape[1]), threshold, same):
            y = y + shift
            np.add.at(n, x, members[y])
            np.add.at(n, y, members[x])
            now = np.arange(len(tile))
            root = _roots(len(tile), np.concatenate([place[x], now]), np.concatenate([place[y], root]))
        linked = np.flatnonzero(n)
        to = order[root[place[linked]]]
        return pa.table({"cls": cls[linked], "rep": rep[linked], "n": n[linked], "root_cls": cls[to], "root_rep": rep[to]})

    return run


def _angles(axes: dict[int, np.ndarray]):
    """Rows with the angle of their vector to the first axis of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index("embedding"))
            size = b.column(b.schema.get_field_index("size")).to_numpy()
            angle = np.zeros(b.num_rows)
            for d in np.unique(size):
                own = np.flatnonzero(size == d)
                u = unit_rows(_matrix(column.take(pa.array(own))))
                angle[own] = np.arccos(np.clip(u @ axes[int(d)][:, 0] if int(d) in axes else u[:, 0], -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(angle)], [*b.schema.names, "angle"])

    return run


def _axes(classes: DataFrame, sample: int) -> dict[int, np.ndarray]:
    """Principal axes for each length of vectors in a sample of about so many; other lengths keep the axes they have."""
    n = classes.count()
    few = classes.filter(F.pmod("h2", F.lit(max(1, n // sample))) == 0).select("size", "embedding").toArrow()
    size = few["size"].to_numpy()
    return {int(d): principal_axes(_matrix(few["embedding"].combine_chunks().take(pa.array(np.flatnonzero(size == d))))) for d in np.unique(size)} if few.num_rows else {}


def _meetings(rows: DataFrame, threshold: float) -> DataFrame:
    """(label, size, tile, t1, t2): the tiles that each pair (t1, t2) within reach is made of, t1 <= t2."""
    tiles = rows.groupBy("label", "size", "tile").agg(F.min("angle").alias("low"))
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6
    # A tile ends where the next begins, so it reaches all that begin within reach of the next.
    within = tiles.withColumn("near", F.expr(f"count(1) OVER (PARTITION BY label, size ORDER BY low RANGE BETWEEN CURRENT ROW AND {reach!r}D FOLLOWING)"))
    order = Window.partitionBy("label", "size").orderBy("tile")
    last = F.least(F.col("tile") + F.coalesce(F.lead("near").over(order), F.lit(0)), F.max("tile").over(Window.partitionBy("label", "size")))
    pairs = within.withColumn("last", last).select("label", "size", F.col("tile").alias("t1"), F.explode(F.sequence("tile", "last")).alias("t2"))
    both = F.explode(F.array_distinct(F.array("t1", "t2"))).alias("tile")
    return pairs.select("label", "size", "t1", "t2", both)


def embedding_duplicates(vectors: DataFrame, *, threshold: float = 0.98, tile: int = TILE, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of (vec_id, embedding, label)."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    fine = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & sound, F.lit(False))
    rows = rows.withColumn("h1", F.when(fine, F.xxhash64("embedding"))).withColumn("h2", F.when(fine, F.xxhash64(F.lit(1), "embedding")))
    classes = rows.filter("h1 IS NOT NULL").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("members"), F.first("h1").alias("h1"), F.first("h2").alias("h2"))
    classes = save(classes.withColumn("size", F.size("embedding")).withColumn("cls", F.monotonically_increasing_id()), "vectors")
    axes = _axes(classes, sample)
    sortable = classes.select("label", "size", "cls", "rep", "members", "embedding")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sortable.schema) + ", angle double"
    placed = ranked_in(sortable.mapInArrow(_angles(axes), kind), ["label", "size"], ["angle", "cls"])
    placed = placed.withColumn("tile", F.floor(F.col("i") / tile)).drop("i", "i_of")
    met = placed.join(_meetings(placed, threshold), ["label", "size", "tile"])
    found = save(met.groupBy("label", "size", "t1", "t2").applyInArrow(_compare(axes, threshold), _FOUND), "links")

    node = lambda rep, cls: F.struct(F.col(rep).alias("rep"), F.col(cls).alias("cls"))
    edges = found.filter("cls <> root_cls").select(node("rep", "cls").alias("src"), node("root_rep", "root_cls").alias("dst"))
    components = connected_components(edges).select(F.col("node.cls").alias("cls"), F.col("component.rep").alias("component"))
    partners = found.groupBy("cls").agg(F.sum("n").alias("n"))
    told = classes.join(partners, "cls", "left").join(components, "cls", "left")
    told = save(told.select("label", "h1", "h2", "members", (F.col("members") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("of")), "classes")
    # Large classes are there ``SPREAD`` times and every row asks one of these; the rest then asks the small classes.
    keys = ["label", "h1", "h2"]
    side = lambda df, s: df.select(*[F.col(c).alias(f"{s}_{c}") for c in (*keys, "part", "links", "of")])
    large = side(told.filter(F.col("members") > LARGE).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))), "l")
    small = side(told.filter(F.col("members") <= LARGE).withColumn("part", F.lit(0)), "s")
    on = lambda s, part: [F.col(c) == F.col(f"{s}_{c}") for c in keys] + [part == F.col(f"{s}_part")]
    asked = rows.select("vec_id", *keys, F.pmod(F.xxhash64("vec_id"), F.lit(SPREAD)).cast("int").alias("part"))
    asked = asked.join(large, on("l", F.col("part")), "left")
    asked = asked.withColumn("ask", F.when(F.col("l_of").isNull(), F.lit(0)).otherwise(F.col("part") + 1)).join(small, on("s", F.col("ask")), "left")
    out = asked.select("vec_id", F.coalesce("l_links", "s_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("l_of", "s_of", "vec_id").alias("component_id"))
    drop(found)
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))
