"""Near-duplicate classes from bottom-k sketches.

One hash function ranks the distinct word shingles of a text; the k smallest are its sketch.  Texts with equal
shingle sets form a class of copies, and only one row of each class goes on.  Inverted lists of retained values give
the overlaps: each sketch's values are ordered rarest first, and only the prefix that a partner must meet is posted.
The share of common values among the k smallest of both sketches together estimates the Jaccard similarity and
discards clear misses, the full sets decide, and connected components of the links are the result.

Exactness.  For texts with at most k shingles the sketch is the whole set and the prefix bound allows for what the
sketch of a longer partner lacks, see ``_needed``.  Of two longer ones a linked pair keeps fewer than the wanted common
values with a probability below 1e-7 (binomial tail), see ``_wanted``.  Lists are never cut: those of a value found in over ``HOT`` sketches are compared in blocks of about
``BLOCK`` by ``BLOCK`` rows, each block pair in a task of its own.

Defined results: a null or empty text, or one without words, has an empty set and no link.  Rows with one doc_id are
one node; a row with a null doc_id has a null component and is kept.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.scratch import drop, save
from granary.llm.kernels import mix, shingle_sets
from granary.operators.components import connected_components

K = 32
HOT = 256
BLOCK = 1024
#: A class of more copies is looked up in so many parts.
LARGE, SPREAD = 1000, 256
_SKETCH = "doc_id long, n_shingles long, fp1 long, fp2 long, sig array<long>"


def _wanted(threshold: float, k: int) -> int:
    """Common values that a linked pair has among the k smallest of both, but for a binomial tail below 1e-7."""
    p, tail = threshold, 0.0
    for x in range(k + 1):
        tail += math.comb(k, x) * p**x * (1 - p) ** (k - x)
        if tail > 1e-7:
            return x
    return k


def _needed(n: int, per_cent: int, k: int) -> int:
    """Values that the sketch of a text with n <= k shingles shares at least with the sketch of any linked partner.

    A link of sizes n and m has per_cent * (n + m) / (100 + per_cent) common shingles or more; the sketch of a partner
    with m > k lacks its m - k largest.
    """
    sizes = range(-(-per_cent * n // 100), 100 * n // per_cent + 1)
    return max(1, min((-(-per_cent * (n + m) // (100 + per_cent)) - max(0, m - k) for m in sizes), default=1))


def _sketches(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, one, two, sig, at = [], [], [], [], [0]
            for s in shingle_sets(b.column(1), width):
                n.append(len(s))
                one.append(int(mix(s).sum().astype(np.int64)))
                two.append(int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().astype(np.int64)))
                sig.append(s[:k].view(np.int64))
                at.append(at[-1] + len(sig[-1]))
            values = pa.array(np.concatenate(sig) if sig else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)], ["doc_id", "n_shingles", "fp1", "fp2", "sig"])

    return run


def _may_link(own: np.ndarray, other: np.ndarray, threshold: float, k: int, want: int) -> bool:
    """Whether two sketches allow a link: the share of common values among the k smallest of their union."""
    common = np.intersect1d(own, other, assume_unique=True)
    if not len(common):
        return False
    union = len(own) + len(other) - len(common)
    if union <= k:
        return len(common) >= threshold * union - 1e-9
    edge = np.sort(np.concatenate([own, np.setdiff1d(other, common, assume_unique=True)]))[k - 1]
    return int(np.searchsorted(common, edge, "right")) >= want


def _earlier(posted: list[np.ndarray], value: int) -> np.ndarray:
    """Bitmaps of the posted values under ``value`` that several rows have; a pair that shares one belongs to its list."""
    flat, row = np.concatenate(posted), np.repeat(np.arange(len(posted)), [len(p) for p in posted])
    flat, row = flat[flat < value], row[flat < value]
    found, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(n > 1) - 1
    use = n[at] > 1
    bit, row = place[at][use], row[use]
    out = np.zeros((len(posted), max(1, -(-int((n > 1).sum()) // 64))), np.uint64)
    np.bitwise_or.at(out, (row, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


def _near_in_size(n: np.ndarray, x: int, ys: np.ndarray, threshold: float) -> np.ndarray:
    return np.minimum(n[ys], n[x]) >= threshold * np.maximum(n[ys], n[x])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as dicts; lists are views of the batch's numbers, not Python lists."""
    for b in batches:
        columns = []
        for c in b.columns:
            if pa.types.is_list(c.type):
                flat, at = c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()
                columns.append([flat[x:y] for x, y in zip(at[:-1], at[1:], strict=True)])
            else:
                columns.append(c.to_pylist())
        for row in zip(*columns, strict=True):
            yield dict(zip(b.schema.names, row, strict=True))


def _lists(threshold: float, k: int, want: int):
    """Pairs of an inverted list that may be linked; each pair only in the list of its first common posted value."""

    def flush(value: int, rows: list[dict]) -> Iterator[tuple[int, int]]:
        ids = np.array([r["doc"] for r in rows])
        n = np.array([r["n"] for r in rows])
        sigs = [np.array(r["sig"], np.int64).view(np.uint64) for r in rows]
        before = _earlier([np.array(r["posted"], np.int64) for r in rows], value)
        for x in range(len(rows) - 1):
            ys = np.arange(x + 1, len(rows))
            ys = ys[_near_in_size(n, x, ys, threshold) & (ids[ys] != ids[x])]
            ys = ys[~(before[ys] & before[x]).any(axis=1)]
            for y in ys:
                if _may_link(sigs[x], sigs[y], threshold, k, want):
                    yield min(ids[x], ids[y]), max(ids[x], ids[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, rows, out = None, [], []
        for r in _rows(batches):
            if r["value"] != value:
                out += flush(value, rows) if len(rows) > 1 else ()
                value, rows = r["value"], []
                if len(out) > 20_000:
                    yield _pairs(out)
                    out = []
            rows.append(r)
        out += flush(value, rows) if len(rows) > 1 else ()
        yield _pairs(out)

    return run


def _pairs(out: list) -> pa.RecordBatch:
    a = np.array(out, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["src", "dst"])


def _linked(a: np.ndarray, b: np.ndarray, per_cent: int) -> bool:
    if per_cent * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= per_cent * (len(a) + len(b) - common) > 0


def _verify(width: int, per_cent: int):
    """Rows (a, b, text) sorted by a; the row of a itself has a null b and comes first.  Yields the true links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, out = None, [], []
        for batch in batches:
            for a, b, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingle_sets(batch.column(2), width), strict=True):
                if a != key:
                    key, own = a, []
                if b is None:
                    own.append(s)
                elif any(_linked(s, x, per_cent) for x in own):
                    out.append((a, b))
            yield _pairs(out)
            out = []

    return run


def _blocks(threshold: float, per_cent: int):
    """Links within one block pair of a hot list; pairs that are already connected in the block need no second proof."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for r in _rows(batches):
            if (now := (r["value"], r["i"], r["j"])) != key:
                if len(rows) > 1:
                    yield _pairs(flush(key, rows))
                key, rows = now, []
            rows.append(r)
        if len(rows) > 1:
            yield _pairs(flush(key, rows))

    def flush(key: tuple, rows: list[dict]) -> list:
        value, i, j = key
        ids = np.array([r["doc"] for r in rows])
        sets = [np.array(r["shingles"], np.int64).view(np.uint64) for r in rows]
        n = np.array([len(s) for s in sets])
        before = _earlier([np.array(r["posted"], np.int64) for r in rows], value)
        side = np.array([r["block"] for r in rows])
        _, group = np.unique(ids, return_inverse=True)  # connected in this block
        out = []
        for x in range(len(rows) - 1):
            ys = np.arange(x + 1, len(rows))
            if i != j:
                ys = ys[side[ys] != side[x]]
            ys = ys[_near_in_size(n, x, ys, threshold) & (group[ys] != group[x])]
            ys = ys[~(before[ys] & before[x]).any(axis=1)]
            if not len(ys):
                continue
            flat = np.concatenate([sets[y] for y in ys])
            where = np.minimum(np.searchsorted(sets[x], flat), n[x] - 1)
            common = np.add.reduceat((sets[x][where] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(n[ys])[:-1]]))
            for y in ys[100 * common >= per_cent * (n[x] + n[ys] - common)]:
                if group[y] != group[x]:
                    group[group == group[y]] = group[x]
                    out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        return out

    return run


def near_duplicates(docs: DataFrame, *, width: int = 3, per_cent: int = 85, k: int = K, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``; links have ``per_cent`` Jaccard or more."""
    threshold, want = per_cent / 100, _wanted(per_cent / 100, k)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # One scan makes all sketches; they are far smaller than the texts and are read several times.
    sketches = save(texts.mapInArrow(_sketches(width, k), _SKETCH), "sketches")
    filled = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["n_shingles", "fp1", "fp2"]
    classes = save(filled.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members")), "classes")
    # Dealt by doc_id too, so the copies of a class don't meet in one task.
    first = classes.select(F.col("rep").alias("doc_id"), *same)
    reps = save(filled.join(first, ["doc_id", *same], "left_semi").select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "sig").dropDuplicates(["doc", "n", "sig"]), "reps")

    # Rarest first: a value seen once can't make a pair, but takes a place in the prefix.
    values = reps.select("doc", "n", F.size("sig").alias("kept"), F.explode("sig").alias("value"))
    often = values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    short = F.array(*[F.lit(_needed(n, per_cent, k)) for n in range(1, k + 1)])
    need = F.when(F.col("n") > k, F.lit(want)).otherwise(F.element_at(short, F.least("n", F.lit(k)).cast("int")))
    ordered = values.join(often, "value").groupBy("doc", "n", "kept").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("v"))
    chosen = ordered.select("doc", "n", F.col("v"), (F.col("kept") - need + 1 - (F.col("kept") - F.size("v"))).alias("take")).filter("take > 0")
    chosen = chosen.select("doc", "n", F.slice("v", 1, F.col("take")).alias("v"))
    chosen = save(chosen.join(reps, ["doc", "n"]).select("doc", "n", "sig", F.filter("v", lambda x: x["df"] <= hot)["value"].alias("posted"), F.filter("v", lambda x: x["df"] > hot).alias("heavy")), "posted")

    lists = chosen.filter(F.size("posted") > 0).select(F.explode("posted").alias("value"), "doc", "n", "sig", "posted")
    pairs = lists.repartition("value").sortWithinPartitions("value", "doc").mapInArrow(_lists(threshold, k, want), "src long, dst long")
    pairs = save(pairs.distinct(), "pairs")
    asked = pairs.select(F.col("src").alias("a"), F.lit(None).cast("long").alias("b"), F.col("src").alias("doc_id")).distinct().union(pairs.select("src", "dst", F.col("dst")))
    links = asked.join(texts, "doc_id").select("a", "b", "text").repartition("a").sortWithinPartitions("a", "b").mapInArrow(_verify(width, per_cent), "src long, dst long")

    heavy = chosen.filter(F.size("heavy") > 0).select("doc", F.col("heavy"), F.col("heavy")["value"].alias("posted"))
    if heavy.limit(1).count():
        sets = heavy.select(F.col("doc").alias("doc_id")).distinct().join(texts, "doc_id").mapInArrow(_sketches(width, 1 << 30), _SKETCH).select(F.col("doc_id").alias("doc"), F.col("sig").alias("shingles"))
        # The blocks of a list follow from its length, so a block pair is bounded whatever the list.
        cut = heavy.select("doc", "posted", F.explode("heavy").alias("h")).select("doc", "posted", F.col("h.value").alias("value"), F.ceil(F.col("h.df") / block).cast("int").alias("blocks"))
        cut = cut.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
        cut = cut.select("doc", "posted", "value", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
        cut = cut.select("doc", "posted", "value", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        tasks = cut.join(sets, "doc").repartition("value", "i", "j").sortWithinPartitions("value", "i", "j", "doc")
        links = links.union(tasks.mapInArrow(_blocks(threshold, per_cent), "src long, dst long"))

    components = connected_components(links, "src", "dst").withColumnRenamed("node", "rep")
    # What a class of several members comes to is looked up.  Large classes are there ``SPREAD`` times, and every row
    # asks for one of these, so copies spread; the rest then asks for the small classes.
    told = classes.join(components, "rep", "left").select(*same, "members", F.coalesce("component", "rep").alias("c"))
    large = told.filter(F.col("members") > LARGE).select(*[F.col(x).alias(f"l_{x}") for x in same], F.col("c").alias("of_large"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("l_part"))
    small = told.filter(F.col("members") <= LARGE).select(*[F.col(x).alias(f"s_{x}") for x in same], F.col("c").alias("of_small"), F.lit(0).alias("s_part"))
    rows = sketches.select("doc_id", *same, F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.pmod(F.xxhash64("doc_id"), F.lit(SPREAD)).cast("int")).alias("part"))
    by = lambda side, part: [F.col(x) == F.col(f"{side}_{x}") for x in same] + [part == F.col(f"{side}_part")]
    rows = rows.join(large, by("l", F.col("part")), "left").select("doc_id", *same, "part", "of_large")
    # Rows that are settled ask for part 1 and up, where no small class is.
    ask = F.when(F.col("of_large").isNull(), F.lit(0)).otherwise(F.col("part") + 1)
    rows = rows.withColumn("ask", F.when(F.col("part").isNotNull(), ask)).join(small, by("s", F.col("ask")), "left")
    out = rows.select("doc_id", "n_shingles", F.coalesce("of_large", "of_small", "doc_id").alias("component_id"))
    for t in (reps, chosen, pairs):
        drop(t)
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
