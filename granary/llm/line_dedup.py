"""Line deduplication with levelled sorted runs of line hashes, in DataFrame operations only.

A line's key is the line without white space at both ends, A-Z as a-z; keys under ``least_chars`` code points are left
alone.  One scan hashes the keys (128 bits).  Batches of documents follow in descending doc_id: each batch is
aggregated to one row per key, merge-anti-joined with the runs so far, and written as a sorted run of its own.  A key
that no run holds is fresh, so its keeper, the largest doc_id that has it, lies in this batch; a key that a run holds
adds its count only.  ``FAN`` runs of a level are compacted into one of the next.  The last run has the number of
documents and the keeper of every key; keys in ``least_docs`` documents or more lose their lines elsewhere.

Counts are pre-aggregated before each shuffle, so a key in a third of all documents is one row per task there.  Lines
are joined with the repeated keys without their text, and each text is shuffled once, by document.

Defined results: a null text is one empty line; a document counts once per key however often it has the line or the
row; equal rows of a doc_id get equal results; a row with a null doc_id is neither counted nor changed; a text that
loses all lines is empty; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.scratch import drop, save

SPACE = " \t\n\x0b\f\r"
#: Batches at least, and lines in one at most (about): a larger corpus has more batches.
BATCHES, BATCH_LINES = 4, 2_000_000_000
FAN = 2
_H = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _row_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _keys(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, row_hash, pos, h1, h2) of every line that can be a repeat."""
    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), _row_hash(F.col("text")).alias("row_hash"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    # A key is never longer than its line, so short lines go before the costlier test.
    rows = rows.filter(F.length("line") >= least_chars).select("doc_id", "row_hash", "pos", line_key(F.col("line")).alias("key"))
    return rows.filter(F.length("key") >= least_chars).select("doc_id", "row_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def _run(df: DataFrame) -> DataFrame:
    """Write a sorted run."""
    return save(df.sortWithinPartitions(*_H), "run")


def _compact(runs: list[DataFrame]) -> DataFrame:
    every = runs[0]
    for r in runs[1:]:
        every = every.unionByName(r)
    out = _run(every.groupBy(*_H).agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper")))
    for r in runs:
        drop(r)
    return out


class LevelledRuns:
    """Sorted runs of (h1, h2, n_docs, keeper) by level."""

    def __init__(self, fan: int = FAN) -> None:
        self.fan, self.levels = fan, [[]]  # type: ignore[var-annotated]

    def add(self, batch: DataFrame) -> None:
        """Add a batch of one row (h1, h2, n_docs, last) per key; batches come in descending order of doc_id."""
        fresh = repeated = batch
        runs = [r for level in self.levels for r in level]
        known = None
        for r in runs:
            fresh = fresh.join(r.select(*_H).hint("merge"), _H, "left_anti")
            known = r.select(*_H) if known is None else known.unionByName(r.select(*_H))
        out = fresh.select(*_H, "n_docs", F.col("last").alias("keeper"))
        if known is not None:
            repeated = repeated.join(known.hint("merge"), _H, "left_semi").select(*_H, "n_docs", F.lit(None).cast("long").alias("keeper"))
            out = out.unionByName(repeated)
        self.levels[0].append(_run(out))
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fan:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(_compact(self.levels[k]))
                self.levels[k] = []

    def all(self) -> DataFrame:
        runs = [r for level in self.levels for r in level]
        return runs[0] if len(runs) == 1 else _compact(runs)


def dedup_lines(docs: DataFrame, *, least_chars: int = 20, least_docs: int = 3, batches: int | None = None, fan: int = FAN) -> DataFrame:
    """``docs`` with the text that is left, and n_lines (before) and n_dropped, which replace columns so named."""
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    docs = docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in names]).alias("rest") if names else F.lit(None).alias("rest"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = save(_keys(docs, least_chars), "line-keys")
    runs = LevelledRuns(fan)
    if batches is None:
        batches = max(BATCHES, -(-keys.count() // BATCH_LINES))
    # Cuts at approximate quantiles: where they fall changes no result, and an outlying doc_id doesn't fill a batch.
    cuts = sorted(set(keys.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01)), reverse=True) if batches > 1 else []
    edges = [None, *(int(c) for c in dict.fromkeys(cuts)), None]
    for upper, lower in zip(edges[:-1], edges[1:], strict=True):
        part = keys
        if upper is not None:
            part = part.filter(F.col("doc_id") < upper)
        if lower is not None:
            part = part.filter(F.col("doc_id") >= lower)
        runs.add(part.select("doc_id", *_H).distinct().groupBy(*_H).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last")))
    repeats = runs.all().filter(F.col("n_docs") >= least_docs).select(*_H, "keeper")
    lost = keys.join(repeats.hint("merge"), _H).filter("doc_id <> keeper")
    lost = lost.groupBy(F.col("doc_id").alias("lost_doc"), F.col("row_hash").alias("lost_row")).agg(F.sort_array(F.collect_set("pos")).alias("lost"))
    on = (F.col("doc_id") == F.col("lost_doc")) & (_row_hash(F.col("text")) == F.col("lost_row"))
    joined = docs.join(lost, on, "left").withColumn("all_lines", _lines(F.col("text")))
    joined = joined.withColumn("cuts", F.concat(F.array(F.lit(-1)), F.coalesce("lost", F.array().cast("array<int>")), F.array(F.size("all_lines"))))
    piece = lambda j: F.slice("all_lines", F.get("cuts", j) + 2, F.get("cuts", j + 1) - F.get("cuts", j) - 1)
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), piece))
    left = F.when(F.size("cuts") == 2, F.coalesce(F.col("text").cast("string"), F.lit(""))).otherwise(F.array_join(kept, "\n"))
    out = F.struct(left.alias("text"), F.size("all_lines").cast("long").alias("n_lines"), (F.size("cuts") - 2).cast("long").alias("n_dropped"))
    return joined.select("rest", out.alias("out")).select(*[F.col("rest")[c].alias(c) for c in names], *[F.col("out")[c].alias(c) for c in ("text", "n_lines", "n_dropped")])
