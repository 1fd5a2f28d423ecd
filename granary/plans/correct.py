"""Approved corrections: guarded edits with receipts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.operators.diff import table_digest


@dataclass(frozen=True)
class Guards:
    """Five guards narrow the rows, five refuse the run."""

    where: Column | None = None
    only_null: bool = False
    only_value: object = None
    only_orphans: tuple[DataFrame, str] | None = None
    source_not_null: bool = True
    expected: int | None = None
    at_most: int | None = None
    least_coverage: float | None = None
    not_sentinel: object = None
    inbound: tuple[DataFrame, str] | None = None


class Refused(ValueError):
    """A guard refused the correction; nothing was changed."""


def _marked(df: DataFrame, column: str, new: Column, g: Guards) -> DataFrame:
    """Adds ``_matched`` and ``_new``."""
    hit = F.lit(True)
    if g.where is not None:
        hit = hit & F.coalesce(g.where, F.lit(False))
    if g.only_null:
        hit = hit & F.col(column).isNull()
    if g.only_value is not None:
        hit = hit & F.coalesce(F.col(column) == F.lit(g.only_value), F.lit(False))
    if g.only_orphans is not None:
        parent, key = g.only_orphans
        df = df.join(parent.select(F.col(key).alias("_p")).distinct(), F.col(column) == F.col("_p"), "left")
        hit = hit & F.col(column).isNotNull() & F.col("_p").isNull()
    if g.source_not_null:
        hit = hit & new.isNotNull()
    return df.withColumn("_new", new).withColumn("_matched", hit)


def correction_guards(marked: DataFrame, g: Guards) -> DataFrame:
    """(guard, ok, measured) of the guards that can refuse, evaluated before any write; the key is the first column."""
    row = marked.agg(F.count(F.lit(1)).alias("n"), F.count_if("_matched").alias("hit"), F.count_if(F.col("_matched") & (F.col("_new").eqNullSafe(F.lit(g.not_sentinel)) if g.not_sentinel is not None else F.lit(False))).alias("sentinel")).first()
    found = []
    if g.expected is not None:
        found.append(("expected_count", row.hit == g.expected, float(row.hit)))
    if g.at_most is not None:
        found.append(("at_most", row.hit <= g.at_most, float(row.hit)))
    if g.least_coverage is not None:
        share = row.hit / row.n if row.n else 1.0
        found.append(("coverage", share >= g.least_coverage, share))
    if g.not_sentinel is not None:
        found.append(("sentinel", row.sentinel == 0, float(row.sentinel)))
    if g.inbound is not None:
        child, fk = g.inbound
        n = child.join(marked.filter("_matched").select(F.col(marked.columns[0]).alias(fk)), fk, "left_semi").count()
        found.append(("inbound_references", n == 0, float(n)))
    return marked.sparkSession.createDataFrame(found, "guard string, ok boolean, measured double")


def _apply(df: DataFrame, key: str, column: str, new: Column, g: Guards, extra: list[str]) -> tuple[DataFrame, DataFrame]:
    marked = _marked(df, column, new, g)
    bad = [r.guard for r in correction_guards(marked.select(key, *[c for c in marked.columns if c != key]), g).collect() if not r.ok]
    if bad:
        raise Refused(", ".join(bad))
    kept = [c for c in df.columns if c not in extra]
    after = marked.select(*[F.when(F.col("_matched"), F.col("_new")).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in kept])
    changes = marked.filter(F.col("_matched") & ~F.col("_new").eqNullSafe(F.col(column))).select(F.col(key).alias("key"), F.lit(column).alias("column"), F.col(column).cast("string").alias("before"), F.col("_new").cast("string").alias("after"))
    return after, changes


def correct_same_row(df: DataFrame, key: str, column: str, source: str, guards: Guards = Guards()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """Fill a cell from another of its row; second: the row changes (key, column, before, after)."""
    return _apply(df, key, column, F.col(source).cast(dict(df.dtypes)[column]), guards, [])


def correct_from_parent(df: DataFrame, key: str, column: str, fk: str, parent: DataFrame, parent_key: str, parent_column: str, guards: Guards = Guards()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """Fill a cell from the row its reference names."""
    p = parent.select(F.col(parent_key).alias("_pk"), F.col(parent_column).alias("_pv"))
    return _apply(df.join(p, F.col(fk) == F.col("_pk"), "left"), key, column, F.col("_pv").cast(dict(df.dtypes)[column]), guards, ["_pk", "_pv"])


def correct_constant(df: DataFrame, key: str, column: str, value, guards: Guards = Guards(), exists_in: tuple[DataFrame, str] | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """Fill with a literal, which must be a key of ``exists_in`` if that is given."""
    if exists_in is not None and not exists_in[0].filter(F.col(exists_in[1]) == F.lit(value)).limit(1).count():
        raise Refused("constant_exists")
    return _apply(df, key, column, F.lit(value).cast(dict(df.dtypes)[column]), guards, [])


def correct_exclude(df: DataFrame, key: str, where: Column, inbound: list[tuple[DataFrame, str]] = []) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """Remove rows; refused while a retained row references one of them."""
    gone = df.filter(F.coalesce(where, F.lit(False)))
    for child, fk in inbound:
        if child.join(gone.select(F.col(key).alias(fk)), fk, "left_semi").limit(1).count():
            raise Refused("inbound_references")
    return df.filter(~F.coalesce(where, F.lit(False))), gone.select(F.col(key).alias("key"))


def correction_receipt(before: DataFrame, after: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows before and after, changed rows and both digests; a replay with the same receipt did the same."""
    a = table_digest(before).select(F.col("n_rows").alias("n_before"), F.col("digest").alias("digest_before"))
    b = table_digest(after).select(F.col("n_rows").alias("n_after"), F.col("digest").alias("digest_after"))
    return a.join(b).join(changes.agg(F.count(F.lit(1)).alias("n_changed"))).withColumn("n_excluded", F.col("n_before") - F.col("n_after"))
