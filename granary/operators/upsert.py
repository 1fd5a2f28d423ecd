"""Upserts and load planning over frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.contract import Contract
from granary.operators.diff import _sides, drift_guard
from granary.operators.reconcile import numbered


def _once(source: DataFrame, key: list[str]) -> DataFrame:
    """The source, whose rows raise an error where a key without NULL comes more than once.

    The keys alone are counted, in a subquery of their own, so the rows go straight to the join.
    """
    named = F.concat_ws(",", *[F.col(k).cast("string") for k in key])
    twice = source.select(*key).dropna().groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").agg(F.min(named).alias("_twice"))
    told = F.raise_error(F.concat(F.lit("the source has a key more than once: "), twice.scalar()))
    return source.filter(F.when(twice.scalar().isNotNull(), told).otherwise(F.lit(True)))


def merge_upsert(target: DataFrame, source: DataFrame, key: list[str], *, deferred: tuple[str, ...] = (), delete_scope: Column | None = None, insert: bool = True) -> DataFrame:
    """The target after the merge, with ``action``: insert, update, delete or keep.

    A matched row is updated only when a cell differs, so a second run changes nothing.  Deferred columns of matched
    rows stay as they are, those of inserted rows are NULL.  Unmatched target rows are deleted only inside
    ``delete_scope``, a condition on target columns; deleted rows stay in the result, marked.  A key that the source has
    twice is refused when the result is read.
    """
    rest = [c for c in target.columns if c not in key]
    marked = target if delete_scope is None else target.withColumn("_in_scope", F.coalesce(delete_scope, F.lit(False)))
    both = _sides(marked, _once(source, key), key)
    live = [c for c in rest if c not in deferred]
    differs = F.lit(False)
    for c in live:
        differs = differs | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    scope = F.lit(False) if delete_scope is None else F.col("a__in_scope")
    action = F.when(F.col("in_a").isNull(), "insert" if insert else "skip").when(F.col("in_b").isNull(), F.when(scope, "delete").otherwise("keep")).when(differs, "update").otherwise("keep")
    cell = lambda c: F.when(F.col("in_b").isNull(), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")) if c in live else F.col(f"a_{c}")
    out = both.select(*[F.coalesce(f"a_{k}", f"b_{k}").alias(k) if c in key else cell(c).alias(c) for c in target.columns for k in [c]], action.alias("action"))
    return out.filter("action <> 'skip'")


def merge_delete_scope(target: DataFrame, source: DataFrame, key: list[str], scope: Column) -> DataFrame:
    return merge_upsert(target, source, key, delete_scope=scope)


def align_by_business_key(target: DataFrame, source: DataFrame, surrogate: str, business: list[str]) -> DataFrame:
    """Upsert on the business key: the surrogate of a match is kept, new rows get keys after the largest; no deletes."""
    rest = [c for c in target.columns if c not in (surrogate, *business)]
    merged = merge_upsert(target.select(*business, surrogate, *rest), source.select(*business, F.lit(None).cast(dict(target.dtypes)[surrogate]).alias(surrogate), *rest), business, deferred=(surrogate,))
    top = target.agg(F.coalesce(F.max(surrogate), F.lit(0)).alias("_top"))
    new = numbered(merged.filter("action = 'insert'").drop(surrogate), business, "_row").withColumn(surrogate, top.scalar() + F.col("_row")).drop("_row")
    return merged.filter("action <> 'insert'").unionByName(new.withColumn(surrogate, F.col(surrogate).cast(dict(target.dtypes)[surrogate])))


def sync_modes(target: DataFrame, source: DataFrame, key: list[str], mode: str) -> DataFrame:
    """``non_destructive``, ``validate_then_apply`` (refuses when the target drifted) or ``authoritative`` (deletes)."""
    if mode == "validate_then_apply" and drift_guard(source, target).limit(1).count():
        raise ValueError("the target drifted from the seed")
    return merge_upsert(target, source, key, delete_scope=F.lit(True) if mode == "authoritative" else None)


def change_volume(merged: DataFrame) -> DataFrame:
    return merged.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def two_phase_load(contract: Contract, tables: dict[str, DataFrame], nullable: set[str]) -> tuple[list[str], dict[str, DataFrame], list[str]]:
    """For cyclic references: load order, first-phase frames with deferred columns NULL, and cycles that stay."""
    order, seen, first, stuck = [t for level in contract.levels() for t in level], set(), {}, []
    for name in order:
        df = tables[name]
        for r in contract.of(name):
            if r.parent not in seen:
                if r.name in nullable:
                    kinds = dict(df.dtypes)
                    df = df.withColumns({c: F.lit(None).cast(kinds[c]) for c in r.columns})
                elif r.parent != name:
                    stuck.append(r.name)
        first[name] = df
        seen.add(name)
    return order, first, stuck


def load_cycles(contract: Contract, nullable: set[str]) -> list[tuple[list[str], str, list[str]]]:
    """Per cycle of tables: (members, Resolved or Refused, references).

    Resolved: the references that can be NULL at first, without which the members have an order.  Refused: references of
    a cycle on which none can be NULL; one of them has to be made so.  A table that refers to itself is a cycle of one.
    """
    reach = {t: _reached(contract, t, set()) for t in contract.tables}
    out = []
    for t in contract.tables:
        members = [u for u in contract.tables if u in reach[t] and t in reach[u]]
        if t not in reach[t] or members[0] != t:
            continue
        inside = [r for r in contract.references if r.child in members and r.parent in members]
        strong = Contract({u: contract.tables[u] for u in members}, tuple(r for r in inside if r.name not in nullable))
        stuck = [r.name for r in strong.references if r.child in _reached(strong, r.parent, set()) | {r.parent}]
        out.append((members, "Refused", stuck) if stuck else (members, "Resolved", [r.name for r in inside if r.name in nullable]))
    return out


def _reached(contract: Contract, table: str, seen: set[str]) -> set[str]:
    """Tables that a table refers to, directly or not."""
    for r in contract.of(table):
        if r.parent not in seen:
            seen.add(r.parent)
            _reached(contract, r.parent, seen)
    return seen


def repoint(loaded: DataFrame, original: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Second phase: deferred references from the original rows, by key."""
    o = original.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    out = loaded.join(o, F.col(key) == F.col("_k"), "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_o_{c}", F.col(c)))
    return out.drop("_k", *[f"_o_{c}" for c in columns])


def revert_set(df: DataFrame, key: str, minted: DataFrame) -> DataFrame:
    """The table without exactly the keys (assigned_key) that a load minted."""
    return df.join(minted.select(F.col("assigned_key").alias(key)), key, "left_anti")


def revert_sequence(contract: Contract, tables: dict[str, DataFrame], minted: dict[str, DataFrame]) -> tuple[list[tuple[str, DataFrame]], DataFrame]:
    """What to remove, children first, as (table, its keys to remove); and what forbids it: (reference, n_rows).

    Removed are the minted keys (assigned_key) that a table still has.  A row that stays and points at a removed one forbids the
    whole: rows (reference, n_rows) say how many do.  Tables on a cycle of references stand together.
    """
    order = [t for level in reversed(contract.levels()) for t in level if t in minted]
    gone = {t: tables[t].select(contract.tables[t].key[0]).join(minted[t].select(F.col("assigned_key").alias(contract.tables[t].key[0])), contract.tables[t].key[0], "left_semi").distinct() for t in order}
    held = None
    for t in order:
        for r in contract.into(t):
            if r.child not in tables:
                continue
            kept = revert_set(tables[r.child], contract.tables[r.child].key[0], minted[r.child]) if r.child in gone else tables[r.child]
            lost = tables[t].join(gone[t], list(contract.tables[t].key[:1]), "left_semi").select(*[F.col(k).alias(f"_p_{i}") for i, k in enumerate(r.keys)])
            on = [F.col(c) == F.col(f"_p_{i}") for i, c in enumerate(r.columns)]
            part = kept.join(lost, on, "left_semi").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(r.name).alias("reference"), "n_rows")
            held = part if held is None else held.unionByName(part)
    if held is None:
        held = next(iter(tables.values())).sparkSession.createDataFrame([], "reference string, n_rows long")
    return [(t, gone[t]) for t in order], held.filter("n_rows > 0")


def revert_load(contract: Contract, tables: dict[str, DataFrame], minted: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without what a load minted; refused where a row that stays would lose its parent."""
    sequence, held = revert_sequence(contract, tables, minted)
    if found := held.limit(10).collect():
        raise ValueError("rows that stay point at rows to remove: " + ", ".join(f"{r.reference} ({r.n_rows})" for r in found))
    return tables | {t: tables[t].join(keys, contract.tables[t].key[0], "left_anti") for t, keys in sequence}
