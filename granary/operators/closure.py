"""Referential closure and dataset slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.contract import Contract
from granary.functions.scratch import compact, drop, save, union
from granary.operators.upsert import merge_upsert


def referential_closure(contract: Contract, tables: dict[str, DataFrame], roots: dict[str, DataFrame], stop: set[str] = frozenset()) -> dict[str, DataFrame]:
    """Per table the keys (all key columns) of all rows that the root rows need.

    Each round takes the parents referenced by rows that are new, less those already held; keys are distinct, so
    cycles end, and the work goes on until nothing is new, however long the chains.  References named in ``stop`` aren't
    followed; one with a NULL column names nothing.  Key tables are written every round.  Tables without a key can be
    roots only.
    """
    key = {t: list(contract.tables[t].key) for t in tables}
    held: dict[str, list[DataFrame]] = {}
    rows = dict(roots)
    for t, df in roots.items():
        if key[t]:
            held[t] = [save(df.select(*key[t]).dropna().distinct(), "closure")]
            rows[t] = tables[t].join(held[t][0], key[t], "left_semi")
    while rows:
        asked: dict[str, list[DataFrame]] = {}
        for child, part in rows.items():
            for r in contract.of(child):
                if r.name in stop or r.parent not in tables:
                    continue
                kinds = dict(tables[r.parent].dtypes)
                values = part.select(*[F.col(c).cast(kinds[k]).alias(k) for c, k in zip(r.columns, r.keys, strict=True)]).dropna().distinct()
                asked.setdefault(r.parent, []).append(tables[r.parent].join(values, list(r.keys), "left_semi").select(*key[r.parent]))
        rows = {}
        for parent, found in asked.items():
            fresh = union(found).distinct()
            if parent in held:
                fresh = fresh.join(union(held[parent]), key[parent], "left_anti")
            fresh = save(fresh, "closure")
            if not fresh.limit(1).count():
                drop(fresh)
                continue
            held[parent] = [*compact(held.get(parent, []), "closure"), fresh]
            rows[parent] = tables[parent].join(fresh, key[parent], "left_semi")
    return {t: union(parts) for t, parts in held.items()}


def closed_rows(contract: Contract, tables: dict[str, DataFrame], held: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {t: tables[t].join(k, list(contract.tables[t].key), "left_semi") for t, k in held.items()}


def closure_report(contract: Contract, rows: dict[str, DataFrame], mandatory: set[str]) -> DataFrame:
    """(kind, name, n): rows per table, and distinct mandatory references without their parent."""
    out = None
    for t, df in rows.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("rows").alias("kind"), F.lit(t).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
        for r in contract.of(t):
            if r.name in mandatory:
                values = df.select(*[F.col(c).alias(k) for c, k in zip(r.columns, r.keys, strict=True)]).dropna().distinct()
                if r.parent in rows:
                    values = values.join(rows[r.parent].select(*r.keys), list(r.keys), "left_anti")
                out = out.unionByName(values.agg(F.count(F.lit(1)).alias("n")).select(F.lit("dangling").alias("kind"), F.lit(r.name).alias("name"), "n"))
    return out


def referenced_pull(contract: Contract, tables: dict[str, DataFrame], exported: set[str], stop: set[str] = frozenset()) -> dict[str, DataFrame]:
    """Rows outside the exported tables that their rows reference, directly or not."""
    held = referential_closure(contract, tables, {t: tables[t] for t in exported}, stop)
    return {t: df for t, df in closed_rows(contract, tables, held).items() if t not in exported}


def write_slice(rows: dict[str, DataFrame], folder: str) -> None:
    for t, df in rows.items():
        df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")


def apply_slice(spark: SparkSession, contract: Contract, folder: str, targets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The targets after an upsert of a written slice, parents first."""
    return {t: merge_upsert(targets[t], spark.read.parquet(f"{folder}/{t}.parquet"), list(contract.tables[t].key)) for level in contract.levels() for t in level if t in targets}
