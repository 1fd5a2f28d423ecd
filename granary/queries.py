"""Registered queries: every operator over the given tables, with the SQL that gives the same rows where there is one.

The tables are clean, so faults are made by expression: keys are shifted, cells are emptied where a key divides by a
number, parents are filtered.  Both sides make the same faults.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.contract import STAR, Reference, read_table
from granary.functions import cells
from granary.operators import closure, diff, graph, profile, reconcile, synth, upsert
from granary.operators.components import connected_components
from granary.plans import correct, decide
from granary.sources import tables as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__.removeprefix("q_")] = f
        if sql:
            SQL[f.__name__.removeprefix("q_")] = sql
        return f

    return add


def T(s: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(s, d, name)


def tables(s, d, *names) -> dict[str, DataFrame]:
    return {n: T(s, d, n) for n in names}


REF = {r.name: r for r in STAR.references}
ORD = REF["orders.o_custkey"]


def faulty_customers(s, d) -> DataFrame:
    """Customers with some names and balances NULL."""
    return T(s, d, "customer").withColumn("c_name", F.when(F.col("c_custkey") % 89 != 0, F.col("c_name"))).withColumn("c_acctbal", F.when(F.col("c_custkey") % 97 != 0, F.col("c_acctbal")))


FAULTY = "(SELECT c_custkey, CASE WHEN c_custkey % 89 <> 0 THEN c_name END AS c_name, c_nationkey, CASE WHEN c_custkey % 97 <> 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer)"
some_customers = lambda s, d: T(s, d, "customer").filter("c_custkey % 97 <> 0")
edited_orders = lambda s, d: T(s, d, "orders").filter("o_orderkey % 97 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 89 == 0, "X").otherwise(F.col("o_orderstatus")))
EDITED = "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 89 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 97 <> 0)"
OCOLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
CCOLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


# -- 2.1 sources ----------------------------------------------------------------------------------------------------
@query("SELECT * FROM orders")
def q_read_table(s, d):
    return T(s, d, "orders")


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS n_rows FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100)")
def q_capped_scan(s, d):
    rows, n = src.capped_scan(T(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 100)
    return rows.join(F.broadcast(n))


@query("SELECT c_custkey FROM (SELECT c_custkey FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 100)")
def q_threshold_sample(s, d):
    return src.threshold_sample(T(s, d, "customer").select("c_custkey"), "c_custkey", 50, 100, 1000)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def q_keyed_fetch(s, d):
    return src.keyed_fetch(T(s, d, "orders"), "o_custkey", T(s, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING','MACHINERY') AND c_nationkey IS NOT NULL AND c_acctbal > 0")
def q_predicate_fetch(s, d):
    p = cells.all_of(cells.is_in("c_mktsegment", ["BUILDING", "MACHINERY"]), F.col("c_nationkey").isNotNull(), cells.raw("c_acctbal > 0"))
    return src.predicate_fetch(T(s, d, "customer"), p).select("c_custkey")


@query("SELECT 'customer' AS \"table\", 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS columns, count(*) AS n_rows, 'declared' AS provenance FROM customer UNION ALL SELECT 'nation', 'n_nationkey,n_name,n_regionkey', count(*), 'referenced' FROM nation")
def q_export_manifest(s, d):
    return src.export_manifest(tables(s, d, "customer", "nation"), {"customer"})


# -- 2.2 expressions ------------------------------------------------------------------------------------------------
@query("SELECT p_partkey AS id, p_name AS label FROM part")
def q_align_names(s, d):
    return cells.align_names(T(s, d, "part").select("p_partkey", "p_name"), {"p_partkey": "id", "p_name": "label"})


@query("SELECT o_totalprice, o_orderkey FROM orders")
def q_writable_projection(s, d):
    return cells.writable_projection(T(s, d, "orders"), ["o_totalprice", "o_orderkey", "o_custkey"], ["o_custkey"])


@query(f"SELECT c_custkey, c_name FROM {FAULTY}")
def q_canonical_order(s, d):
    return cells.canonical_order(faulty_customers(s, d).select("c_custkey", "c_name"), ["c_name"])


#: Orders with prices that are hard to tell apart or to write down, and their text.
PRICE = "CASE WHEN o_orderkey % 101 = 0 THEN 'NaN' WHEN o_orderkey % 103 = 0 THEN '3.0E-7' WHEN o_orderkey % 107 = 0 THEN 'Infinity' WHEN o_orderkey % 109 = 0 THEN '0.0' ELSE CAST(o_totalprice AS VARCHAR) END"


def odd_prices(o: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return o.withColumn("o_totalprice", F.when(k % 101 == 0, float("nan")).when(k % 103 == 0, 3e-7).when(k % 107 == 0, float("inf")).when(k % 109 == 0, 0.0).otherwise(F.col("o_totalprice")))


@query(f"SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate, {PRICE} AS o_totalprice FROM orders")
def q_canonical_text(s, d):
    o = odd_prices(T(s, d, "orders"))
    kind = {f.name: f.dataType for f in o.schema.fields}
    return o.select("o_orderkey", *[cells.canonical_text(c, kind[c]).alias(c) for c in ("o_orderdate", "o_totalprice")])


@query("SELECT event_id, strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%g') AS t FROM events")
def q_truncate_ms(s, d):
    return T(s, d, "events").select("event_id", F.date_format(cells.truncate_ms("ts"), "yyyy-MM-dd HH:mm:ss.SSS").alias("t"))


@query("SELECT c_custkey, lower(rtrim(c_name || '  ')) AS k, trim(CASE WHEN c_custkey % 7 = 0 THEN '  ' ELSE c_name END) <> '' AS is_key FROM customer")
def q_match_key(s, d):
    blank = F.when(F.col("c_custkey") % 7 == 0, "  ").otherwise(F.col("c_name"))
    return T(s, d, "customer").select("c_custkey", cells.match_key(F.concat("c_name", F.lit("  "))).alias("k"), cells.is_key(blank).alias("is_key"))


@query("SELECT c_custkey, NULLIF(CASE WHEN c_custkey % 7 = 0 THEN ' ' ELSE c_name END, ' ') AS v FROM customer")
def q_space_sentinel(s, d):
    return T(s, d, "customer").select("c_custkey", cells.space_sentinel(F.when(F.col("c_custkey") % 7 == 0, " ").otherwise(F.col("c_name"))).alias("v"))


@query("SELECT c_custkey, repeat('*', length(c_name)) AS redact, repeat('*', greatest(length(c_name) - 4, 0)) || right(c_name, 4) AS keep_last, left(c_name, 3) || repeat('*', greatest(length(c_name) - 3, 0)) AS keep_first, substr(sha256(c_name), 1, 8) AS hash FROM customer")
def q_mask(s, d):
    return T(s, d, "customer").select("c_custkey", cells.mask("c_name", "redact").alias("redact"), cells.mask("c_name", "keep_last", 4).alias("keep_last"), cells.mask("c_name", "keep_first", 3).alias("keep_first"), cells.mask("c_name", "hash").alias("hash"))


@query("SELECT c_custkey, CAST(('0x' || substr(md5('7:customer:c_name:' || c_custkey), 1, 15)) AS BIGINT) AS draw FROM customer")
def q_cell_draw(s, d):
    return T(s, d, "customer").select("c_custkey", cells.cell_draw(7, "customer", "c_name", "c_custkey").alias("draw"))


@query("SELECT c_custkey, CASE WHEN CAST(('0x' || substr(md5('7:customer:tier:' || c_custkey), 1, 15)) AS BIGINT) % 10 < 6 THEN 'a' WHEN CAST(('0x' || substr(md5('7:customer:tier:' || c_custkey), 1, 15)) AS BIGINT) % 10 < 9 THEN 'b' ELSE 'c' END AS tier FROM customer")
def q_weighted_pick(s, d):
    return T(s, d, "customer").select("c_custkey", cells.weighted_pick(cells.cell_draw(7, "customer", "tier", "c_custkey"), [("a", 6), ("b", 3), ("c", 1)]).alias("tier"))


@query("SELECT c_custkey, CASE WHEN regexp_matches(c_name, '([0-9]+)') THEN regexp_extract(c_name, '([0-9]+)', 1) END AS digits FROM customer")
def q_regex_extract(s, d):
    return T(s, d, "customer").select("c_custkey", cells.regex_extract("c_name", "([0-9]+)").alias("digits"))


# -- 2.3 profiling --------------------------------------------------------------------------------------------------
def _each(columns, body, source) -> str:
    return " UNION ALL ".join(body.format(c=c, source=source) for c in columns)


@query(_each(CCOLS, "SELECT 'customer' AS \"table\", '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_nulls FROM {source}", FAULTY))
def q_null_counts(s, d):
    return profile.null_counts(faulty_customers(s, d), "customer")


@query(_each(["c_name", "c_mktsegment"], "SELECT 'customer' AS \"table\", '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_nulls, max(length({c})) AS max_length, (count(*) - count({c})) / count(*) AS null_share, count({c}) = 0 AS all_null, count({c}) = count(*) AS zero_null FROM {source}", FAULTY))
def q_column_profile(s, d):
    return profile.column_profile(faulty_customers(s, d), "customer", ["c_name", "c_mktsegment"])


@query(_each(CCOLS, "SELECT 'customer' AS \"table\", '{c}' AS \"column\", count({c}) < count(*) AS has_nulls, count({c}) > count(DISTINCT {c}) AS has_duplicates, '{c}' = 'c_name' AS declared_nullable, false AS present_but_inactive FROM {source}", FAULTY))
def q_attribute_reality(s, d):
    return profile.attribute_reality(faulty_customers(s, d), "customer", {"c_name"})


QUANT = "SELECT '{t}' AS \"table\", '{c}' AS \"column\", count({c}) AS sample_size, CAST(min({c}) AS DOUBLE) AS \"min\", quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, quantile_cont({c}, 0.95) AS p95, quantile_cont({c}, 0.99) AS p99, CAST(max({c}) AS DOUBLE) AS \"max\", round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS stddev, 'Succeeded' AS outcome FROM {s} HAVING count({c}) >= 5"
rounded = lambda df: df.withColumns({c: F.round(c, 4) for c in ("mean", "stddev")})


@query(" UNION ALL ".join(QUANT.format(t="orders", c=c, s="orders") for c in ("o_totalprice",)) + " UNION ALL " + QUANT.format(t="orders", c="CAST(o_custkey AS DOUBLE)", s="orders").replace("'CAST(o_custkey AS DOUBLE)'", "'o_custkey'"))
def q_numeric_distribution(s, d):
    return rounded(profile.numeric_distribution(T(s, d, "orders"), "orders", ["o_totalprice", "o_custkey"]))


@query("SELECT quantile_cont(o_totalprice, 0.9) AS p90 FROM orders")
def q_percentile_cont(s, d):
    return profile.percentile_cont(T(s, d, "orders"), "o_totalprice", 0.9).withColumnRenamed("value", "p90")


@query("SELECT 'orders' AS \"table\", 'o_totalprice' AS \"column\", round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) AS iqr, round(max(o_totalprice) - min(o_totalprice), 4) AS range, round(stddev_pop(o_totalprice) / abs(avg(o_totalprice)), 6) AS cv, max(o_totalprice) = min(o_totalprice) AS degenerate FROM orders")
def q_distribution_shape(s, d):
    out = profile.distribution_shape(profile.numeric_distribution(T(s, d, "orders"), "orders", ["o_totalprice"]))
    return out.withColumns({"iqr": F.round("iqr", 4), "range": F.round("range", 4), "cv": F.round("cv", 6)})


TOPN = "SELECT {head}, {v}, n, rank, n_distinct, n_distinct > {k} AS truncated FROM (SELECT {v}, n, row_number() OVER (ORDER BY n DESC, {o}) AS rank, count(*) OVER () AS n_distinct FROM (SELECT {e}, count(*) AS n FROM {t} GROUP BY ALL)) WHERE rank <= {k}"


@query(TOPN.format(head="'orders' AS \"table\", 'o_orderpriority' AS \"column\"", v="value", o="value", e="o_orderpriority AS value", t="orders", k=50))
def q_categorical_distribution(s, d):
    return profile.categorical_distribution(T(s, d, "orders"), "orders", "o_orderpriority")


@query("SELECT 'documents' AS \"table\", 'text' AS columns, count(*) AS n_duplicate_keys, count(*) > 0 AS has_duplicates FROM (SELECT text FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1)")
def q_unique_candidate(s, d):
    return profile.unique_candidate(T(s, d, "documents"), "documents", ["text"])


@query("SELECT 'lineitem' AS \"table\", 'l_orderkey,l_linenumber' AS columns, count(*) AS n_duplicate_keys, count(*) > 0 AS has_duplicates FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def q_composite_unique_candidate(s, d):
    return profile.composite_unique_candidate(T(s, d, "lineitem"), "lineitem", ["l_orderkey", "l_linenumber"])


ORPHANS = "FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 97 <> 0)"
FK_SQL = " UNION ALL ".join(f"SELECT '{r.name}' AS reference, count(*) AS n_orphans, 'Succeeded' AS outcome FROM {r.child} WHERE {r.column} IS NOT NULL AND {r.column} NOT IN (SELECT {r.key} FROM {r.parent})" for r in STAR.references)


@query(FK_SQL)
def q_fk_reality_all(s, d):
    out = None
    for r in STAR.references:
        part = profile.fk_reality(T(s, d, r.child), r, T(s, d, r.parent))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"SELECT 'orders.o_custkey' AS reference, count(*) AS n_orphans, 'Succeeded' AS outcome {ORPHANS}")
def q_fk_reality(s, d):
    return profile.fk_reality(T(s, d, "orders"), ORD, some_customers(s, d))


@query(f"SELECT 'orders.o_custkey' AS reference, o_custkey AS value, count(*) AS n_rows {ORPHANS} GROUP BY o_custkey ORDER BY o_custkey LIMIT 5")
def q_fk_orphan_sample(s, d):
    return profile.fk_orphan_sample(T(s, d, "orders"), ORD, some_customers(s, d))


@query(f"SELECT c_custkey AS key FROM {FAULTY} WHERE c_name IS NULL ORDER BY 1 LIMIT 10")
def q_null_row_sample(s, d):
    return profile.null_row_sample(faulty_customers(s, d), "c_custkey", "c_name")


@query(QUANT.format(t="orders.o_custkey", c="n", s="(SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1)"))
def q_fk_cardinality(s, d):
    return rounded(profile.fk_cardinality(T(s, d, "orders"), ORD))


@query(TOPN.format(head="'orders.o_custkey' AS reference", v="parent_key", o="parent_key", e="o_custkey AS parent_key", t="orders", k=50))
def q_fk_selectivity(s, d):
    return profile.fk_selectivity(T(s, d, "orders"), ORD)


@query("SELECT l_partkey, l_suppkey, n, rank, n_distinct, n_distinct > 100 AS truncated FROM (SELECT *, row_number() OVER (ORDER BY n DESC, l_partkey, l_suppkey) AS rank, count(*) OVER () AS n_distinct FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE rank <= 100")
def q_joint_distribution(s, d):
    return profile.joint_distribution(T(s, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query("SELECT 'orders.o_custkey' AS reference, o_custkey AS value, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'events.user_id', user_id, count(*) FROM events GROUP BY ALL")
def q_reference_value_counts(s, d):
    return profile.reference_value_counts(tables(s, d, "orders", "events"), [ORD, REF["events.user_id"]])


@query("SELECT CAST(coalesce(sum(CASE WHEN k IS NULL THEN n END), 0) AS BIGINT) AS n_null_keys, count(*) FILTER (k IS NOT NULL AND n > 1) AS n_duplicated_values FROM (SELECT k, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 89 <> 0 THEN o_custkey END AS k FROM orders) GROUP BY 1)")
def q_key_soundness(s, d):
    return profile.key_soundness(T(s, d, "orders").select(F.when(F.col("o_orderkey") % 89 != 0, F.col("o_custkey")).alias("k")), "k")


@query("SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment IS NOT NULL")
def q_distinct_values(s, d):
    return profile.distinct_values(T(s, d, "customer"), "c_mktsegment")


FINGER = "SELECT 'customer' AS \"table\", count(*) AS n_rows, CAST(max(c_custkey) AS VARCHAR) AS max_key, CAST(sum(CAST(('0x' || substr(sha256(concat_ws(chr(30), CELLS)), 1, 15)) AS BIGINT)) AS VARCHAR) AS checksum FROM SOURCE"
_CELLS = {"c_acctbal": "CAST(c_acctbal AS VARCHAR)", "c_custkey": "CAST(c_custkey AS VARCHAR)", "c_mktsegment": "c_mktsegment", "c_name": "c_name", "c_nationkey": "CAST(c_nationkey AS VARCHAR)"}
_JOINED = ", ".join(f"'{c}=' || length({x}) || ':' || {x}" for c, x in _CELLS.items())


@query(FINGER.replace("CELLS", _JOINED).replace("SOURCE", f"(SELECT * FROM {FAULTY} UNION ALL SELECT * FROM {FAULTY} WHERE c_custkey % 50 = 0)"))
def q_table_fingerprint(s, d):
    c = faulty_customers(s, d)
    return profile.table_fingerprint(c.unionByName(c.filter("c_custkey % 50 = 0")), "customer", "c_custkey")


@query("SELECT 'orders' AS \"table\"")
def q_stale_tables(s, d):
    f = lambda df, t, k: profile.table_fingerprint(df, t, k)
    nation = f(T(s, d, "nation"), "nation", "n_nationkey")
    return profile.stale_tables(f(T(s, d, "orders"), "orders", "o_orderkey").unionByName(nation), f(edited_orders(s, d), "orders", "o_orderkey").unionByName(nation))


COLUMNS = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", "events": "event_id ts user_id event_type value props",
}
NUMBERS = {"region": "r_regionkey", "nation": "n_nationkey n_regionkey", "customer": "c_custkey c_nationkey c_acctbal", "supplier": "s_suppkey s_nationkey s_acctbal", "part": "p_partkey p_size p_retailprice", "orders": "o_orderkey o_custkey o_totalprice", "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax", "events": "event_id user_id value"}
_UNIQUE = [(t.name, u) for t in STAR.tables.values() for u in dict.fromkeys([t.key, *t.unique]) if u]
SPREAD = [("p25 p75", "CAST(quantile_cont({c}, 0.25) AS DOUBLE)", "CAST(quantile_cont({c}, 0.75) AS DOUBLE)"), ("p95 p99", "CAST(quantile_cont({c}, 0.95) AS DOUBLE)", "CAST(quantile_cont({c}, 0.99) AS DOUBLE)"), ("mean stddev", "round(avg({c}), 3)", "round(stddev_pop({c}), 3)")]
PROFILE = " UNION ALL ".join(
    [f"SELECT 'column_profile' AS axis, '{t}.{c}' AS subject, CAST(count(*) AS DOUBLE) AS a, CAST(count(*) - count({c}) AS DOUBLE) AS b FROM {t}" for t, cs in COLUMNS.items() for c in cs.split()]
    + [f"SELECT 'numeric_distribution', '{t}.{c}', CAST(quantile_cont({c}, 0.5) AS DOUBLE), CAST(max({c}) AS DOUBLE) FROM {t} HAVING count({c}) >= 5" for t, cs in NUMBERS.items() for c in cs.split()]
    + [f"SELECT 'numeric_distribution {label}', '{t}.{c}', {a.format(c=c)}, {b.format(c=c)} FROM {t} HAVING count({c}) >= 5" for label, a, b in SPREAD for t, cs in NUMBERS.items() for c in cs.split()]
    + [f"SELECT 'fk_cardinality {label}', '{r.name}', {a.format(c='n')}, {b.format(c='n')} FROM (SELECT count(*) AS n FROM {r.child} WHERE {r.column} IS NOT NULL GROUP BY {r.column}) HAVING count(*) >= 5" for label, a, b in SPREAD for r in STAR.references]
    + [f"SELECT 'categorical_distribution', '{t}.{c}', CAST(max(n) AS DOUBLE), CAST(count(*) AS DOUBLE) FROM (SELECT {c}, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1)" for t, cs in COLUMNS.items() for c in cs.split() if c not in NUMBERS[t].split() and c not in ("ts", "o_orderdate", "l_shipdate")]
    + [f"SELECT 'unique_candidate', '{t}.{','.join(u)}', CAST(count(*) AS DOUBLE), 0.0 FROM (SELECT 1 FROM {t} GROUP BY {', '.join(u)} HAVING count(*) > 1)" for t, u in _UNIQUE]
    + [f"SELECT 'fk_reality', '{r.name}', CAST(count(*) AS DOUBLE), 0.0 FROM {r.child} WHERE {r.column} IS NOT NULL AND {r.column} NOT IN (SELECT {r.key} FROM {r.parent})" for r in STAR.references]
    + [f"SELECT 'fk_cardinality', '{r.name}', CAST(quantile_cont(n, 0.5) AS DOUBLE), CAST(max(n) AS DOUBLE) FROM (SELECT count(*) AS n FROM {r.child} WHERE {r.column} IS NOT NULL GROUP BY {r.column}) HAVING count(*) >= 5" for r in STAR.references]
    + [f"SELECT 'fk_selectivity', '{r.name}', CAST(max(n) AS DOUBLE), CAST(count(*) AS DOUBLE) FROM (SELECT count(*) AS n FROM {r.child} WHERE {r.column} IS NOT NULL GROUP BY {r.column})" for r in STAR.references]
    + ["SELECT 'joint_distribution', 'lineitem', CAST(max(n) AS DOUBLE), CAST(count(*) AS DOUBLE) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey)"]
)


@query(PROFILE)
def q_full_profile(s, d):
    """Every axis of every table in long form: of lists the first entry and the number of entries, of distributions all figures."""
    axes = profile.full_profile(tables(s, d, *COLUMNS), STAR)
    dot, first = F.concat_ws(".", "table", "column"), F.col("rank") == 1
    told = {
        "column_profile": (None, dot, "n_rows", "n_nulls"), "numeric_distribution": (None, dot, "p50", "max"), "categorical_distribution": (first, dot, "n", "n_distinct"),
        "unique_candidate": (None, F.concat_ws(".", "table", "columns"), "n_duplicate_keys", None), "fk_reality": (None, F.col("reference"), "n_orphans", None),
        "fk_cardinality": (None, F.col("table"), "p50", "max"), "fk_selectivity": (first, F.col("reference"), "n", "n_distinct"), "joint_distribution": (first, F.col("table"), "n", "n_distinct"),
    }
    out = None
    for axis in ("numeric_distribution", "fk_cardinality"):
        axes[axis] = axes[axis].withColumns({c: F.round(c, 3) for c in ("mean", "stddev")})
        for label, _, _ in SPREAD:
            axes[f"{axis} {label}"] = axes[axis]
            told[f"{axis} {label}"] = (None, told[axis][1], *label.split())
    for axis, (only, subject, a, b) in told.items():
        df = axes[axis] if only is None else axes[axis].filter(only)
        part = df.select(F.lit(axis).alias("axis"), subject.alias("subject"), F.col(a).cast("double").alias("a"), (F.col(b) if b else F.lit(0.0)).cast("double").alias("b"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT 'customer' AS \"table\", 'c_acctbal' AS \"column\", count(c_acctbal) AS sample_size, max(c_acctbal) AS max FROM (SELECT CASE WHEN c_custkey % 97 <> 0 THEN c_acctbal END AS c_acctbal FROM customer)")
def q_distribution_merge(s, d):
    some = profile.numeric_distribution(T(s, d, "customer").filter("c_custkey % 2 = 0"), "customer", ["c_acctbal"]).withColumn("captured_at", F.lit(2))
    return profile.distribution_merge(some.unionByName(profile.numeric_distribution(faulty_customers(s, d), "customer", ["c_acctbal"]).withColumn("captured_at", F.lit(1)))).select("table", "column", "sample_size", "max")


def captures(s, d) -> DataFrame:
    """Two captures of the customer profile, made from the data."""
    one = profile.null_counts(faulty_customers(s, d), "customer").select("table", "column", "n_rows", "n_nulls", F.lit(False).alias("has_duplicates"), F.lit("Succeeded").alias("outcome"), F.lit(1).alias("captured_at"))
    two = profile.null_counts(some_customers(s, d), "customer").select("table", "column", "n_rows", "n_nulls", F.lit(True).alias("has_duplicates"), F.lit("FallbackTimeout").alias("outcome"), F.lit(2).alias("captured_at"))
    return one.unionByName(two)


FEWER = "(SELECT * FROM customer WHERE c_custkey % 2 = 0)"
_LIST = "SELECT 'categorical_distribution' AS axis, value AS subject, n AS a, rank AS b FROM (" + TOPN.format(head="'x' AS x", v="value", o="value", e="c_name AS value", t="customer", k=50) + ")"


@query(
    f"SELECT 'column_profile' AS axis, 'c_name' AS subject, (SELECT count(*) FROM customer) AS a, (SELECT count(*) FILTER (c_custkey % 89 = 0) FROM {FEWER}) AS b UNION ALL SELECT 'column_profile', 'c_custkey', (SELECT count(*) FROM customer), 0"
    + f" UNION ALL SELECT 'unique_candidate', 'c_custkey', 0, 0 UNION ALL SELECT 'fk_reality', 'orders.o_custkey', (SELECT count(*) {ORPHANS}), 0 UNION ALL {_LIST}"
)
def q_merge_profiles(s, d):
    """All customers, and half of them with empty names and lost orders, as one profile."""
    few = faulty_customers(s, d).filter("c_custkey % 2 = 0")

    def axes(c: DataFrame, parent: DataFrame) -> dict[str, DataFrame]:
        return {"column_profile": profile.column_profile(c, "customer", ["c_custkey", "c_name"]), "unique_candidate": profile.unique_candidate(c, "customer", ["c_custkey"]), "fk_reality": profile.fk_reality(T(s, d, "orders"), ORD, parent), "categorical_distribution": profile.categorical_distribution(c, "customer", "c_name")}

    m = profile.merge_profiles([axes(few, some_customers(s, d)), axes(T(s, d, "customer"), T(s, d, "customer"))])
    row = lambda axis, subject, a, b: m[axis].select(F.lit(axis).alias("axis"), F.col(subject).alias("subject"), F.col(a).cast("long").alias("a"), (F.col(b) if b else F.lit(0)).cast("long").alias("b"))
    return row("column_profile", "column", "n_rows", "n_nulls").unionByName(row("unique_candidate", "columns", "n_duplicate_keys", None)).unionByName(row("fk_reality", "reference", "n_orphans", None)).unionByName(row("categorical_distribution", "value", "n", "rank"))


MERGED = _each(CCOLS, "SELECT 'customer' AS \"table\", '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_nulls, true AS has_duplicates, 'OUTCOME' AS outcome, 2 AS captured_at FROM {source}", FAULTY)


@query(MERGED.replace("OUTCOME", "Succeeded"))
def q_profile_merge(s, d):
    return profile.profile_merge(captures(s, d))


@query(MERGED.replace("OUTCOME", "FallbackTimeout"))
def q_worst_case_merge(s, d):
    return profile.worst_case_merge(captures(s, d))


@query("SELECT count(*) FILTER (k = 0) AS n_sentinel, count(*) FILTER (k <> 0) AS n_orphans FROM (SELECT CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE o_custkey END AS k FROM orders) WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 97 <> 0)")
def q_sentinel_split(s, d):
    o = T(s, d, "orders").withColumn("o_custkey", F.when(F.col("o_orderkey") % 50 == 0, F.lit(0)).otherwise(F.col("o_custkey")))
    return profile.sentinel_split(o, ORD, some_customers(s, d))


@query("SELECT count(*) FILTER (o_orderkey % 40 = 0) AS n_sentinel FROM orders")
def q_date_sentinel(s, d):
    return profile.date_sentinel(T(s, d, "orders").withColumn("o_orderdate", F.when(F.col("o_orderkey") % 40 == 0, F.lit("1900-01-01").cast("timestamp")).otherwise(F.col("o_orderdate"))), "o_orderdate")


@query("SELECT lower(v) AS folded, count(DISTINCT v) AS n_forms FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS v FROM customer) GROUP BY 1 HAVING count(DISTINCT v) > 1")
def q_collation_collision(s, d):
    return profile.collation_collision(T(s, d, "customer").withColumn("v", F.when(F.col("c_custkey") % 3 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))), "v")


@query("SELECT max(o_orderkey) AS max_key, max(o_orderkey) / 2147483647 AS used_share FROM orders")
def q_key_headroom(s, d):
    return profile.key_headroom(T(s, d, "orders"), "o_orderkey")


@query("SELECT 'orders' AS \"table\", (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) AS least, (SELECT count(*) FROM orders) AS most")
def q_row_asymmetry(s, d):
    n = lambda df, e, t: df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(e).alias("env"), F.lit(t).alias("table"), "n_rows")
    c = T(s, d, "customer")
    return profile.row_asymmetry(n(T(s, d, "orders"), "a", "orders").unionByName(n(T(s, d, "orders").filter("o_orderkey % 3 = 0"), "b", "orders")).unionByName(n(c, "a", "customer")).unionByName(n(c, "b", "customer")))


# -- 2.4 decisions --------------------------------------------------------------------------------------------------
def not_null_evidence(s, d) -> DataFrame:
    c = F.col("column")
    nulls = profile.null_counts(faulty_customers(s, d), "customer")
    return nulls.select("table", "column", "n_rows", "n_nulls", (c == "c_custkey").alias("is_key"), (c == "c_nationkey").alias("physically_not_null"), c.isin("c_name", "c_mktsegment").alias("mandatory"), F.lit(None).cast("string").alias("override"))


NN = _each(CCOLS, "SELECT 'customer' AS \"table\", '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_nulls, '{c}' = 'c_custkey' AS is_key, '{c}' = 'c_nationkey' AS physically_not_null, '{c}' IN ('c_name', 'c_mktsegment') AS mandatory FROM {source}", FAULTY)
NND = f"SELECT *, reason NOT IN ('needs_approval', 'nullable') AS enforce FROM (SELECT *, CASE WHEN is_key THEN 'primary_key' WHEN physically_not_null THEN 'already_not_null' WHEN mandatory AND n_nulls = 0 THEN 'mandatory_no_nulls' WHEN mandatory AND n_nulls <= n_rows * 0.001 THEN 'mandatory_within_budget' WHEN mandatory THEN 'needs_approval' ELSE 'nullable' END AS reason FROM ({NN}))"


@query(NND)
def q_decide_not_null(s, d):
    return decide.decide_not_null(not_null_evidence(s, d), 0.001).drop("override")


def unique_evidence(s, d) -> DataFrame:
    u = profile.unique_candidate(T(s, d, "documents"), "documents", ["text"]).unionByName(profile.unique_candidate(T(s, d, "customer"), "customer", ["c_name"]))
    return u.select("table", "columns", "n_duplicate_keys", "has_duplicates", F.lit(False).alias("already_unique"), F.lit("Succeeded").alias("outcome"))


UQ = "SELECT 'documents' AS \"table\", 'text' AS columns, (SELECT count(*) FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)) AS n_duplicate_keys UNION ALL SELECT 'customer', 'c_name', (SELECT count(*) FROM (SELECT c_name FROM customer GROUP BY 1 HAVING count(*) > 1))"


@query(f"SELECT \"table\", columns, CASE WHEN n_duplicate_keys > 0 THEN 'duplicates' ELSE 'clean' END AS reason, n_duplicate_keys = 0 AS enforce FROM ({UQ})")
def q_decide_unique(s, d):
    return decide.decide_unique(unique_evidence(s, d)).select("table", "columns", "reason", "enforce")


def fk_evidence(s, d) -> DataFrame:
    e = profile.fk_reality(T(s, d, "orders"), ORD, some_customers(s, d)).unionByName(profile.fk_reality(T(s, d, "events"), REF["events.user_id"], T(s, d, "customer")))
    return e.select("*", F.lit(True).alias("tracked"), F.lit(True).alias("target_exists"), F.lit(False).alias("has_constraint"), F.lit(False).alias("crosses_schema"))


FKE = f"SELECT 'orders.o_custkey' AS reference, count(*) AS n_orphans {ORPHANS} UNION ALL SELECT 'events.user_id', count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)"


@query(f"SELECT reference, n_orphans, CASE WHEN n_orphans > 0 THEN 'orphans' ELSE 'clean' END AS reason, n_orphans = 0 AS enforce FROM ({FKE})")
def q_decide_fk(s, d):
    return decide.decide_fk(fk_evidence(s, d)).select("reference", "n_orphans", "reason", "enforce")


NKE = " UNION ALL ".join(f"SELECT 'customer' AS \"table\", '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, count(*) AS n_rows, count(*) - count({c}) AS n_nulls FROM customer" for c in ("c_name", "c_mktsegment", "c_nationkey"))


@query(f"SELECT \"table\", \"column\" FROM ({NKE}) WHERE n_distinct = n_rows - n_nulls AND n_nulls = 0 AND n_distinct >= 10")
def q_suggest_natural_key(s, d):
    c = T(s, d, "customer")
    row = c.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_distinct(x).alias(x) for x in ("c_name", "c_mktsegment", "c_nationkey")], *[F.count_if(F.col(x).isNull()).alias(f"{x}_0") for x in ("c_name", "c_mktsegment", "c_nationkey")])
    e = row.select("n_rows", F.explode(F.array(*[F.struct(F.lit(x).alias("column"), F.col(x).alias("n_distinct"), F.col(f"{x}_0").alias("n_nulls")) for x in ("c_name", "c_mktsegment", "c_nationkey")])).alias("x"))
    e = e.select(F.lit("customer").alias("table"), "x.*", "n_rows", F.lit(False).alias("truncated"))
    return decide.suggest_natural_key(e).select("table", "column")


LINE = "(SELECT * REPLACE (CASE WHEN l_orderkey % 2 = 0 THEN l_tax END AS l_tax) FROM lineitem)"
LN = _each(COLUMNS["lineitem"].split(), "SELECT 'lineitem' AS \"table\", '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_nulls FROM {source}", LINE)


@query(f"SELECT \"table\", \"column\" FROM ({LN}) WHERE n_nulls / n_rows > (SELECT avg(n_nulls / n_rows) + 2 * stddev_pop(n_nulls / n_rows) FROM ({LN}))")
def q_profile_anomalies(s, d):
    line = T(s, d, "lineitem").withColumn("l_tax", F.when(F.col("l_orderkey") % 2 == 0, F.col("l_tax")))
    return decide.profile_anomalies(profile.column_profile(line, "lineitem")).select("table", "column")


REFS = " UNION ALL ".join(f"SELECT '{r.name}' AS reference, count({r.column}) AS n_rows, count(DISTINCT {r.column}) AS n_distinct FROM {r.child}" for r in STAR.references)


def ref_counts(s, d) -> DataFrame:
    out = None
    for r in STAR.references:
        part = T(s, d, r.child).agg(F.count(r.column).alias("n_rows"), F.count_distinct(r.column).alias("n_distinct")).select(F.lit(r.name).alias("reference"), "*")
        out = part if out is None else out.unionByName(part)
    return out


FIRST = "SELECT 'first_order.o_custkey' AS reference, count(DISTINCT o_custkey) AS n_rows, count(DISTINCT o_custkey) AS n_distinct FROM orders"


@query(f"SELECT * FROM ({REFS} UNION ALL {FIRST}) WHERE n_distinct >= 10 AND n_rows < 2 * n_distinct")
def q_high_selectivity_fk(s, d):
    """With the first order of every customer as a table of its own."""
    first = T(s, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    counts = first.agg(F.count("o_custkey").alias("n_rows"), F.count_distinct("o_custkey").alias("n_distinct")).select(F.lit("first_order.o_custkey").alias("reference"), "*")
    return decide.high_selectivity_fk(ref_counts(s, d).unionByName(counts))


@query("SELECT 'lineitem' AS \"table\", count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem)) AS n_distinct FROM lineitem HAVING (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem)) >= count(*) * 0.95")
def q_near_unique_composite(s, d):
    e = T(s, d, "lineitem").groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"))
    return decide.near_unique_composite(e.select(F.lit("lineitem").alias("table"), "*"))


@query(f"SELECT \"table\", \"column\", n_nulls FROM ({NN}) WHERE mandatory AND n_nulls > 0")
def q_tightening_preflight(s, d):
    e = not_null_evidence(s, d)
    return decide.tightening_preflight(e.select("table", "column", "n_nulls"), decide.decide_not_null(e, 1.0))


LEN = "SELECT 'customer' AS \"table\", 'c_mktsegment' AS \"column\", max(length(c_mktsegment)) AS max_length, 8 AS declared_length FROM customer HAVING max(length(c_mktsegment)) > 8"


def overflow(s, d) -> DataFrame:
    declared = s.createDataFrame([("customer", "c_mktsegment", 8), ("customer", "c_name", 500)], "table string, column string, declared_length int")
    return decide.length_overflow(profile.column_profile(T(s, d, "customer"), "customer", ["c_mktsegment", "c_name"]), declared)


@query(LEN)
def q_length_overflow(s, d):
    return overflow(s, d)


VIO = (
    f"SELECT *, CASE WHEN coalesce(n_rows, 0) <= 100000 THEN 'repair' ELSE 'relax' END AS action FROM (SELECT 'NOT NULL' AS category, 'customer.' || \"column\" AS subject, n_nulls AS n_rows FROM ({NN}) WHERE mandatory AND n_nulls > 0"
    f" UNION ALL SELECT 'UNIQUE', \"table\" || '.' || columns, n_duplicate_keys FROM ({UQ}) WHERE n_duplicate_keys > 0 UNION ALL SELECT 'FOREIGN KEY', reference, n_orphans FROM ({FKE}) WHERE n_orphans > 0 UNION ALL SELECT 'LENGTH', \"table\" || '.' || \"column\", NULL FROM ({LEN}))"
)


def violations(s, d) -> DataFrame:
    return decide.data_violations(not_null_evidence(s, d).filter("mandatory"), unique_evidence(s, d), fk_evidence(s, d), overflow(s, d))


@query(VIO)
def q_data_violations(s, d):
    return violations(s, d)


@query(f"SELECT category, count(*) AS n_subjects, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM ({VIO}) GROUP BY 1")
def q_violation_rollup(s, d):
    return decide.violation_rollup(violations(s, d))


@query("SELECT 'not_null' AS category, 'customer.c_name' AS subject, count(*) AS n_rows FROM customer WHERE c_custkey % 89 = 0 HAVING count(*) > 0 UNION ALL SELECT 'foreign_key', 'orders.o_custkey', count(*) FROM orders WHERE o_custkey % 97 = 0 HAVING count(*) > 0")
def q_compare_evidence(s, d):
    """Evidence of a faulty environment under the contract of the clean one."""
    c = faulty_customers(s, d)
    twice = None
    for name in c.columns:
        part = profile.unique_candidate(c, "customer", [name]).select("table", F.col("columns").alias("column"), "n_duplicate_keys")
        twice = part if twice is None else twice.unionByName(part)
    evidence = profile.null_counts(c, "customer").join(twice, ["table", "column"])
    return decide.compare_evidence(evidence, STAR, profile.fk_reality(T(s, d, "orders"), ORD, some_customers(s, d)))


def two_envs(s, d) -> DataFrame:
    """Customer profiles of two environments: clean (prod) and faulty (dev)."""
    one = lambda df, e: profile.null_counts(df, "customer").select(F.lit(e).alias("env"), "table", "column", "n_rows", "n_nulls", (F.col("column") == "c_name").alias("not_null"), F.lit(False).alias("has_duplicates"), F.lit(False).alias("unique"), F.lit(0).cast("long").alias("n_orphans"), F.lit("Succeeded").alias("outcome"))
    return one(T(s, d, "customer"), "prod").unionByName(one(faulty_customers(s, d), "dev"))


@query(f"SELECT \"table\", \"column\", 0 AS least, n_nulls AS most FROM ({NN}) WHERE n_nulls > 0")
def q_null_variance(s, d):
    return decide.null_variance(two_envs(s, d))


@query(f"SELECT 'dev' AS env, \"table\", \"column\", 'nulls_in_not_null' AS finding FROM ({NN}) WHERE \"column\" = 'c_name' AND n_nulls > 0 UNION ALL SELECT '*', \"table\", \"column\", 'null_variance' FROM ({NN}) WHERE n_nulls > 0")
def q_validate_profiles(s, d):
    return decide.validate_profiles(two_envs(s, d))


@query(f"SELECT \"column\" AS \"constraint\", 2 AS n_present, CASE WHEN n_nulls = 0 THEN 2 ELSE 1 END AS n_safe, CASE WHEN n_nulls = 0 THEN [] ELSE ['dev'] END AS unsafe_in, 2 AS n_envs, CASE WHEN n_nulls = 0 THEN 1.0 ELSE 0.5 END AS ratio, n_nulls = 0 AS safe FROM ({NN})")
def q_constraint_consensus(s, d):
    return decide.constraint_consensus(two_envs(s, d).select("env", F.col("column").alias("constraint"), (F.col("n_nulls") == 0).alias("safe")))


@query(f"SELECT 'dev' AS env, \"table\", \"column\", 'more_nulls' AS finding FROM ({NN}) WHERE n_nulls > 0")
def q_environment_findings(s, d):
    return decide.environment_findings(two_envs(s, d), "prod")


@query(f"SELECT \"table\", \"column\", CASE WHEN n_nulls = 0 THEN 'nullable with zero NULLs' ELSE 'NULLs in a NOT NULL column' END AS insight FROM ({NN}) WHERE (\"column\" <> 'c_name' AND n_nulls = 0) OR (\"column\" = 'c_name' AND n_nulls > 0)")
def q_profiling_insights(s, d):
    return decide.profiling_insights(two_envs(s, d).filter("env = 'dev'"))


decided = lambda s, d: decide.decide_not_null(not_null_evidence(s, d), 1.0).withColumn("n_violations", F.col("n_nulls"))
ND1 = NND.replace("* 0.001", "* 1.0")
RISK = "CASE WHEN enforce AND n_nulls > 0 THEN 'High' WHEN n_nulls > 0 THEN 'Moderate' ELSE 'Low' END"


@query(f"SELECT \"table\", \"column\", {RISK} AS risk FROM ({ND1})")
def q_change_risk(s, d):
    return decide.change_risk(decided(s, d)).select("table", "column", "risk")


@query(f"SELECT 'not_null' AS kind, CASE WHEN enforce AND n_nulls = 0 THEN 'validated' WHEN enforce THEN 'contradiction' ELSE 'recommendation' END AS category, {RISK} AS risk, count(*) AS n FROM ({ND1}) GROUP BY ALL")
def q_opportunities(s, d):
    return decide.opportunities(decided(s, d).withColumn("kind", F.lit("not_null")))


@query(f"SELECT enforce, reason, count(*) AS n FROM ({ND1}) GROUP BY ALL")
def q_decision_summary(s, d):
    return decide.decision_summary(decided(s, d))


@query(f"SELECT 'nulls' AS kind, c_custkey AS key FROM {FAULTY} WHERE c_name IS NULL UNION ALL SELECT 'duplicates', doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r > 1 UNION ALL SELECT 'orphans', o_orderkey {ORPHANS}")
def q_remediation_rows(s, d):
    a = decide.remediation_rows(faulty_customers(s, d), "nulls", "c_custkey", "c_name").select(F.lit("nulls").alias("kind"), "key")
    b = decide.remediation_rows(T(s, d, "documents"), "duplicates", "doc_id", "text").select(F.lit("duplicates").alias("kind"), "key")
    c = decide.remediation_rows(T(s, d, "orders"), "orphans", "o_orderkey", "o_custkey", some_customers(s, d), "c_custkey").select(F.lit("orphans").alias("kind"), "key")
    return a.unionByName(b).unionByName(c)


@query("SELECT c_custkey AS finding, CASE WHEN c_custkey % 6 = 0 THEN 'persisting' WHEN c_custkey % 2 = 0 THEN 'resolved' ELSE 'new' END AS state FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def q_burndown(s, d):
    c = T(s, d, "customer").select(F.col("c_custkey").alias("finding"))
    return decide.burndown(c.filter("finding % 2 = 0"), c.filter("finding % 3 = 0"))


# -- 2.5 reconciliation ---------------------------------------------------------------------------------------------
def target_customers(s, d) -> DataFrame:
    """The customers of the other environment: keys shifted, names in other case, some missing, one name twice."""
    c = T(s, d, "customer").filter("c_custkey % 97 <> 0")
    moved = c.withColumn("c_custkey", F.col("c_custkey") + 1_000_000).withColumn("c_name", F.upper("c_name"))
    return moved.unionByName(c.filter("c_custkey % 50 = 1").withColumn("c_custkey", F.col("c_custkey") + 2_000_000))


TGT = "(SELECT c_custkey + 1000000 AS c_custkey, upper(c_name) AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 97 <> 0 UNION ALL SELECT c_custkey + 2000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 97 <> 0 AND c_custkey % 50 = 1)"
MATCH = f"(SELECT c.c_custkey AS source_key, min(t.c_custkey) AS target_key FROM customer c LEFT JOIN {TGT} t ON lower(rtrim(c.c_name)) = lower(rtrim(t.c_name)) GROUP BY 1)"
matched = lambda s, d: reconcile.reconcile_by_column(T(s, d, "customer"), target_customers(s, d), "c_custkey", "c_name")


@query(f"SELECT * FROM {MATCH}")
def q_reconcile_by_column(s, d):
    return matched(s, d)


@query(f"SELECT c.c_custkey AS source_key, min(t.c_custkey) AS target_key FROM customer c LEFT JOIN {TGT} t ON lower(rtrim(c.c_name)) = lower(rtrim(t.c_name)) AND lower(rtrim(c.c_mktsegment)) = lower(rtrim(t.c_mktsegment)) GROUP BY 1")
def q_reconcile_by_columns(s, d):
    return reconcile.reconcile_by_columns(T(s, d, "customer"), target_customers(s, d), "c_custkey", ["c_name", "c_mktsegment"])


@query(f"SELECT source_key, CASE WHEN source_key % 31 = 0 THEN source_key + 5 ELSE target_key END AS target_key FROM {MATCH}")
def q_reconcile_override(s, d):
    o = T(s, d, "customer").filter("c_custkey % 31 = 0").select(F.col("c_custkey").alias("source_key"), (F.col("c_custkey") + 5).alias("target_key"))
    return reconcile.reconcile_override(matched(s, d), o)


@query(f"SELECT source_key, coalesce(target_key, 1000001) AS target_key, CASE WHEN target_key IS NULL THEN 'fallback' ELSE 'match' END AS by FROM {MATCH}")
def q_reconcile_fallback(s, d):
    return reconcile.reconcile_fallback(matched(s, d), 1000001, target_customers(s, d), "c_custkey")[0]


@query(f"SELECT 'unmatched' AS kind, source_key AS key FROM {MATCH} WHERE target_key IS NULL UNION ALL SELECT 'displaced', c_custkey FROM (SELECT c_custkey, row_number() OVER (PARTITION BY lower(rtrim(c_name)) ORDER BY c_custkey) AS r FROM {TGT}) WHERE r > 1 UNION ALL SELECT 'ambiguous', c_custkey FROM (SELECT c_custkey, row_number() OVER (PARTITION BY lower(rtrim(c_name)) ORDER BY c_custkey) AS r FROM customer) WHERE r > 1")
def q_reconcile_report(s, d):
    return reconcile.reconcile_report(T(s, d, "customer"), target_customers(s, d), "c_custkey", "c_name")


@query(f"SELECT source_key, CASE WHEN c_custkey % 89 = 0 THEN 'no email' ELSE 'email did not match' END AS reason FROM {MATCH} m JOIN customer c ON c.c_custkey = m.source_key WHERE target_key IS NULL OR c_custkey % 89 = 0")
def q_unmatched_reason(s, d):
    c = faulty_customers(s, d)
    m = reconcile.reconcile_by_column(c, target_customers(s, d), "c_custkey", "c_name").join(c.select(F.col("c_custkey").alias("source_key"), "c_name"), "source_key")
    return reconcile.unmatched_reason(m, "c_name").select("source_key", "reason")


@query(f"SELECT 'o_orderstatus' AS \"column\", count(*) AS n_differing, list(k ORDER BY k)[1:3] AS samples FROM (SELECT o.o_orderkey AS k FROM orders o JOIN {EDITED} e USING (o_orderkey) WHERE o.o_orderstatus IS DISTINCT FROM e.o_orderstatus)")
def q_matched_divergence(s, d):
    return reconcile.matched_divergence(T(s, d, "orders"), edited_orders(s, d), "o_orderkey", OCOLS[1:], ["o_totalprice"])


@query(f"SELECT 'missing' AS kind, o_orderkey AS key, '' AS \"column\" FROM orders WHERE o_orderkey % 97 = 0 UNION ALL SELECT 'drift', o.o_orderkey, 'o_orderstatus' FROM orders o JOIN {EDITED} e USING (o_orderkey) WHERE o.o_orderstatus <> e.o_orderstatus")
def q_lookup_identity(s, d):
    return reconcile.lookup_identity(T(s, d, "orders"), edited_orders(s, d), "o_orderkey", OCOLS[1:])


order_values = lambda s, d: T(s, d, "orders").select(F.col("o_custkey").alias("value"))
roster = lambda s, d: some_customers(s, d).select(F.col("c_custkey").alias("id"))
ORPH = f"(SELECT DISTINCT o_custkey AS value {ORPHANS})"


@query(f"SELECT value FROM {ORPH}")
def q_orphan_ids(s, d):
    return reconcile.orphan_ids(order_values(s, d), roster(s, d))


MU = f"(SELECT c.c_custkey AS source_key, CASE WHEN n = 1 THEN one END AS target_key, CASE WHEN n IS NULL THEN 'no candidate' WHEN n > 1 THEN 'several candidates' END AS reason FROM customer c LEFT JOIN (SELECT lower(rtrim(c_name)) AS m, count(*) AS n, min(c_custkey) AS one FROM {TGT} GROUP BY 1) t ON lower(rtrim(c.c_name)) = t.m)"


@query(f"SELECT * FROM {MU}")
def q_match_users(s, d):
    return reconcile.match_users(T(s, d, "customer"), target_customers(s, d), "c_custkey", "c_name")


@query(f"SELECT source_key, [10, 20, 30][CAST((row_number() OVER (ORDER BY source_key) - 1) % 3 + 1 AS INT)] AS target_key FROM {MU} WHERE target_key IS NULL")
def q_match_fallback(s, d):
    m = reconcile.match_users(T(s, d, "customer"), target_customers(s, d), "c_custkey", "c_name").filter("target_key IS NULL")
    return reconcile.match_fallback(m, [10, 20, 30])


def the_user_map(s, d) -> DataFrame:
    orphans = reconcile.orphan_ids(order_values(s, d), roster(s, d))
    auto = orphans.filter("value % 2 = 0").select(F.col("value").alias("source_key"), (F.col("value") - 1).alias("target_key"))
    operator = orphans.filter("value % 3 = 0").select(F.col("value").alias("source_key"), F.when(F.col("value") % 9 != 0, F.lit(1).cast("long")).alias("target_key"))
    return reconcile.merge_user_map(orphans, operator, auto)


UM = f"(SELECT value AS source_key, CASE WHEN value % 3 = 0 AND value % 9 <> 0 THEN 1 WHEN value % 2 = 0 THEN value - 1 END AS target_key FROM {ORPH})"


@query(f"SELECT * FROM {UM}")
def q_merge_user_map(s, d):
    return the_user_map(s, d)


@query(f"SELECT 'unmapped orphan' AS finding, source_key AS key FROM {UM} WHERE target_key IS NULL UNION ALL SELECT 'unknown target', target_key FROM {UM} WHERE target_key NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 97 <> 0)")
def q_verify_user_map(s, d):
    return reconcile.verify_user_map(the_user_map(s, d), T(s, d, "customer").select(F.col("c_custkey").alias("id")), roster(s, d), reconcile.orphan_ids(order_values(s, d), roster(s, d)))


@query(f"SELECT 'orders.o_custkey' AS reference, o_custkey AS value, target_key, count(*) AS n FROM orders JOIN {UM} m ON o_custkey = source_key WHERE target_key IS NOT NULL GROUP BY ALL")
def q_remap_preview(s, d):
    return reconcile.remap_preview(profile.reference_value_counts(tables(s, d, "orders"), [ORD]), the_user_map(s, d))


@query(f"SELECT o_orderkey, coalesce(target_key, o_custkey) AS o_custkey, coalesce(target_key <> o_custkey, false) AS changed FROM orders LEFT JOIN {UM} ON o_custkey = source_key")
def q_apply_user_remap(s, d):
    return reconcile.apply_user_remap(T(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", the_user_map(s, d))


AS = "(SELECT c_custkey AS source_key, 1000 + row_number() OVER (ORDER BY c_custkey) AS assigned_key FROM customer WHERE c_custkey % 97 <> 0)"


def surrogates(s, d) -> DataFrame:
    top = T(s, d, "customer").agg(F.lit(1000).cast("long").alias("c_custkey"))
    return reconcile.assign_surrogates(some_customers(s, d), "c_custkey", top)


@query(f"SELECT * FROM {AS}")
def q_assign_surrogates(s, d):
    return surrogates(s, d)


REMAP = f"(SELECT o_orderkey, coalesce(assigned_key, o_custkey) AS o_custkey, CASE WHEN assigned_key IS NULL THEN 'o_custkey' END AS failed_column, CASE WHEN assigned_key IS NULL THEN CAST(o_custkey AS VARCHAR) END AS failed_value FROM orders LEFT JOIN {AS} ON o_custkey = source_key)"
remapped = lambda s, d: reconcile.remap_references(T(s, d, "orders").select("o_orderkey", "o_custkey"), {"o_custkey": surrogates(s, d)})


@query(f"SELECT * FROM {REMAP}")
def q_remap_references(s, d):
    return remapped(s, d)


@query(f"SELECT o_orderkey AS key, failed_column, failed_value FROM {REMAP} WHERE failed_column IS NOT NULL")
def q_dropped_rows(s, d):
    return reconcile.dropped_rows(remapped(s, d), "o_orderkey")


@query(f"SELECT o_orderkey, coalesce(assigned_key, o_custkey) AS o_custkey FROM orders LEFT JOIN {AS} ON o_custkey = source_key")
def q_keymap_repoint(s, d):
    return reconcile.keymap_repoint(T(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "customer", surrogates(s, d).withColumn("table", F.lit("customer")))


@query("SELECT count(c_name) = count(DISTINCT c_name) AS target_unique, (SELECT count(*) FROM (SELECT v FROM (SELECT DISTINCT c_name AS v FROM customer) ORDER BY md5(v), v LIMIT 100)) AS n_sampled, (SELECT count(*) FROM (SELECT v FROM (SELECT DISTINCT c_name AS v FROM customer) ORDER BY md5(v), v LIMIT 100) WHERE v IN (SELECT c_name FROM customer WHERE c_custkey % 97 <> 0)) AS n_found FROM customer WHERE c_custkey % 97 <> 0")
def q_reconcile_evidence(s, d):
    return reconcile.reconcile_evidence(T(s, d, "customer"), some_customers(s, d), "c_name", 100)


@query(f"SELECT count(*) FILTER (failed_column IS NULL) AS n_rekeyed, count(*) FILTER (failed_column IS NOT NULL) AS n_dropped FROM {REMAP}")
def q_forecast_answers(s, d):
    return reconcile.forecast_answers(T(s, d, "orders").select("o_orderkey", "o_custkey"), {"o_custkey": surrogates(s, d)})


ANSWERS = {"o": {"match": "IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 97 <> 0)", "widen": "IN (SELECT o_orderkey FROM orders)", "pin": "IS NULL"}, "s": {"match": "IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 13 <> 0)", "pin": "IS NULL"}}
_forecast = lambda target, column, side, other: " UNION ALL ".join(f"SELECT '{target}' AS target, '{a}' AS answer, {a == 'match'} AS chosen, count(*) FILTER ({column} {test} AND {other}) AS n_rekeyed, count(*) FILTER (NOT ({column} {test})) AS n_dropped, {'(SELECT count(*) FROM orders)' if a == 'widen' else '0'} AS n_entering FROM lineitem" for a, test in ANSWERS[side].items())


@query(_forecast("orders", "l_orderkey", "o", f"l_suppkey {ANSWERS['s']['match']}") + " UNION ALL " + _forecast("supplier", "l_suppkey", "s", f"l_orderkey {ANSWERS['o']['match']}"))
def q_forecast_candidates(s, d):
    keys = lambda table, key, test: T(s, d, table).filter(test).select(F.col(key).alias("source_key"))
    answers = {
        "orders": {"match": keys("orders", "o_orderkey", "o_orderkey % 97 <> 0"), "widen": keys("orders", "o_orderkey", "true"), "pin": None},
        "supplier": {"match": keys("supplier", "s_suppkey", "s_suppkey % 13 <> 0"), "pin": None},
    }
    return reconcile.forecast_candidates(T(s, d, "lineitem").select("l_orderkey", "l_suppkey"), {"l_orderkey": "orders", "l_suppkey": "supplier"}, answers, {"orders": "match", "supplier": "match"}, {"orders": {"widen": T(s, d, "orders")}})


@query("SELECT 'customer.c_nationkey' AS reference, 'escapes' AS direction, count(*) AS n_rows FROM customer UNION ALL SELECT 'lineitem.l_orderkey', 'points_in', count(*) FROM lineitem UNION ALL SELECT 'events.user_id', 'points_in', count(*) FROM events")
def q_escaping_references(s, d):
    return reconcile.escaping_references(STAR, tables(s, d, "customer", "orders", "lineitem", "events"), {"customer", "orders"})


def bridge(s, d) -> DataFrame:
    c = T(s, d, "customer")
    source = c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("identity"))
    there = c.filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 7 == 0, "other").otherwise(F.col("c_name")).alias("identity"))
    return reconcile.bridge_verdict(T(s, d, "orders").select(F.col("o_custkey").alias("key")), source.filter("key % 11 <> 0"), there)


BV = "(SELECT DISTINCT o_custkey AS key, CASE WHEN o_custkey % 11 <> 0 THEN c_name END AS s_id, CASE WHEN o_custkey % 11 = 0 AND o_custkey % 5 = 0 THEN 'unknown' WHEN o_custkey % 5 = 0 THEN 'insert' WHEN o_custkey % 11 = 0 THEN 'bridge_only' WHEN o_custkey % 7 = 0 THEN 'update_identity' ELSE 'present' END AS verdict FROM orders JOIN customer ON o_custkey = c_custkey)"


@query(f"SELECT key, verdict FROM {BV}")
def q_bridge_verdict(s, d):
    return bridge(s, d).select("key", "verdict")


@query(f"SELECT key, s_id AS identity, verdict FROM {BV} WHERE verdict IN ('insert', 'update_identity')")
def q_bridge_stage(s, d):
    return reconcile.bridge_stage(bridge(s, d))


@query(f"SELECT count(*) AS n_keys, count(*) FILTER (verdict = 'insert') AS n_inserts, count(*) FILTER (verdict = 'update_identity') AS n_updates, bool_or(verdict = 'unknown') AS withheld FROM {BV}")
def q_bridge_evidence(s, d):
    return reconcile.bridge_evidence(bridge(s, d))


@query("SELECT CAST(0 AS BIGINT) AS n_null_bridge_keys, count(*) FILTER (c_custkey % 97 <> 0 AND c_custkey % 89 = 0) AS n_payload_conflicts, count(*) FILTER (c_custkey % 97 = 0) AS n_unresolved, ['all_values_resolve'] AS blocked_by, ['no_payload_conflicts', 'only_audit_references'] AS warned_by, 'Blocked' AS status FROM customer")
def q_bridge_readiness(s, d):
    c = T(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("identity"))
    bridge_rows = faulty_customers(s, d).filter("c_custkey % 97 <> 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("identity"))
    m = reconcile.bridge_measures(c, bridge_rows, c.select("key")).withColumns({"bridge_key_declared_unique": F.lit(True), "targets_bridge_primary_key": F.lit(False), "other_retarget": F.lit(False), "trusted_constraint_possible": F.lit(True), "identity_evidence": F.lit("present"), "only_audit_references": F.lit(False)})
    return reconcile.bridge_readiness(m).select("n_null_bridge_keys", "n_payload_conflicts", "n_unresolved", "blocked_by", "warned_by", "status")


# -- 2.6 diff and fidelity ------------------------------------------------------------------------------------------
ORDER_CELLS = {"o_custkey": "CAST(o_custkey AS VARCHAR)", "o_orderdate": "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f')", "o_orderkey": "CAST(o_orderkey AS VARCHAR)", "o_orderpriority": "o_orderpriority", "o_orderstatus": "o_orderstatus", "o_totalprice": PRICE}


def _row_sql(cells_: dict[str, str]) -> str:
    """The hash of a row: cells by name with their lengths."""
    return f"sha256(concat_ws(chr(30), {', '.join(f"'{c}=' || length({x}) || ':' || {x}" for c, x in sorted(cells_.items()))}))"


def _digest_sql(source: str, cells_: dict[str, str] = ORDER_CELLS, suffix: str = "digest") -> str:
    """Row hashes and their sum modulo 2**256, by limbs of 32 bits."""
    sums = ", ".join(f"CAST(coalesce(sum(CAST(('0x' || substr(h, {8 * i + 1}, 8)) AS BIGINT)), 0) AS HUGEINT) AS s{i}" for i in range(8))
    out = f"(SELECT count(*) AS n_rows, {sums} FROM (SELECT {_row_sql(cells_)} AS h FROM {source}))"
    for i in reversed(range(8)):
        carry = "0" if i == 7 else f"t{i + 1} // 4294967296"
        out = f"(SELECT *, s{i} + {carry} AS t{i} FROM {out})"
    return f"SELECT n_rows, lower({' || '.join(f"lpad(to_hex(CAST(t{i} % 4294967296 AS BIGINT)), 8, '0')" for i in range(8))}) AS {suffix} FROM {out}"


TWICE = "(SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 50 = 0)"
odd_orders = lambda s, d: odd_prices(T(s, d, "orders"))
odd_edited = lambda s, d: odd_prices(edited_orders(s, d))


@query(f"SELECT o_orderkey, {_row_sql({**ORDER_CELLS, 'o_orderstatus': 'CASE WHEN o_orderkey % 89 <> 0 THEN o_orderstatus END'})} AS h FROM orders")
def q_row_digest(s, d):
    o = odd_orders(s, d).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 89 != 0, F.col("o_orderstatus")))
    return o.select("o_orderkey", diff.row_digest(o).alias("h"))


@query(_digest_sql(TWICE))
def q_table_digest(s, d):
    o = odd_orders(s, d)
    return diff.table_digest(o.unionByName(o.filter("o_orderkey % 50 = 0")))


@query(_digest_sql(EDITED))
def q_server_digest(s, d):
    return diff.server_digest(odd_edited(s, d), ["o_orderkey"])


RD = f"(SELECT o_orderkey, 'missing' AS state, CAST([] AS VARCHAR[]) AS columns FROM orders WHERE o_orderkey % 97 = 0 UNION ALL SELECT o.o_orderkey, 'differs', ['o_orderstatus'] FROM orders o JOIN {EDITED} e USING (o_orderkey) WHERE o.o_orderstatus <> e.o_orderstatus)"


@query(f"SELECT * FROM {RD}")
def q_row_diff(s, d):
    return diff.row_diff(T(s, d, "orders"), edited_orders(s, d), ["o_orderkey"])


def keyless_lines(s, d) -> DataFrame:
    """Line items, whose key repeats, with some keys NULL."""
    return T(s, d, "lineitem").withColumn("l_orderkey", F.when(F.col("l_orderkey") % 89 != 0, F.col("l_orderkey")))


@query("SELECT CASE WHEN l_orderkey % 89 <> 0 THEN l_orderkey END AS l_orderkey, l_linenumber, state, CAST([] AS VARCHAR[]) AS columns FROM lineitem, (VALUES ('missing'), ('extra')) AS v(state) WHERE CASE state WHEN 'missing' THEN l_partkey % 97 = 0 ELSE l_partkey % 97 = 1 AND l_linenumber = 1 END")
def q_row_diff_of_repeated_keys(s, d):
    """Rows without their partner among repeated and NULL keys; the extra ones have a line number that no row has."""
    lines = keyless_lines(s, d)
    extra = lines.filter("l_partkey % 97 = 1 AND l_linenumber = 1").withColumn("l_linenumber", F.lit(99))
    out = diff.row_diff(lines, lines.filter("l_partkey % 97 <> 0").unionByName(extra), ["l_orderkey", "l_linenumber"])
    return out.withColumn("l_linenumber", F.when(F.col("state") == "extra", 1).otherwise(F.col("l_linenumber")))


@query("SELECT 'Unchanged' AS change, count(*) AS n FROM lineitem")
def q_classify_changes_of_repeated_keys(s, d):
    return diff.classify_changes(keyless_lines(s, d), keyless_lines(s, d), ["l_orderkey", "l_linenumber"]).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT 'orders' AS \"table\", a.n_rows AS n_source, a.digest AS source_digest, b.n_rows AS n_target, b.digest AS target_digest, (SELECT count(*) FROM {RD}) AS n_differences, 'different' AS verdict FROM ({_digest_sql('orders')}) a, ({_digest_sql(EDITED)}) b")
def q_fidelity_report(s, d):
    return diff.fidelity_report({"orders": (odd_orders(s, d), odd_edited(s, d), ["o_orderkey"])})


@query(f"SELECT o_orderkey + 500000 AS o_orderkey, coalesce(assigned_key, o_custkey) AS o_custkey FROM orders LEFT JOIN {AS} ON o_custkey = source_key")
def q_replay_rewrites(s, d):
    o = T(s, d, "orders").select("o_orderkey", "o_custkey")
    keys = o.select(F.col("o_orderkey").alias("source_key"), (F.col("o_orderkey") + 500000).alias("assigned_key"))
    return diff.replay_rewrites(o, "o_orderkey", keys, {"o_custkey": surrogates(s, d)})


@query("SELECT 'orders' AS \"table\", false AS same UNION ALL SELECT 'again', true")
def q_digest_reconcile(s, d):
    live = diff.table_digest(odd_orders(s, d))
    stored = diff.table_digest(odd_edited(s, d)).select(F.lit("orders").alias("table"), "*").unionByName(live.select(F.lit("again").alias("table"), "*"))
    return diff.digest_reconcile(live.select(F.lit("orders").alias("table"), "*").unionByName(live.select(F.lit("again").alias("table"), "*")), stored)


@query(f"SELECT \"table\", \"column\", 0 AS row_delta, n_nulls AS null_delta FROM ({NN}) WHERE n_nulls > 0")
def q_integrity_check(s, d):
    return diff.integrity_check(profile.null_counts(T(s, d, "customer"), "customer"), profile.null_counts(faulty_customers(s, d), "customer"))


CH = f"(SELECT coalesce(o.o_orderkey, e.o_orderkey) AS o_orderkey, CASE WHEN e.o_orderkey IS NULL THEN 'Deleted' WHEN o.o_orderkey IS NULL THEN 'Added' WHEN o.o_orderstatus <> e.o_orderstatus THEN 'Changed' ELSE 'Unchanged' END AS change, o.o_orderstatus AS before, e.o_orderstatus AS after FROM (SELECT * FROM orders WHERE o_orderkey % 11 <> 0) o FULL JOIN {EDITED} e USING (o_orderkey))"


def changes(s, d) -> DataFrame:
    return diff.classify_changes(T(s, d, "orders").filter("o_orderkey % 11 <> 0"), edited_orders(s, d), ["o_orderkey"])


@query(f"SELECT o_orderkey, change, CASE WHEN change = 'Changed' THEN before END AS before, CASE WHEN change = 'Changed' THEN after END AS after FROM {CH}")
def q_classify_changes(s, d):
    return changes(s, d).select("o_orderkey", "change", F.get("fields", F.lit(0))["before"].alias("before"), F.get("fields", F.lit(0))["after"].alias("after"))


@query(f"SELECT 'orders' AS \"table\", count(*) FILTER (change <> 'Added') AS n_before, count(*) FILTER (change = 'Added') AS n_added, count(*) FILTER (change = 'Deleted') AS n_deleted, count(*) FILTER (change = 'Changed') AS n_changed, count(*) FILTER (change = 'Unchanged') AS n_unchanged FROM {CH}")
def q_impact_summary(s, d):
    return diff.impact_summary(changes(s, d).withColumn("table", F.lit("orders")))


@query("SELECT o_orderkey, c_name, n_items FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n_items FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderkey % 89 = 0")
def q_impact_documents(s, d):
    roots = T(s, d, "orders").filter("o_orderkey % 89 = 0")
    out = diff.impact_documents(roots, "o_orderkey", {"o_custkey": (T(s, d, "customer"), "c_custkey")}, {"items": (T(s, d, "lineitem"), "l_orderkey")})
    return out.select("o_orderkey", F.col("o_custkey_row.c_name").alias("c_name"), F.when(F.col("items").isNotNull(), F.size("items").cast("long")).alias("n_items"))


TRI = f"(SELECT o.o_custkey AS unit, count(*) FILTER (change = 'Added') AS n_added, count(*) FILTER (change = 'Deleted') AS n_deleted, count(*) FILTER (change = 'Changed') AS n_changed, o.o_custkey % 10 = 0 AS escapes FROM {CH} JOIN orders o USING (o_orderkey) GROUP BY ALL)"


@query(f"SELECT unit, CASE WHEN escapes THEN 'escaping' WHEN n_deleted > 0 THEN 'deleting' WHEN n_changed > 0 THEN 'changing' WHEN n_added > 0 THEN 'adding' ELSE 'quiet' END AS class, n_added + n_deleted + n_changed + CASE WHEN escapes THEN 1000 ELSE 0 END AS score FROM {TRI}")
def q_impact_triage(s, d):
    n = lambda k: F.count_if(F.col("change") == k)
    u = changes(s, d).join(T(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").groupBy(F.col("o_custkey").alias("unit")).agg(n("Added").alias("n_added"), n("Deleted").alias("n_deleted"), n("Changed").alias("n_changed"))
    return diff.impact_triage(u.withColumn("escapes", F.col("unit") % 10 == 0)).select("unit", "class", "score")


@query("SELECT c_custkey, n_name, n_orders, n_items FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, CAST(sum(n) AS BIGINT) AS n_items FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1) ON o_custkey = c_custkey WHERE c_custkey % 19 = 0")
def q_nested_documents(s, d):
    """Customers with their orders, and these with their items: counts from inside the documents."""
    t = tables(s, d, "customer", "orders", "lineitem", "nation")
    out = diff.nested_documents(STAR, t | {"customer": t["customer"].filter("c_custkey % 19 = 0")}, "customer", {"nation"})
    items = F.aggregate(F.filter(F.transform(F.col("`orders.o_custkey`"), lambda o: F.size(o["lineitem.l_orderkey"])), lambda x: x > 0), F.lit(None).cast("long"), lambda a, x: F.coalesce(a, F.lit(0)) + x)
    return out.select("c_custkey", F.col("c_nationkey_row.n_name").alias("n_name"), F.when(F.col("`orders.o_custkey`").isNotNull(), F.size(F.col("`orders.o_custkey`")).cast("long")).alias("n_orders"), items.alias("n_items"))


UNITS = f"(SELECT CASE WHEN o.o_custkey % 13 = 0 THEN 'customer:' || o.o_custkey ELSE 'orders:' || o_orderkey END AS unit, change, false AS out FROM {CH} JOIN orders o USING (o_orderkey) WHERE change <> 'Unchanged' UNION ALL SELECT 'customer:' || c_custkey, 'Changed', true FROM customer WHERE c_custkey % 13 = 0)"


@query(f"SELECT unit, count(*) FILTER (change = 'Added') AS n_added, count(*) FILTER (change = 'Deleted') AS n_deleted, count(*) FILTER (change = 'Changed') AS n_changed, bool_or(out) AS escapes FROM {UNITS} GROUP BY unit")
def q_change_units(s, d):
    """Changed orders and customers, tied by the reference between them; customers refer to nations, which aren't moved."""
    o = changes(s, d).join(T(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").select("o_orderkey", "o_custkey", "change")
    c = T(s, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 13 == 0, "Changed").otherwise("Unchanged").alias("change"))
    return diff.change_units(STAR, {"orders": o, "customer": c}, {"orders", "customer"})


@query("SELECT 'missing' AS side, c_custkey, c_name FROM customer WHERE c_custkey % 97 = 0")
def q_drift_guard(s, d):
    return diff.drift_guard(T(s, d, "customer").select("c_custkey", "c_name"), some_customers(s, d).select("c_custkey", "c_name"))


# -- 2.7 upserts ----------------------------------------------------------------------------------------------------
def merge_sides(s, d) -> tuple[DataFrame, DataFrame]:
    cols = ["o_orderkey", "o_custkey", "o_orderstatus"]
    return T(s, d, "orders").filter("o_orderkey % 11 <> 0").select(*cols), edited_orders(s, d).select(*cols)


def _merge_sql(scope: str) -> str:
    return (
        f"(SELECT coalesce(o.o_orderkey, e.o_orderkey) AS o_orderkey, coalesce(e.o_custkey, o.o_custkey) AS o_custkey, coalesce(e.o_orderstatus, o.o_orderstatus) AS o_orderstatus, CASE WHEN o.o_orderkey IS NULL THEN 'insert' WHEN e.o_orderkey IS NULL THEN CASE WHEN {scope} THEN 'delete' ELSE 'keep' END WHEN o.o_orderstatus <> e.o_orderstatus THEN 'update' ELSE 'keep' END AS action"
        f" FROM (SELECT * FROM orders WHERE o_orderkey % 11 <> 0) o FULL JOIN {EDITED} e ON o.o_orderkey = e.o_orderkey)"
    )


@query(f"SELECT * FROM {_merge_sql('false')}")
def q_merge_upsert(s, d):
    return upsert.merge_upsert(*merge_sides(s, d), ["o_orderkey"])


@query(f"SELECT * FROM {_merge_sql('o.o_orderstatus = ' + chr(39) + 'F' + chr(39))}")
def q_merge_delete_scope(s, d):
    return upsert.merge_delete_scope(*merge_sides(s, d), ["o_orderkey"], F.col("o_orderstatus") == "F")


@query("SELECT c_name, c_mktsegment, CASE WHEN c_custkey % 97 = 0 THEN (SELECT max(c_custkey) FROM customer WHERE c_custkey % 97 <> 0) + row_number() OVER (PARTITION BY c_custkey % 97 = 0 ORDER BY c_name) ELSE c_custkey END AS c_custkey, CASE WHEN c_custkey % 97 = 0 THEN 'insert' ELSE 'keep' END AS action FROM customer")
def q_align_by_business_key(s, d):
    cols = ["c_custkey", "c_name", "c_mktsegment"]
    return upsert.align_by_business_key(some_customers(s, d).select(*cols), T(s, d, "customer").select(*cols), "c_custkey", ["c_name"])


@query(f"SELECT * FROM {_merge_sql('true')}")
def q_sync_modes(s, d):
    return upsert.sync_modes(*merge_sides(s, d), ["o_orderkey"], "authoritative")


@query(f"SELECT action, count(*) AS n FROM {_merge_sql('false')} GROUP BY 1")
def q_change_volume(s, d):
    return upsert.change_volume(upsert.merge_upsert(*merge_sides(s, d), ["o_orderkey"]))


@query("SELECT o_orderkey, o_custkey FROM orders")
def q_two_phase_load(s, d):
    """Orders load before customers here: the reference is deferred, then re-pointed by key."""
    from granary.contract import Contract, Table

    cyclic = Contract({t: Table(t, (k,)) for t, k in (("orders", "o_orderkey"), ("customer", "c_custkey"))}, (ORD, Reference("customer", "c_last_order", "orders", "o_orderkey")))
    c = T(s, d, "customer").withColumn("c_last_order", F.lit(1).cast("long"))
    _, first, _ = upsert.two_phase_load(cyclic, {"orders": T(s, d, "orders"), "customer": c}, {"orders.o_custkey"})
    return upsert.repoint(first["orders"], T(s, d, "orders"), "o_orderkey", ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 13 <> 0")
def q_revert_set(s, d):
    c = T(s, d, "customer").select("c_custkey", "c_name")
    return upsert.revert_set(c, "c_custkey", c.filter("c_custkey % 13 = 0").select(F.col("c_custkey").alias("assigned_key")))


@query("SELECT 1 AS step, 'orders' AS name, count(*) AS n FROM orders WHERE o_custkey % 13 = 0 AND o_orderkey % 2 = 0 UNION ALL SELECT 2, 'customer', count(*) FROM customer WHERE c_custkey % 13 = 0 UNION ALL SELECT 0, 'orders.o_custkey', count(*) FROM orders WHERE o_custkey % 13 = 0 AND o_orderkey % 2 <> 0 HAVING count(*) > 0 UNION ALL SELECT 0, 'events.user_id', count(*) FROM events WHERE user_id % 13 = 0 HAVING count(*) > 0 UNION ALL SELECT 0, 'lineitem.l_orderkey', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 13 = 0 AND o_orderkey % 2 = 0) HAVING count(*) > 0")
def q_revert_sequence(s, d):
    """Keys to remove by step, and (step 0) rows that stay and forbid it."""
    t = tables(s, d, "customer", "orders", "lineitem", "events")
    minted = {"customer": t["customer"].filter("c_custkey % 13 = 0").select(F.col("c_custkey").alias("assigned_key")), "orders": t["orders"].filter("o_custkey % 13 = 0 AND o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("assigned_key"))}
    steps, held = upsert.revert_sequence(STAR, t, minted)
    out = held.select(F.lit(0).alias("step"), F.col("reference").alias("name"), F.col("n_rows").alias("n"))
    for k, (name, keys) in enumerate(steps):
        out = out.unionByName(keys.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k + 1).alias("step"), F.lit(name).alias("name"), "n"))
    return out


# -- 2.8 closure and corrections ------------------------------------------------------------------------------------
def closed(s, d) -> dict[str, DataFrame]:
    t = tables(s, d, "orders", "customer", "nation", "region")
    held = closure.referential_closure(STAR, t, {"orders": t["orders"].filter("o_orderkey % 499 = 0")})
    return closure.closed_rows(STAR, t, held)


CLO = "SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_orderkey % 499 = 0 UNION ALL SELECT 'customer', count(DISTINCT o_custkey) FROM orders WHERE o_orderkey % 499 = 0 UNION ALL SELECT 'nation', count(DISTINCT c_nationkey) FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 499 = 0 UNION ALL SELECT 'region', count(DISTINCT n_regionkey) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey % 499 = 0"


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 499 = 0)")
def q_referential_closure(s, d):
    return closed(s, d)["customer"].select("c_custkey", "c_name")


@query(f"SELECT 'rows' AS kind, name, n FROM ({CLO}) UNION ALL SELECT 'dangling', 'orders.o_custkey', 0")
def q_closure_report(s, d):
    return closure.closure_report(STAR, closed(s, d), {"orders.o_custkey"})


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def q_referenced_pull(s, d):
    return closure.referenced_pull(STAR, tables(s, d, "customer", "nation", "region"), {"customer"})["nation"].select("n_nationkey", "n_name")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 499 = 0 AND o_orderkey % 11 = 0 THEN 'insert' ELSE 'keep' END AS action FROM orders WHERE o_orderkey % 11 <> 0 OR o_orderkey % 499 = 0")
def q_dataset_slice(s, d):
    from granary.functions.scratch import new_path

    folder = new_path(s, "slice")
    cols = ["o_orderkey", "o_custkey"]
    closure.write_slice({"orders": T(s, d, "orders").filter("o_orderkey % 499 = 0").select(*cols)}, folder)
    return closure.apply_slice(s, STAR, folder, {"orders": T(s, d, "orders").filter("o_orderkey % 11 <> 0").select(*cols)})["orders"]


@query("SELECT c_custkey, CASE WHEN c_custkey % 89 = 0 THEN c_mktsegment ELSE c_name END AS c_name FROM customer")
def q_correct_same_row(s, d):
    return correct.correct_same_row(faulty_customers(s, d), "c_custkey", "c_name", "c_mktsegment", correct.Guards(only_null=True))[0].select("c_custkey", "c_name")


@query("SELECT c_custkey, CASE WHEN c_custkey % 89 = 0 THEN n_name ELSE c_name END AS c_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def q_correct_from_parent(s, d):
    return correct.correct_from_parent(faulty_customers(s, d), "c_custkey", "c_name", "c_nationkey", T(s, d, "nation"), "n_nationkey", "n_name", correct.Guards(only_null=True))[0].select("c_custkey", "c_name")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 97 = 0 THEN 1 ELSE o_custkey END AS o_custkey FROM orders")
def q_correct_constant(s, d):
    g = correct.Guards(only_orphans=(some_customers(s, d), "c_custkey"), at_most=10**9)
    return correct.correct_constant(T(s, d, "orders"), "o_orderkey", "o_custkey", 1, g, (some_customers(s, d), "c_custkey"))[0].select("o_orderkey", "o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 97 <> 0")
def q_correct_exclude(s, d):
    inbound = [(T(s, d, "orders").filter("o_custkey % 97 <> 0"), "o_custkey")]
    return correct.correct_exclude(T(s, d, "customer"), "c_custkey", F.col("c_custkey") % 97 == 0, inbound)[0].select("c_custkey")


@query("SELECT 'at_most' AS guard, true AS ok, CAST(count(*) FILTER (c_custkey % 89 = 0) AS DOUBLE) AS measured FROM customer UNION ALL SELECT 'coverage', false, count(*) FILTER (c_custkey % 89 = 0) / count(*) FROM customer")
def q_correction_guards(s, d):
    g = correct.Guards(only_null=True, at_most=10**9, least_coverage=0.5)
    return correct.correction_guards(correct._marked(faulty_customers(s, d), "c_name", F.col("c_mktsegment"), g), g)


CORRECTED = "(SELECT c_custkey, coalesce(c_name, c_mktsegment) AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM " + FAULTY + ")"


@query(f"SELECT a.n_rows AS n_before, a.digest AS digest_before, b.n_rows AS n_after, b.digest AS digest_after, (SELECT count(*) FROM customer WHERE c_custkey % 89 = 0) AS n_changed, 0 AS n_excluded FROM ({_digest_sql(FAULTY, _CELLS)}) a, ({_digest_sql(CORRECTED, _CELLS)}) b")
def q_correction_receipt(s, d):
    before = faulty_customers(s, d)
    after, rows = correct.correct_same_row(before, "c_custkey", "c_name", "c_mktsegment", correct.Guards(only_null=True))
    return correct.correction_receipt(before, after, rows)


# -- 2.9 synthetic data ---------------------------------------------------------------------------------------------
DRAW = "CAST(('0x' || substr(md5('{seed}:{t}:{c}:' || row), 1, 15)) AS BIGINT)"
ROWS = "(SELECT range AS row FROM range(1, (SELECT count(*) FROM orders) + 1))"


def synth_rows(s, d) -> DataFrame:
    """As many rows as the profile of orders has."""
    return synth.mint_keys(s, T(s, d, "orders").count(), "o_orderkey")


def order_weights(s, d, column: str = "o_orderpriority") -> list[tuple]:
    return [(r.value, r.n) for r in profile.categorical_distribution(T(s, d, "orders"), "orders", column).orderBy("rank").collect()]


def _weighted_sql(draw: str, column: str) -> str:
    return f"(SELECT r.row, min_by(w.value, w.cum) AS value FROM (SELECT row, {draw} AS dr FROM {ROWS}) r, (SELECT value, sum(n) OVER (ORDER BY n DESC, value) AS cum, sum(n) OVER () AS total FROM (SELECT {column} AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 50)) w WHERE r.dr % CAST(w.total AS BIGINT) < w.cum GROUP BY r.row)"


@query(f"SELECT row, row AS o_orderkey FROM {ROWS}")
def q_mint_keys(s, d):
    return synth_rows(s, d)


POOL = "(SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS p FROM customer)"


@query(f"SELECT row, o_orderkey, c_custkey AS o_custkey FROM (SELECT row, row AS o_orderkey, {DRAW.format(seed=7, t='orders', c='o_custkey')} % (SELECT count(*) FROM customer) + 1 AS p FROM {ROWS}) JOIN {POOL} USING (p)")
def q_draw_fk_uniform(s, d):
    return synth.draw_fk_uniform(synth_rows(s, d), 7, "orders", "o_custkey", T(s, d, "customer"), "c_custkey")


@query(f"SELECT row, o_orderkey, c_custkey AS o_custkey FROM (SELECT row, row AS o_orderkey, {DRAW.format(seed=7, t='orders', c='o_custkey')} % CAST(ceil((SELECT count(*) FROM customer) * 0.3) AS BIGINT) + 1 AS p FROM {ROWS}) JOIN {POOL} USING (p)")
def q_draw_fk_clustered(s, d):
    return synth.draw_fk_clustered(synth_rows(s, d), 7, "orders", "o_custkey", T(s, d, "customer"), "c_custkey")


@query(f"SELECT row, row AS o_orderkey, value AS o_custkey FROM {_weighted_sql(DRAW.format(seed=7, t='orders', c='o_custkey'), 'o_custkey')}")
def q_draw_fk_weighted(s, d):
    return synth.draw_fk_weighted(synth_rows(s, d), 7, "orders", "o_custkey", order_weights(s, d, "o_custkey"))


JOINT = "(SELECT *, sum(n) OVER (ORDER BY n DESC, l_partkey, l_suppkey) AS cum, sum(n) OVER () AS total FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY n DESC, l_partkey, l_suppkey LIMIT 100))"


@query(f"SELECT r.row, r.row AS o_orderkey, min_by(l_partkey, cum) AS l_partkey, min_by(l_suppkey, cum) AS l_suppkey FROM (SELECT row, {DRAW.format(seed=7, t='lineitem', c='l_partkey+l_suppkey')} AS dr FROM {ROWS}) r, {JOINT} w WHERE r.dr % CAST(w.total AS BIGINT) < w.cum GROUP BY r.row")
def q_draw_fk_joint(s, d):
    joint = profile.joint_distribution(T(s, d, "lineitem"), ["l_partkey", "l_suppkey"])
    return synth.draw_fk_joint(synth_rows(s, d), 7, "lineitem", ["l_partkey", "l_suppkey"], joint)


MINTED = "(SELECT 'k:' || range AS key, row_number() OVER (ORDER BY 'k:' || range) AS p FROM range(1, (SELECT count(*) FROM {t}) + 1))"


@query(f"SELECT row, o_orderkey, key AS o_custkey FROM (SELECT r.row, r.row AS o_orderkey, min(w.p) AS p FROM (SELECT row, {DRAW.format(seed=7, t='orders', c='o_custkey')} AS dr FROM {ROWS}) r, (SELECT row_number() OVER (ORDER BY n DESC, value) AS p, sum(n) OVER (ORDER BY n DESC, value) AS cum, sum(n) OVER () AS total FROM (SELECT o_custkey AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 50)) w WHERE r.dr % CAST(w.total AS BIGINT) < w.cum GROUP BY r.row) JOIN {MINTED.format(t='customer')} USING (p)")
def q_draw_fk_weighted_of_minted_pool(s, d):
    """The fan-out of the source over parents whose keys were minted anew."""
    parents = synth.mint_keys(s, T(s, d, "customer").count(), "c_custkey", "string")
    return synth.draw_fk_weighted(synth_rows(s, d), 7, "orders", "o_custkey", order_weights(s, d, "o_custkey"), parents, "c_custkey")


_ranks = lambda c: f"(SELECT {c}, row_number() OVER (ORDER BY sum(n) DESC, {c}) AS rank FROM {JOINT} GROUP BY {c})"


@query(f"SELECT row, o_orderkey, a.key AS l_partkey, b.key AS l_suppkey FROM (SELECT r.row, r.row AS o_orderkey, min_by(l_partkey, cum) AS l_partkey, min_by(l_suppkey, cum) AS l_suppkey FROM (SELECT row, {DRAW.format(seed=7, t='lineitem', c='l_partkey+l_suppkey')} AS dr FROM {ROWS}) r, {JOINT} w WHERE r.dr % CAST(w.total AS BIGINT) < w.cum GROUP BY r.row) JOIN {_ranks('l_partkey')} x USING (l_partkey) JOIN {_ranks('l_suppkey')} y USING (l_suppkey) JOIN {MINTED.format(t='part')} a ON a.p = least(x.rank, (SELECT count(*) FROM part)) JOIN {MINTED.format(t='supplier')} b ON b.p = least(y.rank, (SELECT count(*) FROM supplier))")
def q_draw_fk_joint_of_minted_pools(s, d):
    joint = profile.joint_distribution(T(s, d, "lineitem"), ["l_partkey", "l_suppkey"])
    pools = {"l_partkey": (synth.mint_keys(s, T(s, d, "part").count(), "p_partkey", "string"), "p_partkey"), "l_suppkey": (synth.mint_keys(s, T(s, d, "supplier").count(), "s_suppkey", "string"), "s_suppkey")}
    return synth.draw_fk_joint(synth_rows(s, d), 7, "lineitem", ["l_partkey", "l_suppkey"], joint, pools)


@query(f"SELECT row, CASE WHEN {DRAW.format(seed=7, t='orders', c='note#null')} % (SELECT count(*) FROM orders) >= 100 THEN row END AS note FROM {ROWS}")
def q_draw_null(s, d):
    r = synth_rows(s, d)
    return r.select("row", synth.draw_null(F.col("row"), 7, "orders", "note", 100, T(s, d, "orders").count()).alias("note"))


@query(f"SELECT row, 'u:' || substr(md5('7:orders:code'), 1, 8) || ':' || row AS code FROM {ROWS}")
def q_draw_unique(s, d):
    return synth_rows(s, d).select("row", synth.draw_unique(7, "orders", "code").alias("code"))


@query(f"SELECT row, value AS o_orderpriority FROM {_weighted_sql(DRAW.format(seed=7, t='orders', c='o_orderpriority'), 'o_orderpriority')}")
def q_draw_categorical(s, d):
    return synth_rows(s, d).select("row", synth.draw_categorical(7, "orders", "o_orderpriority", order_weights(s, d)).alias("o_orderpriority"))


@query(f"SELECT row, round(CASE WHEN u < 0.5 THEN 0.0 + (u - 0.0) / (0.5 - 0.0) * (100.0 - 0.0) ELSE 100.0 + (u - 0.5) / 0.5 * 900.0 END, 6) AS v FROM (SELECT row, ({DRAW.format(seed=7, t='orders', c='v')} % 1000000) / 1000000.0 AS u FROM {ROWS})")
def q_draw_numeric(s, d):
    return synth_rows(s, d).select("row", F.round(synth.draw_numeric(7, "orders", "v", [(0.0, 0.0), (0.5, 100.0), (1.0, 1000.0)]), 6).alias("v"))


@query(f"SELECT row, '' AS a, 0 AS b FROM {ROWS}")
def q_draw_default(s, d):
    return synth_rows(s, d).select("row", synth.draw_default("string").alias("a"), synth.draw_default("bigint").alias("b"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 97 = 0 THEN 'authored' ELSE c_name END AS c_name FROM customer")
def q_pin_rows(s, d):
    c = T(s, d, "customer").select("c_custkey", "c_name")
    return synth.pin_rows(c, c.filter("c_custkey % 97 = 0").withColumn("c_name", F.lit("authored")), "c_custkey")


@query(f"SELECT row, round(10 + q * q * 90, 6) AS early, round(10 + (1 - (1 - q) * (1 - q)) * 90, 6) AS late FROM (SELECT row, ({DRAW.format(seed=7, t='orders', c='w')} % 1000000) / 1000000.0 AS q FROM {ROWS})")
def q_scenario_between(s, d):
    return synth_rows(s, d).select("row", F.round(synth.scenario_between(7, "orders", "w", 10, 100, "early"), 6).alias("early"), F.round(synth.scenario_between(7, "orders", "w", 10, 100, "late"), 6).alias("late"))


@query("SELECT 'orders' AS \"table\", 'o_orderpriority' AS \"column\", 'v' || row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) AS value, count(*) AS n FROM orders GROUP BY o_orderpriority")
def q_evidence_shape(s, d):
    return synth.evidence_shape(profile.categorical_distribution(T(s, d, "orders"), "orders", "o_orderpriority")).select("table", "column", "value", "n")


@query("SELECT c_custkey, CASE CAST(('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 15)) AS BIGINT) % 2 WHEN 0 THEN 'Ada' ELSE 'Bo' END AS c_name FROM customer")
def q_substitute_pii(s, d):
    people = [("Ada", "a@x.invalid", "1", "A st"), ("Bo", "b@x.invalid", "2", "B st")]
    c = T(s, d, "customer").select("c_custkey", "c_name")
    return synth.substitute_pii(c, "c_custkey", {"c_name": "person"}, people)


@query("SELECT 'customer' AS \"table\", true AS covered UNION ALL SELECT 'orders', false")
def q_evidence_coverage(s, d):
    return synth.evidence_coverage(["customer", "orders"], profile.null_counts(T(s, d, "customer"), "customer"))


@query("SELECT 0 AS n_orphans, 0 AS n_foreign_values")
def q_synthetic_check(s, d):
    rows = synth.draw_fk_uniform(synth_rows(s, d), 7, "orders", "o_custkey", T(s, d, "customer"), "c_custkey")
    rows = rows.withColumn("p", synth.draw_categorical(7, "orders", "p", order_weights(s, d)))
    a = profile.orphans(rows, ORD, T(s, d, "customer")).agg(F.count(F.lit(1)).alias("n_orphans"))
    b = rows.join(T(s, d, "orders").select(F.col("o_orderpriority").alias("p")).distinct(), "p", "left_anti").agg(F.count(F.lit(1)).alias("n_foreign_values"))
    return a.join(b)


@query("SELECT 'orders' AS \"table\", c AS \"column\", 0.0 AS null_share_delta FROM (VALUES ('o_orderkey'), ('o_custkey')) t(c)")
def q_reprofile_fidelity(s, d):
    rows = synth.draw_fk_uniform(synth_rows(s, d), 7, "orders", "o_custkey", T(s, d, "customer"), "c_custkey").drop("row")
    return synth.reprofile_fidelity(profile.column_profile(T(s, d, "orders"), "orders", ["o_orderkey", "o_custkey"]), profile.column_profile(rows, "orders"))


_PTS = [0.0, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]


def _below(x: str, v: str) -> str:
    """The share of values up to x by straight lines between the points in a list."""
    lines = "".join(f" WHEN {x} >= {v}[{k + 1}] THEN {p} + ({q} - {p}) * ({x} - {v}[{k + 1}]) / ({v}[{k + 2}] - {v}[{k + 1}])" for k, (p, q) in reversed(list(enumerate(zip(_PTS[:-1], _PTS[1:], strict=True)))))
    return f"CASE WHEN {x} >= {v}[7] THEN 1.0 WHEN {x} < {v}[1] THEN 0.0{lines} END"


OTHERS = f"(SELECT * FROM {FAULTY} WHERE c_custkey % 2 = 0 AND c_acctbal > 0)"


@query(
    " UNION ALL ".join(f"SELECT 'null_share' AS axis, 'customer.{c}' AS subject, round(abs((SELECT (count(*) - count({c})) / count(*) FROM customer) - (SELECT (count(*) - count({c})) / count(*) FROM {OTHERS})), 6) AS distance" for c in ("c_name", "c_mktsegment"))
    + f" UNION ALL SELECT 'categorical_distribution', 'customer.c_mktsegment', round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 6) FROM (SELECT c_mktsegment AS v, count(*) / sum(count(*)) OVER () AS p FROM customer GROUP BY 1) FULL JOIN (SELECT c_mktsegment AS v, count(*) / sum(count(*)) OVER () AS q FROM {OTHERS} GROUP BY 1) USING (v)"
    + f" UNION ALL SELECT 'numeric_distribution', 'customer.c_acctbal', round(max(abs({_below('x', 'a')} - {_below('x', 'b')})), 6) FROM (SELECT a, b, unnest(list_concat(a, b)) AS x FROM (SELECT quantile_cont(c_acctbal, {_PTS}) AS a FROM customer), (SELECT quantile_cont(c_acctbal, {_PTS}) AS b FROM {OTHERS}))"
)
def q_reprofile_distances(s, d):
    """How far customers of one kind, with faults, are from all customers, on every axis."""

    def axes(df: DataFrame) -> dict[str, DataFrame]:
        return {"column_profile": profile.column_profile(df, "customer", ["c_name", "c_mktsegment"]), "categorical_distribution": profile.categorical_distribution(df, "customer", "c_mktsegment"), "numeric_distribution": profile.numeric_distribution(df, "customer", ["c_acctbal"])}

    found = synth.reprofile_distances(axes(T(s, d, "customer")), axes(faulty_customers(s, d).filter("c_custkey % 2 = 0 AND c_acctbal > 0")))
    return found.withColumn("distance", F.round("distance", 6))


@query(f"SELECT 'orphans' AS \"check\", 'o_custkey' AS subject, count(*) AS n, count(*) = 0 AS passed FROM (SELECT {DRAW.format(seed=7, t='orders', c='o_custkey')} % (SELECT count(*) FROM customer) + 1 AS p FROM {ROWS}) JOIN {POOL} USING (p) WHERE c_custkey % 97 = 0 UNION ALL SELECT 'foreign_values', 'p', count(*), count(*) = 0 FROM {_weighted_sql(DRAW.format(seed=7, t='orders', c='p'), 'o_orderpriority')} WHERE value = (SELECT min(o_orderpriority) FROM orders) UNION ALL SELECT 'same_seed', 'rows', 0, true")
def q_synthetic_check_of_faults(s, d):
    """Rows drawn from more parents and more values than they are held against."""

    def rows() -> DataFrame:
        out = synth.draw_fk_uniform(synth_rows(s, d), 7, "orders", "o_custkey", T(s, d, "customer"), "c_custkey")
        return out.withColumn("p", synth.draw_categorical(7, "orders", "p", order_weights(s, d)))

    least = T(s, d, "orders").agg(F.min("o_orderpriority"))
    known = T(s, d, "orders").select(F.col("o_orderpriority").alias("value")).distinct().filter(F.col("value") != least.scalar())
    return synth.synthetic_check(rows(), rows(), {"o_custkey": (some_customers(s, d), "c_custkey")}, {"p": known})


# -- 2.10 graphs ----------------------------------------------------------------------------------------------------
def part_supplier(s, d) -> DataFrame:
    return T(s, d, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 10_000_000).alias("dst"))


customer_orders = lambda s, d: T(s, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 10_000_000).alias("dst"))
CO = "(SELECT o_custkey AS src, o_orderkey + 10000000 AS dst FROM orders)"


#: Chains of ``LINKS`` orders each: deeper than any number of rounds that one might think enough.
LINKS = 150
CHAIN = f"(SELECT o_orderkey AS src, o_orderkey + 1 AS dst FROM orders WHERE o_orderkey % {LINKS} <> {LINKS - 1})"


def order_chains(s, d) -> DataFrame:
    return T(s, d, "orders").filter(F.col("o_orderkey") % LINKS != LINKS - 1).select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") + 1).alias("dst"))


@query(f"SELECT src AS node, src // {LINKS} * {LINKS} AS component FROM {CHAIN} UNION SELECT dst, dst // {LINKS} * {LINKS} FROM {CHAIN}")
def q_connected_components(s, d):
    return connected_components(order_chains(s, d))


@query()
def q_pagerank(s, d):
    return graph.pagerank(part_supplier(s, d))


@query()
def q_label_propagation(s, d):
    return graph.label_propagation(part_supplier(s, d))


@query(f"WITH e AS (SELECT 'n' || c_nationkey AS a, 'c' || c_custkey AS b FROM customer UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation) SELECT a AS root, b AS node FROM e WHERE a LIKE 'r%' UNION ALL SELECT x.a, y.b FROM e x JOIN e y ON x.b = y.a WHERE x.a LIKE 'r%'")
def q_reachable_sets(s, d):
    e = T(s, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"))
    n = T(s, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    return graph.reachable_sets(e.unionByName(n), n.select(F.col("src").alias("node")).distinct(), 1)


@query(f"SELECT DISTINCT src AS node, 0 AS level FROM {CO} UNION ALL SELECT DISTINCT dst, 1 FROM {CO}")
def q_dependency_levels(s, d):
    return graph.dependency_levels(customer_orders(s, d))


@query(f"SELECT src AS node, src % 20 AS level FROM (SELECT o_orderkey AS src FROM orders) UNION SELECT o_orderkey + 1, (o_orderkey + 1) % 20 FROM orders WHERE o_orderkey % 20 <> 19")
def q_dependency_levels_of_chains(s, d):
    chains = T(s, d, "orders").filter("o_orderkey % 20 <> 19").select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") + 1).alias("dst"))
    return graph.dependency_levels(chains)


#: In each ten orders a cycle of three, two below it, a chain of three and an order that depends on itself.
CYCLIC = "(SELECT o_orderkey AS src, o_orderkey + 1 AS dst FROM orders WHERE o_orderkey % 10 IN (0, 1, 2, 3, 5, 6) UNION ALL SELECT o_orderkey, o_orderkey - 2 FROM orders WHERE o_orderkey % 10 = 2 UNION ALL SELECT o_orderkey, o_orderkey FROM orders WHERE o_orderkey % 10 = 8)"
_REACH = f"e AS (SELECT * FROM {CYCLIC}), r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), c AS (SELECT node, coalesce(min(x.b), node) AS component, count(x.b) > 0 AS cycle FROM n LEFT JOIN (SELECT x.a, x.b FROM r x JOIN r y ON y.a = x.b AND y.b = x.a) x ON x.a = node GROUP BY node)"


def cyclic_orders(s, d) -> DataFrame:
    k = F.col("o_orderkey")
    last = F.pmod(k, F.lit(10))
    to = F.array_compact(F.array(F.when(last.isin(0, 1, 2, 3, 5, 6), k + 1), F.when(last == 2, k - 2), F.when(last == 8, k)))
    return T(s, d, "orders").select(k.alias("src"), F.explode(to).alias("dst"))


@query(f"WITH RECURSIVE {_REACH} SELECT node, component FROM c")
def q_strong_components(s, d):
    return graph.strong_components(cyclic_orders(s, d))


@query(f"WITH RECURSIVE {_REACH}, g AS (SELECT DISTINCT x.component AS a, y.component AS b FROM e JOIN c x ON x.node = e.src JOIN c y ON y.node = e.dst WHERE x.component <> y.component), p AS (SELECT DISTINCT component, 0 AS level FROM c UNION SELECT g.b, p.level + 1 FROM p JOIN g ON g.a = p.component), l AS (SELECT component, max(level) AS level FROM p GROUP BY 1) SELECT node, component, level, CASE WHEN cycle THEN 'cycle' WHEN EXISTS (SELECT 1 FROM r JOIN c q ON q.node = r.a WHERE r.b = c.node AND q.cycle) THEN 'below_cycle' ELSE 'ordered' END AS state FROM c JOIN l USING (component)")
def q_dependency_order(s, d):
    return graph.dependency_order(cyclic_orders(s, d))


# -- sinks and files: written to the shared folder and read back ----------------------------------------------------
@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN c_custkey % 89 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN '' ELSE c_name END AS c_name FROM customer")
def q_csv_sink(s, d):
    from granary.functions.scratch import new_path

    path = new_path(s, "csv")
    src.csv_sink(faulty_customers(s, d).withColumn("c_name", F.when((F.col("c_custkey") % 7 == 0) & F.col("c_name").isNotNull(), "").otherwise(F.col("c_name"))), path, ["c_custkey", "c_name"])
    return s.read.option("header", True).option("lineSep", "\r\n").option("nullValue", "\\N").option("emptyValue", "").schema("c_custkey string, c_name string").csv(path)


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS username, lower(c_name) || '@x.invalid' AS email, CASE WHEN c_custkey % 89 = 0 THEN 'rejected' ELSE 'kept' END AS state FROM customer WHERE c_custkey % 89 <> 0 UNION ALL SELECT NULL, c_name, lower(c_name) || '@x.invalid', 'rejected' FROM customer WHERE c_custkey % 89 = 0")
def q_read_user_inventory(s, d):
    from granary.functions.scratch import new_path

    path = new_path(s, "users")
    rows = T(s, d, "customer").select(F.when(F.col("c_custkey") % 89 != 0, F.concat(F.lit(" "), "c_custkey")).alias("UserId"), F.col("c_name").alias("User_Name"), F.concat(F.lower("c_name"), F.lit("@x.invalid")).alias("E_Mail"))
    rows.write.option("header", True).csv(path)
    good, bad = src.read_user_inventory(s, path)
    cols = ["id", "username", "email"]
    return good.select(*cols, F.lit("kept").alias("state")).unionByName(bad.select(*cols, F.lit("rejected").alias("state")))


@query("SELECT CAST(c_custkey AS VARCHAR) AS source_key, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey + 1 AS VARCHAR) END AS target_key FROM customer")
def q_read_user_map(s, d):
    from granary.functions.scratch import new_path

    path = new_path(s, "map")
    rows = T(s, d, "customer").select(F.col("c_custkey").cast("string").alias("SourceUserId"), F.when(F.col("c_custkey") % 2 == 0, (F.col("c_custkey") + 1).cast("string")).alias("TargetUserId"), F.lit("auto").alias("Rationale"))
    rows.write.option("header", True).csv(path)
    return src.read_user_map(s, path).select("source_key", "target_key")


@query(f"SELECT 'dev' AS env, \"table\", \"column\", n_rows, n_nulls FROM ({NN}) UNION ALL SELECT 'prod', \"table\", \"column\", n_rows, 0 FROM ({NN})")
def q_profile_store(s, d):
    from granary.functions.scratch import new_path

    path = new_path(s, "profiles")
    src.save_profile(profile.null_counts(faulty_customers(s, d), "customer"), path, "dev")
    src.save_profile(profile.null_counts(T(s, d, "customer"), "customer"), path, "prod")
    return src.load_profile(s, path).select("env", "table", "column", "n_rows", "n_nulls")


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def q_distribution_export(s, d):
    from granary.functions.scratch import new_path

    path = new_path(s, "distributions")
    src.distribution_export(profile.categorical_distribution(T(s, d, "orders"), "orders", "o_orderpriority"), path)
    return s.read.schema("value string, n long").json(path)


@query("SELECT 2 * count(*) AS n_changes, (SELECT count(*) FROM orders) AS n_rows FROM orders WHERE o_orderkey % 97 <> 0")
def q_wipe_and_load(s, d):
    from granary.functions.scratch import new_path

    path = new_path(s, "wipe")
    src.wipe_and_load(edited_orders(s, d), path)
    n = src.wipe_and_load(T(s, d, "orders"), path)
    return s.read.parquet(path).agg(F.lit(n).cast("long").alias("n_changes"), F.count(F.lit(1)).alias("n_rows"))


@query("SELECT 'customer' AS \"table\", (c_custkey - m) // w AS chunk, min(c_custkey) AS first_key, max(c_custkey) AS last_key, count(*) AS n_rows FROM customer, (SELECT min(c_custkey) AS m, (max(c_custkey) - min(c_custkey)) // 4 + 1 AS w FROM customer) GROUP BY ALL")
def q_resumable_load(s, d):
    from granary.functions.scratch import new_path

    path, c = new_path(s, "load"), T(s, d, "customer")
    low, high = c.agg(F.min("c_custkey"), F.max("c_custkey")).first()
    src.resumable_load(c, path, "c_custkey", (high - low) // 4 + 1, "customer")
    return src.resumable_load(c, path, "c_custkey", (high - low) // 4 + 1, "customer").drop("mark")


# -- the rest of the expressions and of the synthesis ---------------------------------------------------------------
@query(f"SELECT c_custkey, coalesce(c_name, '') = '' AS none, coalesce(c_mktsegment, '') IN ('BUILDING', '') AS some, c_acctbal IS NULL AS empty, c_acctbal > 0 AND c_nationkey < 9 AS free FROM {FAULTY}")
def q_predicate(s, d):
    return faulty_customers(s, d).select("c_custkey", cells.equals("c_name", "").alias("none"), cells.is_in("c_mktsegment", ["BUILDING", ""]).alias("some"), F.col("c_acctbal").isNull().alias("empty"), cells.raw("c_acctbal > 0 AND c_nationkey < 9").alias("free"))


@query(f"SELECT c_custkey, coalesce(trim(c_name) <> '', false) AS is_key FROM {FAULTY}")
def q_is_key(s, d):
    return faulty_customers(s, d).select("c_custkey", cells.is_key("c_name").alias("is_key"))


@query(f"SELECT o.o_orderkey, CASE WHEN o.o_orderstatus <> e.o_orderstatus THEN ['o_orderstatus'] ELSE [] END AS columns FROM orders o JOIN {EDITED} e USING (o_orderkey)")
def q_differing_columns(s, d):
    both = diff._sides(T(s, d, "orders"), edited_orders(s, d), ["o_orderkey"]).filter("in_a AND in_b")
    return both.select(F.col("a_o_orderkey").alias("o_orderkey"), diff.differing_columns(OCOLS[1:]).alias("columns"))


@query("SELECT 'orders.o_custkey' AS reference")
def q_unsatisfiable_fk(s, d):
    found = synth.unsatisfiable_fk({"customer": T(s, d, "customer").filter("c_custkey < 0"), "nation": T(s, d, "nation")}, {"orders.o_custkey": "customer", "customer.c_nationkey": "nation"})
    return s.createDataFrame([(x,) for x in found], "reference string").join(profile.reference_value_counts(tables(s, d, "orders"), [ORD]).select("reference").distinct(), "reference", "left_semi")


@query(f"SELECT row, row AS o_orderkey, [10, 20, 30][CAST({DRAW.format(seed=7, t='orders', c='o_custkey')} % 3 + 1 AS INT)] AS o_custkey FROM {ROWS}")
def q_provided_pools(s, d):
    return synth.draw_fk_uniform(synth_rows(s, d), 7, "orders", "o_custkey", synth.provided_pool(s, [10, 20, 30], "c_custkey"), "c_custkey")


@query(f"SELECT row, CASE WHEN {DRAW.format(seed=7, t='orders', c='tier')} % 10 < 9 THEN 'a' ELSE 'c' END AS tier FROM {ROWS}")
def q_scenario_weights(s, d):
    return synth_rows(s, d).select("row", synth.draw_categorical(7, "orders", "tier", synth.scenario_weights([("a", 6), ("b", 3)], {"a": 9, "b": 0, "c": 1})).alias("tier"))


@query("SELECT CAST(round(2.5 * count(*)) AS BIGINT) AS n FROM customer")
def q_scenario_per_parent(s, d):
    return synth.mint_keys(s, synth.scenario_per_parent(2.5, T(s, d, "customer").count()), "k").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT \"table\", \"column\", n_rows, CASE WHEN \"column\" = 'c_name' THEN n_nulls ELSE 0 END AS n_nulls FROM ({NN})")
def q_layer_evidence(s, d):
    over = profile.null_counts(faulty_customers(s, d), "customer", ["c_name"])
    return synth.layer_evidence(profile.null_counts(T(s, d, "customer"), "customer"), over, ["table", "column"])
