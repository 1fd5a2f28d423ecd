"""Synthetic data from a profile. Every cell depends on (seed, table, column, row) only, so on no partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions.cells import cell_draw, weighted_pick
from granary.functions.scratch import union
from granary.operators.diff import table_digest
from granary.operators.reconcile import numbered


def mint_keys(spark: SparkSession, n: int, key: str, kind: str = "long") -> DataFrame:
    """One unique key per row, from 1, with ``row``."""
    rows = spark.range(1, n + 1).withColumnRenamed("id", "row")
    value = {"long": F.col("row"), "string": F.concat(F.lit("k:"), F.col("row").cast("string")), "guid": F.md5(F.col("row").cast("string"))}[kind]
    return rows.withColumn(key, value)


def boosted_rows(n: int, score: float, mean: float, strength: float = 1.0, cap: float = 5.0) -> int:
    """Row count boosted by a centrality score."""
    return round(n * min(cap, 1 + strength * max(0.0, (score / mean if mean else 0.0) - 1)))


def _pool(parent: DataFrame, key: str) -> DataFrame:
    return numbered(parent.select(F.col(key).alias("pool_key")).distinct(), ["pool_key"], "pool_row")


def draw_fk_uniform(rows: DataFrame, seed: int, table: str, column: str, parent: DataFrame, key: str) -> DataFrame:
    """A parent key for every row: no orphan by construction; NULL when the pool is empty."""
    pool = _pool(parent, key)
    n = pool.count()
    at = F.pmod(cell_draw(seed, table, column, "row"), F.lit(max(n, 1))) + 1
    return rows.withColumn("_at", at).join(pool.withColumnRenamed("pool_row", "_at"), "_at", "left").withColumnRenamed("pool_key", column).drop("_at")


def draw_fk_clustered(rows: DataFrame, seed: int, table: str, column: str, parent: DataFrame, key: str, share: float = 0.3) -> DataFrame:
    """References of one cluster fall into the first part of the pool."""
    pool = _pool(parent, key)
    n = max(1, -int(-pool.count() * share // 1))
    at = F.pmod(cell_draw(seed, table, column, "row"), F.lit(n)) + 1
    return rows.withColumn("_at", at).join(pool.withColumnRenamed("pool_row", "_at"), "_at", "left").withColumnRenamed("pool_key", column).drop("_at")


def _at_pool(rows: DataFrame, at: Column, column: str, parent: DataFrame, key: str) -> DataFrame:
    """The pool's key at a position from 0, the last one beyond its end; NULL when the pool is empty."""
    pool = _pool(parent, key)
    n = pool.count()
    rows = rows.withColumn("_at", F.least(at, F.lit(max(n, 1) - 1)) + 1)
    return rows.join(pool.withColumnRenamed("pool_row", "_at"), "_at", "left").withColumnRenamed("pool_key", column).drop("_at")


def draw_fk_weighted(rows: DataFrame, seed: int, table: str, column: str, weights: list[tuple[int, int]], parent: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """A parent by its observed frequency; ``weights`` is a top list of (key, n), the most frequent first.

    With ``parent`` and ``key`` the evidence holds by rank: the most referenced key stands for the first of the parent's
    keys in order, and so on, so keys that were minted anew have the fan-out of the source and no orphan comes to be; ranks
    behind the pool's end have no weight.
    """
    draw = cell_draw(seed, table, column, "row")
    if parent is None or key is None:
        return rows.withColumn(column, weighted_pick(draw, weights))
    n = parent.select(key).distinct().count()
    ranked = [(rank, w) for rank, (_, w) in enumerate(sorted(weights, key=lambda x: -x[1]))][: max(n, 1)]
    return _at_pool(rows, weighted_pick(draw, ranked).cast("long"), column, parent, key)


def draw_fk_joint(rows: DataFrame, seed: int, table: str, columns: list[str], tuples: DataFrame, pools: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """Correlated references: one draw per row picks a tuple of (columns..., n), a list of at most some hundred.

    With ``pools`` (column -> parent and key) each position's values are ranked by how often the tuples have them, and a
    value stands for the pool's key at its rank (the last one beyond the pool's end), so which parents go together is kept.
    """
    found = tuples.orderBy(F.col("n").desc(), *columns).select(*columns, "n").collect()
    at = weighted_pick(cell_draw(seed, table, "+".join(columns), "row"), [(i, r["n"]) for i, r in enumerate(found)])
    if pools is None:
        few = rows.sparkSession.createDataFrame([(i, *[r[c] for c in columns]) for i, r in enumerate(found)], "_at int, " + ", ".join(f"{c} {dict(tuples.dtypes)[c]}" for c in columns))
        return rows.withColumn("_at", at).join(F.broadcast(few), "_at", "left").drop("_at")
    ranks = {}
    for c in columns:
        n: dict = {}
        for r in found:
            n[r[c]] = n.get(r[c], 0) + r["n"]
        ranks[c] = {v: k for k, v in enumerate(sorted(n, key=lambda v: (-n[v], v)))}
    few = rows.sparkSession.createDataFrame([(i, *[ranks[c][r[c]] for c in columns]) for i, r in enumerate(found)], "_tuple int, " + ", ".join(f"_rank_{c} long" for c in columns))
    out = rows.withColumn("_tuple", at).join(F.broadcast(few), "_tuple", "left").drop("_tuple")
    for c in columns:
        out = _at_pool(out, F.col(f"_rank_{c}"), c, *pools[c]).drop(f"_rank_{c}")
    return out


def draw_null(value: Column, seed: int, table: str, column: str, n_nulls: int, n_rows: int) -> Column:
    """NULL at the observed rate, compared as integers."""
    return F.when(F.pmod(cell_draw(seed, table, column + "#null", "row"), F.lit(max(n_rows, 1))) >= n_nulls, value)


def draw_unique(seed: int, table: str, column: str) -> Column:
    return F.concat(F.lit("u:"), F.substring(F.md5(F.lit(f"{seed}:{table}:{column}")), 1, 8), F.lit(":"), F.col("row").cast("string"))


def draw_categorical(seed: int, table: str, column: str, weights: list[tuple[str, int]], truncated: bool = False, limit: int = 50) -> Column:
    """An observed value by weight, or its token when the vocabulary is long or cut."""
    picked = weighted_pick(cell_draw(seed, table, column, "row"), weights)
    keep = len(weights) <= limit and not truncated
    return picked if keep else F.concat(F.lit("t:"), F.substring(F.sha2(picked, 256), 1, 8))


def draw_numeric(seed: int, table: str, column: str, points: list[tuple[float, float]]) -> Column:
    """Between percentiles: ``points`` are (share, value) from 0 to 1; a segment by mass, then interpolation, clamped."""
    u = F.pmod(cell_draw(seed, table, column, "row"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    out = None
    for (a, x), (b, y) in zip(points[:-1], points[1:], strict=True):
        value = F.lit(float(x)) + (u - a) / (b - a) * (y - x)
        out = F.when(u < b, value) if out is None else out.when(u < b, value)
    return F.least(F.greatest(out.otherwise(float(points[-1][1])), F.lit(float(points[0][1]))), F.lit(float(points[-1][1])))


def draw_default(kind: str) -> Column:
    defaults = {"string": "''", "bigint": "0L", "int": "0", "double": "0D", "boolean": "false", "date": "date'2000-01-01'", "timestamp": "timestamp'2000-01-01 00:00:00'"}
    return F.expr(defaults.get(kind, "null"))


def unsatisfiable_fk(parents: dict[str, DataFrame], mandatory: dict[str, str]) -> list[str]:
    """References (name -> parent) that can't be NULL though their parent has no rows."""
    return sorted(r for r, p in mandatory.items() if not parents[p].limit(1).count())


def pin_rows(generated: DataFrame, authored: DataFrame, key: str) -> DataFrame:
    """Authored rows in place of generated ones with their key."""
    return generated.join(authored.select(key), key, "left_anti").unionByName(authored)


def provided_pool(spark: SparkSession, keys: list, key: str, kind: str = "long") -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], f"{key} {kind}")


def scenario_weights(weights: list[tuple[str, int]], overrides: dict[str, int]) -> list[tuple[str, int]]:
    return [(v, overrides.get(v, w)) for v, w in weights] + [(v, w) for v, w in overrides.items() if v not in dict(weights)]


def scenario_between(seed: int, table: str, column: str, low: float, high: float, skew: str = "uniform") -> Column:
    """A value in a window: ``uniform``, ``early`` (q squared) or ``late``."""
    q = F.pmod(cell_draw(seed, table, column, "row"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    q = {"uniform": q, "early": q * q, "late": 1 - (1 - q) * (1 - q)}[skew]
    return F.lit(float(low)) + q * (high - low)


def scenario_per_parent(mean: float, parents: int) -> int:
    return round(mean * parents)


def evidence_shape(categorical: DataFrame) -> DataFrame:
    """A categorical distribution without its real values: tokens by rank."""
    return categorical.withColumn("value", F.concat(F.lit("v"), F.col("rank").cast("string")))


def layer_evidence(base: DataFrame, over: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``over`` in place of those of ``base`` with the same keys."""
    return over.unionByName(base.join(over.select(*keys).distinct(), keys, "left_anti"))


#: Name stems that mark a column as personal; of names only those of people, so p_name or last_update aren't.
PII_STEMS = {"email": ("email", "e_mail"), "phone": ("phone", "mobile"), "address": ("address", "street", "postal", "zip"), "person": ("firstname", "lastname", "fullname", "surname", "givenname")}


def pii_columns(columns: list[str]) -> dict[str, str]:
    out = {}
    for c in columns:
        for kind, stems in PII_STEMS.items():
            if any(s in c.lower() for s in stems):
                out.setdefault(c, kind)
    return out


def substitute_pii(df: DataFrame, key: str, columns: dict[str, str], people: list[tuple[str, str, str, str]]) -> DataFrame:
    """Stable fakes for flagged columns (column -> kind): one person (person, email, phone, address) per row key."""
    pool = df.sparkSession.createDataFrame([(i, *p) for i, p in enumerate(people)], "_at long, _person string, _email string, _phone string, _address string")
    at = F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 15), 16, 10).cast("long"), F.lit(len(people)))
    out = df.withColumn("_at", at).join(F.broadcast(pool), "_at")
    for c, kind in columns.items():
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.col(f"_{kind}")))
    return out.select(*df.columns)


def evidence_coverage(tables: list[str], evidence: DataFrame) -> DataFrame:
    """(table, covered) for every table of the contract."""
    every = evidence.sparkSession.createDataFrame([(t,) for t in tables], "table string")
    return every.join(evidence.select("table", F.lit(True).alias("c")).distinct(), "table", "left").select("table", F.coalesce("c", F.lit(False)).alias("covered"))


def reprofile_fidelity(source: DataFrame, generated: DataFrame) -> DataFrame:
    """Deltas between two ``column_profile`` frames by table and column."""
    both = source.alias("a").join(generated.alias("b"), ["table", "column"])
    return both.select("table", "column", F.abs(F.col("a.null_share") - F.col("b.null_share")).alias("null_share_delta"))


def _total_variation(a: DataFrame, b: DataFrame, subject: list[str], value: list[str]) -> DataFrame:
    """Half the sum of differences of shares between two lists (subject..., value..., n); a subject on one side only is 1 apart."""
    share = lambda df, name: df.withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy(*subject))).select(*subject, *value, name)
    both = share(a, "_p").join(share(b, "_q"), [*subject, *value], "full_outer")
    sums = both.groupBy(*subject).agg(F.sum(F.abs(F.coalesce("_p", F.lit(0.0)) - F.coalesce("_q", F.lit(0.0)))).alias("_d"), F.count("_p").alias("_m"), F.count("_q").alias("_n"))
    return sums.select(*subject, F.when((F.col("_m") == 0) | (F.col("_n") == 0), 1.0).otherwise(F.col("_d") / 2).alias("distance"))


#: Shares of the points of a numeric distribution, with the columns that hold them.
_POINTS = [(0.0, "min"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.95, "p95"), (0.99, "p99"), (1.0, "max")]


def _share_below(x: Column, points: list[Column]) -> Column:
    """The share of values up to x by straight lines between a distribution's points; of equal points the last counts."""
    out = F.when(x >= points[-1], 1.0).when(x < points[0], 0.0)
    for k in reversed(range(len(points) - 1)):
        (p, _), (q, _) = _POINTS[k], _POINTS[k + 1]
        out = out.when(x >= points[k], F.lit(p) + (q - p) * (x - points[k]) / (points[k + 1] - points[k]))
    return out


def _kolmogorov(a: DataFrame, b: DataFrame) -> DataFrame:
    """The largest difference of shares below, at the points of either side, of two ``numeric_distribution`` frames."""
    own = [F.col(f"a.{c}") for _, c in _POINTS]
    other = [F.col(f"b.{c}") for _, c in _POINTS]
    both = a.alias("a").join(b.alias("b"), ["table", "column"])
    apart = [F.abs(_share_below(x, own) - _share_below(x, other)) for x in own + other]
    return both.select("table", "column", F.greatest(*apart).alias("distance"))


def reprofile_distances(source: dict[str, DataFrame], generated: dict[str, DataFrame]) -> DataFrame:
    """(axis, subject, distance) between two profiles (axis -> frame, see ``full_profile``), for every axis that both have.

    NULL shares by difference; lists of values, of referenced parents and of tuples by total variation, the referenced
    parents by rank, since keys are minted anew; numbers and children per parent by the largest difference of shares below.
    """
    dot = F.concat_ws(".", "table", "column")
    out: list[DataFrame] = []
    add = lambda axis, df, subject: out.append(df.select(F.lit(axis).alias("axis"), subject.alias("subject"), "distance"))
    both = [x for x in source if x in generated]
    if "column_profile" in both:
        add("null_share", reprofile_fidelity(source["column_profile"], generated["column_profile"]).withColumnRenamed("null_share_delta", "distance"), dot)
    if "categorical_distribution" in both:
        add("categorical_distribution", _total_variation(source["categorical_distribution"], generated["categorical_distribution"], ["table", "column"], ["value"]), dot)
    for axis in ("numeric_distribution", "fk_cardinality"):
        if axis in both:
            add(axis, _kolmogorov(source[axis], generated[axis]), dot)
    if "fk_selectivity" in both:
        add("fk_selectivity", _total_variation(source["fk_selectivity"], generated["fk_selectivity"], ["reference"], ["rank"]), F.col("reference"))
    if "joint_distribution" in both:
        add("joint_distribution", _total_variation(source["joint_distribution"], generated["joint_distribution"], ["table"], ["rank"]), F.col("table"))
    return union(out)


def synthetic_check(rows: DataFrame, again: DataFrame, references: dict[str, tuple[DataFrame, str]], values: dict[str, DataFrame]) -> DataFrame:
    """(check, subject, n, passed): orphans per reference column, values that no evidence has, and the digest of a second run with the same seed.

    ``references``: column -> parent and key; ``values``: column -> frame (value) of the vocabulary.  NULLs aren't looked at.
    """
    parts = []
    for c, (parent, key) in references.items():
        lost = rows.select(F.col(c).alias("_v")).dropna().join(parent.select(F.col(key).alias("_v")), "_v", "left_anti")
        parts.append(lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit("orphans").alias("check"), F.lit(c).alias("subject"), "n"))
    for c, known in values.items():
        odd = rows.select(F.col(c).alias("_v")).dropna().join(known.select(F.col("value").alias("_v")), "_v", "left_anti")
        parts.append(odd.agg(F.count(F.lit(1)).alias("n")).select(F.lit("foreign_values").alias("check"), F.lit(c).alias("subject"), "n"))
    one, two = table_digest(rows).select(F.col("digest").alias("a")), table_digest(again.select(*rows.columns)).select(F.col("digest").alias("b"))
    parts.append(one.join(two).select(F.lit("same_seed").alias("check"), F.lit("rows").alias("subject"), (F.col("a") != F.col("b")).cast("long").alias("n")))
    return union(parts).withColumn("passed", F.col("n") == 0)
