"""Evidence-gated decisions: decision tables over evidence frames, one output row per column, index or reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.contract import Contract


def _first(rules: list, other: str):
    out = None
    for condition, verdict in rules:
        out = F.when(condition, verdict) if out is None else out.when(condition, verdict)
    return out.otherwise(other)


def decide_not_null(evidence: DataFrame, budget: float = 0.0, relax: bool = False) -> DataFrame:
    """Of (table, column, n_rows, n_nulls, is_key, physically_not_null, mandatory, override): decision and reason.

    Order: an override, the key, already NOT NULL, then for mandatory columns the evidence: none, no NULLs, within
    ``budget`` of the rows, relaxed, or approval needed.  Anything else stays nullable.
    """
    reason = _first(
        [
            (F.col("override") == "enforce", "override"), (F.col("override") == "keep", "override_nullable"), (F.col("is_key"), "primary_key"), (F.col("physically_not_null"), "already_not_null"),
            (F.col("mandatory") & F.col("n_rows").isNull(), "mandatory_without_profile"), (F.col("mandatory") & (F.col("n_nulls") == 0), "mandatory_no_nulls"),
            (F.col("mandatory") & (F.col("n_nulls") <= F.col("n_rows") * budget), "mandatory_within_budget"), (F.col("mandatory") & F.lit(relax), "relaxed"), (F.col("mandatory"), "needs_approval"),
        ],
        "nullable",
    )
    enforce = F.col("reason").isin("override", "primary_key", "already_not_null", "mandatory_without_profile", "mandatory_no_nulls", "mandatory_within_budget")
    return evidence.withColumn("reason", reason).withColumn("enforce", enforce)


def decide_unique(evidence: DataFrame, policy: bool = True, advise: bool = False) -> DataFrame:
    """Of (table, columns, already_unique, has_duplicates, outcome): enforce only with reliable evidence."""
    reason = _first([(F.col("already_unique"), "already_unique"), (F.lit(not policy), "policy_off"), (F.col("has_duplicates"), "duplicates"), (~F.col("outcome").isin("Succeeded", "TrustedConstraint"), "no_evidence"), (F.lit(advise), "advise")], "clean")
    return evidence.withColumn("reason", reason).withColumn("enforce", F.col("reason").isin("already_unique", "clean"))


def decide_fk(evidence: DataFrame, policy: bool = True, allow_orphans: bool = False, cross_schema: bool = False) -> DataFrame:
    """Of (reference, tracked, target_exists, has_constraint, n_orphans, outcome, crosses_schema)."""
    reason = _first(
        [
            (~F.col("tracked"), "untracked"), (~F.col("target_exists"), "missing_target"), (F.col("has_constraint"), "constraint_present"), (F.lit(not policy), "policy_off"),
            (F.col("n_orphans").isNull() | ~F.col("outcome").isin("Succeeded", "TrustedConstraint"), "no_evidence"),
            (F.col("n_orphans") > 0, "orphans_nocheck" if allow_orphans else "orphans"), (F.col("crosses_schema") & F.lit(not cross_schema), "cross_schema"),
        ],
        "clean",
    )
    return evidence.withColumn("reason", reason).withColumn("enforce", F.col("reason").isin("constraint_present", "clean", "orphans_nocheck"))


def suggest_natural_key(evidence: DataFrame, floor: int = 10) -> DataFrame:
    """Columns (table, column, n_rows, n_nulls, n_distinct, truncated) whose values are all distinct, over a floor."""
    ok = (F.col("n_distinct") == F.col("n_rows") - F.col("n_nulls")) & (F.col("n_nulls") == 0) & ~F.col("truncated") & (F.col("n_distinct") >= floor)
    return evidence.filter(ok)


def profile_anomalies(profile: DataFrame, measure: str = "null_share") -> DataFrame:
    """Columns whose measure exceeds the table's mean by two deviations; tables with one column have none."""
    w = Window.partitionBy("table")
    out = profile.withColumn("limit", F.avg(measure).over(w) + 2 * F.stddev_pop(measure).over(w)).withColumn("n", F.count(measure).over(w))
    return out.filter((F.col("n") >= 2) & (F.col(measure) > F.col("limit"))).drop("n")


def high_selectivity_fk(evidence: DataFrame) -> DataFrame:
    """References (reference, n_rows, n_distinct) with ten values or more and under two rows for each."""
    return evidence.filter((F.col("n_distinct") >= 10) & (F.col("n_rows") < 2 * F.col("n_distinct")))


def near_unique_composite(evidence: DataFrame, share: float = 0.95) -> DataFrame:
    return evidence.filter((F.col("n_distinct") >= 5) & (F.col("n_distinct") >= F.col("n_rows") * share))


def tightening_preflight(nulls: DataFrame, decisions: DataFrame) -> DataFrame:
    """NULLs in columns that a decision is about to make NOT NULL."""
    to_be = decisions.filter(F.col("enforce") & ~F.col("physically_not_null")).select("table", "column")
    return nulls.join(to_be, ["table", "column"]).filter("n_nulls > 0").select("table", "column", "n_nulls")


def length_overflow(profile: DataFrame, declared: DataFrame) -> DataFrame:
    """Columns whose longest text exceeds the declared length."""
    return profile.join(declared, ["table", "column"]).filter("max_length > declared_length").select("table", "column", "max_length", "declared_length")


def data_violations(not_null: DataFrame, unique: DataFrame, fk: DataFrame, lengths: DataFrame, repair_up_to: int = 100_000) -> DataFrame:
    """(category, subject, n_rows, action): the four kinds of broken declarations."""
    subject = lambda d, *c: F.concat_ws(".", *c)
    parts = [
        not_null.filter("n_nulls > 0").select(F.lit("NOT NULL").alias("category"), subject(not_null, "table", "column").alias("subject"), F.col("n_nulls").alias("n_rows")),
        unique.filter("n_duplicate_keys > 0").select(F.lit("UNIQUE").alias("category"), subject(unique, "table", "columns").alias("subject"), F.col("n_duplicate_keys").alias("n_rows")),
        fk.filter("n_orphans > 0").select(F.lit("FOREIGN KEY").alias("category"), F.col("reference").alias("subject"), F.col("n_orphans").alias("n_rows")),
        lengths.select(F.lit("LENGTH").alias("category"), subject(lengths, "table", "column").alias("subject"), F.lit(None).cast("long").alias("n_rows")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("action", F.when(F.coalesce("n_rows", F.lit(0)) <= repair_up_to, "repair").otherwise("relax"))


def violation_rollup(violations: DataFrame) -> DataFrame:
    return violations.groupBy("category").agg(F.count(F.lit(1)).alias("n_subjects"), F.sum("n_rows").alias("n_rows"))


def compare_evidence(evidence: DataFrame, contract: Contract, n_orphans: DataFrame | None = None) -> DataFrame:
    """Violations that the evidence of one environment has under the contract of another one.

    ``evidence`` is (table, column, n_nulls, n_duplicate_keys) of single columns, ``n_orphans`` is (reference, n_orphans).
    """
    spark = evidence.sparkSession
    rules = [(t.name, c, "not_null") for t in contract.tables.values() for c in (*t.key, *t.not_null)]
    rules += [(t.name, u[0], "unique") for t in contract.tables.values() for u in (t.key, *t.unique) if len(u) == 1]
    asked = spark.createDataFrame(sorted(set(rules)), "table string, column string, category string")
    n_rows = F.when(F.col("category") == "not_null", F.col("n_nulls")).otherwise(F.col("n_duplicate_keys"))
    out = evidence.join(F.broadcast(asked), ["table", "column"]).select("category", F.concat_ws(".", "table", "column").alias("subject"), n_rows.alias("n_rows"))
    if n_orphans is not None:
        names = [r.name for r in contract.references]
        out = out.unionByName(n_orphans.filter(F.col("reference").isin(names)).select(F.lit("foreign_key").alias("category"), F.col("reference").alias("subject"), F.col("n_orphans").alias("n_rows")))
    return out.filter("n_rows > 0")


def null_variance(profiles: DataFrame, rows: int = 1000, share: float = 0.1) -> DataFrame:
    """Columns of (env, table, column, n_nulls) whose NULL counts differ across environments."""
    by = profiles.groupBy("table", "column").agg(F.min("n_nulls").alias("least"), F.max("n_nulls").alias("most"))
    gap = F.col("most") - F.col("least")
    return by.filter((gap > rows) | (gap > F.col("most") * share))


def validate_profiles(profiles: DataFrame) -> DataFrame:
    """Findings (env, table, column, finding) over (env, table, column, n_rows, n_nulls, not_null, has_duplicates, unique, n_orphans, outcome).

    Further columns are read where they are there: ``unique_outcome`` and ``fk_outcome`` of their own probes,
    ``composite`` (the row is about several columns, named together), ``no_check`` (a reference that isn't enforced).
    """
    more = {"unique_outcome": "string", "fk_outcome": "string", "composite": "boolean", "no_check": "boolean"}
    profiles = profiles.withColumns({c: F.lit(None).cast(k) for c, k in more.items() if c not in profiles.columns})
    failed = lambda c: F.col(c).isNotNull() & ~F.col(c).isin("Succeeded", "TrustedConstraint")
    repeated, whole = F.col("unique") & F.col("has_duplicates"), F.coalesce("composite", F.lit(False))
    findings = F.array_compact(
        F.array(
            F.when(F.col("n_nulls") > F.col("n_rows"), "null_count_over_rows"), F.when(~F.col("outcome").isin("Succeeded", "TrustedConstraint"), "probe_failed"),
            F.when(F.col("not_null") & (F.col("n_nulls") > 0), "nulls_in_not_null"), F.when(repeated & ~whole, "duplicates"), F.when(F.col("n_orphans") > 0, "orphans"),
            F.when(repeated & whole, "composite_duplicates"), F.when(failed("unique_outcome"), "unique_probe_failed"), F.when(failed("fk_outcome"), "fk_probe_failed"), F.when(F.col("no_check"), "no_check"),
        )
    )
    own = profiles.select("env", "table", "column", F.explode(findings).alias("finding"))
    envs = profiles.agg(F.count_distinct("env").alias("n_envs"))
    by_table = profiles.groupBy(F.lower("table").alias("folded")).agg(F.count_distinct("env").alias("n"), F.count_distinct("table").alias("forms"))
    across = by_table.withColumn("n_envs", envs.scalar()).select(F.lit("*").alias("env"), F.col("folded").alias("table"), F.lit("*").alias("column"), F.explode(F.array_compact(F.array(F.when(F.col("n") < F.col("n_envs"), "table_missing"), F.when(F.col("forms") > 1, "name_case")))).alias("finding"))
    disagree = profiles.groupBy("table", "column").agg(F.count_distinct("unique").alias("k"), F.count_distinct(F.when(F.col("unique"), F.col("has_duplicates"))).alias("mixed")).filter("k > 1 OR mixed > 1").select(F.lit("*").alias("env"), "table", "column", F.lit("unique_disagreement").alias("finding"))
    varied = null_variance(profiles).select(F.lit("*").alias("env"), "table", "column", F.lit("null_variance").alias("finding"))
    return own.unionByName(across).unionByName(disagree).unionByName(varied)


def constraint_consensus(evidence: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Of (env, constraint, safe): the share of environments where it is safe; safe overall if present in all and at the threshold."""
    envs = evidence.agg(F.count_distinct("env").alias("n_envs"))
    by = evidence.groupBy("constraint").agg(F.count_distinct("env").alias("n_present"), F.count_if("safe").alias("n_safe"), F.sort_array(F.collect_set(F.when(~F.col("safe"), F.col("env")))).alias("unsafe_in"))
    out = by.withColumn("n_envs", envs.scalar()).withColumn("ratio", F.col("n_safe") / F.col("n_envs"))
    return out.withColumn("safe", (F.col("n_present") == F.col("n_envs")) & (F.col("ratio") >= threshold))


def environment_findings(profiles: DataFrame, primary: str) -> DataFrame:
    """Each environment against the primary: more NULLs, new duplicates, more orphans, unknown probes."""
    base = profiles.filter(F.col("env") == primary).select("table", "column", F.col("n_nulls").alias("p_nulls"), F.col("has_duplicates").alias("p_dup"), F.col("n_orphans").alias("p_orphans"))
    both = profiles.filter(F.col("env") != primary).join(base, ["table", "column"])
    found = F.array_compact(F.array(F.when(F.col("n_nulls") > F.col("p_nulls"), "more_nulls"), F.when(F.col("has_duplicates") & ~F.col("p_dup"), "new_duplicates"), F.when(F.col("n_orphans") > F.col("p_orphans"), "more_orphans"), F.when(~F.col("outcome").isin("Succeeded", "TrustedConstraint"), "unknown_probe")))
    return both.select("env", "table", "column", F.explode(found).alias("finding"))


def profiling_insights(profile: DataFrame) -> DataFrame:
    """Recommendations from (table, column, n_rows, n_nulls, not_null, outcome)."""
    text = _first(
        [
            (~F.col("outcome").isin("Succeeded", "TrustedConstraint"), "evidence is incomplete"), (~F.col("not_null") & (F.col("n_nulls") == 0) & (F.col("n_rows") > 0), "nullable with zero NULLs"),
            (F.col("not_null") & (F.col("n_nulls") > 0), "NULLs in a NOT NULL column"), ((F.col("n_nulls") == F.col("n_rows")) & (F.col("n_rows") > 0), "all values are NULL"),
        ],
        "",
    )
    return profile.withColumn("insight", text).filter("insight <> ''").select("table", "column", "insight")


def change_risk(decisions: DataFrame) -> DataFrame:
    """High where data would break, Moderate where it was repaired or relaxed, Low where nothing changes."""
    risk = _first([(F.col("enforce") & (F.coalesce("n_violations", F.lit(0)) > 0), "High"), (~F.col("enforce") & (F.coalesce("n_violations", F.lit(0)) > 0), "Moderate")], "Low")
    return decisions.withColumn("risk", risk)


def opportunities(decisions: DataFrame) -> DataFrame:
    """Decisions (kind, subject, enforce, n_violations) sorted into categories, counted by kind and risk."""
    kind = _first([(F.col("enforce") & (F.coalesce("n_violations", F.lit(0)) == 0), "validated"), (F.col("enforce"), "contradiction")], "recommendation")
    return change_risk(decisions).withColumn("category", kind).groupBy("kind", "category", "risk").agg(F.count(F.lit(1)).alias("n"))


def decision_summary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("enforce", "reason").agg(F.count(F.lit(1)).alias("n"))


def remediation_rows(df: DataFrame, kind: str, key: str, column: str, parent: DataFrame | None = None, parent_key: str | None = None) -> DataFrame:
    """Keys of the rows behind a finding: ``nulls``, ``duplicates`` beyond the least key, ``orphans``, ``collisions``."""
    if kind == "nulls":
        return df.filter(F.col(column).isNull()).select(F.col(key).alias("key"))
    if kind == "orphans":
        return df.filter(F.col(column).isNotNull()).join(parent.select(F.col(parent_key).alias("pk")), F.col(column) == F.col("pk"), "left_anti").select(F.col(key).alias("key"))
    folded = F.lower(column) if kind == "collisions" else F.col(column)
    rows = df.filter(F.col(column).isNotNull()).withColumn("folded", folded)
    by = rows.groupBy("folded").agg(F.min(key).alias("least"), F.count_distinct(column).alias("forms"), F.count(F.lit(1)).alias("n"))
    wanted = by.filter("forms > 1" if kind == "collisions" else "n > 1")  # aggregated before the join, so a hot value is one row
    out = rows.join(wanted, "folded")
    return (out if kind == "collisions" else out.filter(F.col(key) > F.col("least"))).select(F.col(key).alias("key"))


def burndown(before: DataFrame, after: DataFrame, key: str = "finding") -> DataFrame:
    """Findings resolved, persisting and new between two runs."""
    a, b = before.select(F.col(key).alias("a")).distinct(), after.select(F.col(key).alias("b")).distinct()
    both = a.join(b, F.col("a") == F.col("b"), "full_outer")
    return both.select(F.coalesce("a", "b").alias(key), _first([(F.col("b").isNull(), "resolved"), (F.col("a").isNull(), "new")], "persisting").alias("state"))
