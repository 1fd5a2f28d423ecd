"""Key reconciliation, remapping and bridging between two environments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.cells import is_key, match_key, regex_extract
from granary.functions.scratch import save


def _all_keys(columns: list[str]) -> Column:
    out = is_key(columns[0])
    for c in columns[1:]:
        out = out & is_key(c)
    return out


def reconcile_by_columns(source: DataFrame, target: DataFrame, key: str, columns: list[str], target_key: str | None = None) -> DataFrame:
    """(source_key, target_key): the match by a tuple of columns, all of them non-blank; the least target key wins."""
    target_key = target_key or key
    parts = [match_key(c).alias(f"m{i}") for i, c in enumerate(columns)]
    names = [f"m{i}" for i in range(len(columns))]
    best = target.filter(_all_keys(columns)).groupBy(*parts).agg(F.min(target_key).alias("target_key"))
    rows = source.select(F.col(key).alias("source_key"), *[F.when(_all_keys(columns), match_key(c)).alias(f"m{i}") for i, c in enumerate(columns)])
    return rows.join(best, names, "left").select("source_key", "target_key")


def reconcile_by_column(source: DataFrame, target: DataFrame, key: str, column: str, target_key: str | None = None) -> DataFrame:
    return reconcile_by_columns(source, target, key, [column], target_key)


def reconcile_override(matches: DataFrame, overrides: DataFrame) -> DataFrame:
    """An explicit (source_key, target_key) map beats a match."""
    o = overrides.select(F.col("source_key"), F.col("target_key").alias("given"))
    return matches.join(o, "source_key", "left").select("source_key", F.coalesce("given", "target_key").alias("target_key"))


def reconcile_fallback(matches: DataFrame, pin, target: DataFrame, target_key: str) -> tuple[DataFrame, DataFrame]:
    """Unmatched sources take the pinned key; second: pins that the target lacks."""
    out = matches.withColumn("by", F.when(F.col("target_key").isNotNull(), "match").otherwise("fallback")).withColumn("target_key", F.coalesce("target_key", F.lit(pin)))
    pins = matches.sparkSession.createDataFrame([(pin,)], f"pin {dict(target.dtypes)[target_key]}")
    return out, pins.join(target.select(F.col(target_key).alias("pin")), "pin", "left_anti")


def reconcile_report(source: DataFrame, target: DataFrame, key: str, column: str) -> DataFrame:
    """(kind, key): sources without a match, sources that share a match key, target keys displaced by a lesser one."""
    s = source.filter(is_key(column)).select(F.col(key).alias("key"), match_key(column).alias("m"))
    t = target.filter(is_key(column)).select(F.col(key).alias("key"), match_key(column).alias("m"))
    unmatched = source.select(F.col(key).alias("key"), F.when(is_key(column), match_key(column)).alias("m")).join(t.select("m").distinct(), "m", "left_anti").select(F.lit("unmatched").alias("kind"), "key")
    beyond = lambda d, kind: d.join(d.groupBy("m").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "m").filter("key > least").select(F.lit(kind).alias("kind"), "key")
    return unmatched.unionByName(beyond(s, "ambiguous")).unionByName(beyond(t, "displaced"))


def unmatched_reason(rows: DataFrame, email: str, strategy: str = "email", has_fallback: bool = False) -> DataFrame:
    """Why a row has no target, for rows with ``target_key`` NULL."""
    reason = (
        F.when(F.lit(strategy == "email") & ~is_key(email), "no email").when(F.lit(strategy == "email"), "email did not match")
        .when(F.lit(strategy == "key"), "key did not match").when(F.lit(strategy == "override"), "override missing").otherwise("no fallback" if not has_fallback else "fallback failed")
    )
    return rows.filter("target_key IS NULL").withColumn("reason", reason)


def _cells(df: DataFrame, key: Column, columns: list[str], side: str) -> DataFrame:
    """(k, column, side): one row per cell."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias(side)) for c in columns]
    return df.select(key.alias("k"), F.explode(F.array(*cells)).alias("x")).select("k", "x.*")


def matched_divergence(source: DataFrame, target: DataFrame, key: str, columns: list[str], audit: list[str] = [], k: int = 3) -> DataFrame:  # noqa: B006
    """(column, n_differing, samples): per source column the matched pairs that differ, and the first k keys."""
    columns = [c for c in columns if c not in audit]
    pairs = source.alias("a").join(target.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"))
    names = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in columns]))
    rows = pairs.select(F.col(f"a.{key}").alias("k"), F.explode(names).alias("column"))
    counts = rows.groupBy("column").agg(F.count(F.lit(1)).alias("n_differing"))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy("k"))).filter(F.col("r") <= k)
    return counts.join(first.groupBy("column").agg(F.sort_array(F.collect_list("k")).alias("samples")), "column")


def lookup_identity(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(kind, key, column): business keys on one side only, and drifted cells of both."""
    both = a.alias("a").join(b.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    drift = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), c) for c in columns]))
    kind = F.when(F.col(f"b.{key}").isNull(), "missing").when(F.col(f"a.{key}").isNull(), "extra").otherwise("drift")
    found = both.select(kind.alias("kind"), F.coalesce(f"a.{key}", f"b.{key}").alias("key"), F.when(kind == "drift", drift).otherwise(F.array(F.lit(""))).alias("c"))
    return found.select("kind", "key", F.explode("c").alias("column"))


def orphan_ids(values: DataFrame, roster: DataFrame) -> DataFrame:
    """Distinct referenced ids (value) that the roster (id) lacks."""
    return values.select("value").dropna().distinct().join(roster.select(F.col("id").alias("value")), "value", "left_anti")


def match_users(source: DataFrame, target: DataFrame, key: str, attribute: str, mode: str = "email", pattern: str = "") -> DataFrame:
    """(source_key, target_key, reason): exactly one candidate, or none with a reason."""
    form = {"email": match_key, "attribute": F.col, "regex": lambda c: regex_extract(c, pattern)}[mode]
    by = target.filter(is_key(attribute)).groupBy(form(attribute).alias("m")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("one"))
    rows = source.select(F.col(key).alias("source_key"), F.when(is_key(attribute), form(attribute)).alias("m"))
    out = rows.join(by, "m", "left")
    reason = F.when(F.col("m").isNull(), "no value").when(F.col("n").isNull(), "no candidate").when(F.col("n") > 1, "several candidates")
    return out.select("source_key", F.when(F.col("n") == 1, F.col("one")).alias("target_key"), reason.alias("reason"))


def numbered(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """1-based numbers in a total order without a single task: range partitions, their counts, offsets.

    The ranges are written once: bounds come from a sample, so a second evaluation could draw others.
    """
    ranged = save(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "numbered")
    local = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = local.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.alias("x").join(sizes.alias("y"), F.col("y._p") < F.col("x._p"), "left").groupBy("x._p").agg(F.coalesce(F.sum("y._n"), F.lit(0)).alias("_o"))
    return local.join(F.broadcast(before), "_p").withColumn(name, F.col("_r") + F.col("_o")).drop("_p", "_r", "_o")


def match_fallback(unmatched: DataFrame, targets: list[int], mode: str = "round_robin") -> DataFrame:
    """``ignore``, ``single`` or ``round_robin`` over allowed targets, in key order."""
    if mode == "ignore" or not targets:
        return unmatched.select("source_key", F.lit(None).cast("long").alias("target_key"))
    if mode == "single":
        return unmatched.select("source_key", F.lit(targets[0]).cast("long").alias("target_key"))
    pick = F.element_at(F.array(*map(F.lit, targets)), ((F.col("row") - 1) % len(targets) + 1).cast("int"))
    return numbered(unmatched, ["source_key"]).select("source_key", pick.cast("long").alias("target_key"))


def merge_user_map(orphans: DataFrame, operator: DataFrame, automatic: DataFrame) -> DataFrame:
    """One entry per orphan (value): operator before automatic, filled before blank, blank for the rest."""
    every = operator.select("source_key", "target_key", F.lit(0).alias("p")).unionByName(automatic.select("source_key", "target_key", F.lit(1).alias("p")))
    rank = F.struct(F.col("target_key").isNull(), "p", "target_key")
    best = every.groupBy("source_key").agg(F.min(rank).alias("b")).select("source_key", F.col("b.target_key").alias("target_key"))
    return orphans.select(F.col("value").alias("source_key")).join(best, "source_key", "left")


def verify_user_map(user_map: DataFrame, inventory: DataFrame, roster: DataFrame, orphans: DataFrame) -> DataFrame:
    """(finding, key): repeated sources, unknown sources, unknown targets, orphans without a target."""
    say = lambda d, f, c: d.select(F.lit(f).alias("finding"), F.col(c).alias("key"))
    twice = user_map.groupBy("source_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    filled = user_map.filter("target_key IS NOT NULL")
    out = say(twice, "duplicate source", "source_key")
    out = out.unionByName(say(user_map.join(inventory.select(F.col("id").alias("source_key")), "source_key", "left_anti"), "unknown source", "source_key"))
    out = out.unionByName(say(filled.join(roster.select(F.col("id").alias("target_key")), "target_key", "left_anti"), "unknown target", "target_key"))
    return out.unionByName(say(orphans.select(F.col("value").alias("source_key")).join(filled, "source_key", "left_anti"), "unmapped orphan", "source_key"))


def remap_preview(counts: DataFrame, user_map: DataFrame) -> DataFrame:
    """(reference, value, target_key, n) for mapped values of ``reference_value_counts``."""
    m = user_map.filter("target_key IS NOT NULL").select(F.col("source_key").alias("value"), "target_key")
    return counts.join(m, "value").select("reference", "value", "target_key", "n")


def apply_user_remap(df: DataFrame, column: str, user_map: DataFrame) -> DataFrame:
    """Rewrite a reference where mapped and different; ``changed`` marks the rows for the log."""
    m = user_map.filter("target_key IS NOT NULL").select(F.col("source_key").alias("_s"), F.col("target_key").alias("_t"))
    out = df.join(m, F.col(column) == F.col("_s"), "left")
    return out.withColumn("changed", F.coalesce(F.col("_t") != F.col(column), F.lit(False))).withColumn(column, F.coalesce("_t", F.col(column))).drop("_s", "_t")


def assign_surrogates(new_rows: DataFrame, key: str, existing: DataFrame, disposition: str = "assigned", matches: DataFrame | None = None) -> DataFrame:
    """(source_key, assigned_key) by disposition: ``assigned`` after the largest key, ``preserved`` or ``reconciled``."""
    if disposition == "preserved":
        return new_rows.select(F.col(key).alias("source_key"), F.col(key).alias("assigned_key"))
    if disposition == "reconciled":
        return matches.filter("target_key IS NOT NULL").select("source_key", F.col("target_key").alias("assigned_key"))
    top = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    return numbered(new_rows.select(F.col(key).alias("source_key")), ["source_key"]).select("source_key", (top.scalar() + F.col("row")).alias("assigned_key"))


def remap_references(df: DataFrame, maps: dict[str, DataFrame]) -> DataFrame:
    """All references rewritten through (source_key, assigned_key) maps; NULL and empty stay.

    ``failed_column`` and ``failed_value`` name the first unresolved reference in name order, NULL for good rows.
    """
    out, why, what = df, F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in sorted(maps):
        m = maps[c].select(F.col("source_key").alias(f"_s_{c}"), F.col("assigned_key").alias(f"_t_{c}"))
        out = out.join(m, F.col(c) == F.col(f"_s_{c}"), "left")
    for c in sorted(maps):
        bad = F.col(c).isNotNull() & (F.col(c).cast("string") != "") & F.col(f"_t_{c}").isNull()
        why, what = F.coalesce(why, F.when(bad, c)), F.coalesce(what, F.when(bad, F.col(c).cast("string")))
    out = out.withColumn("failed_column", why).withColumn("failed_value", what)
    for c in sorted(maps):
        out = out.withColumn(c, F.coalesce(f"_t_{c}", F.col(c))).drop(f"_s_{c}", f"_t_{c}")
    return out


def dropped_rows(remapped: DataFrame, key: str) -> DataFrame:
    return remapped.filter("failed_column IS NOT NULL").select(F.col(key).alias("key"), "failed_column", "failed_value")


def keymap_repoint(df: DataFrame, column: str, table: str, keymap: DataFrame) -> DataFrame:
    """Re-point a reference through a stored map (table, source_key, assigned_key)."""
    m = keymap.filter(F.col("table") == table).select(F.col("source_key").alias("_s"), F.col("assigned_key").alias("_t"))
    return df.join(m, F.col(column) == F.col("_s"), "left").withColumn(column, F.coalesce("_t", F.col(column))).drop("_s", "_t")


def reconcile_evidence(source: DataFrame, target: DataFrame, column: str, sample: int = 1000, key: str | None = None) -> DataFrame:
    """Is the column unique in the target, and how many of ``sample`` source values (least hash) does it hold."""
    unique = target.agg((F.count(column) == F.count_distinct(column)).alias("target_unique"))
    values = source.select(F.col(column).alias("v")).dropna().distinct().orderBy(F.md5(F.col("v").cast("string")), "v").limit(sample)
    held = values.join(target.select(F.col(column).alias("v"), F.lit(1).alias("f")).distinct(), "v", "left").agg(F.count(F.lit(1)).alias("n_sampled"), F.count("f").alias("n_found"))
    return unique.join(held)


def forecast_answers(df: DataFrame, maps: dict[str, DataFrame]) -> DataFrame:
    """Rows rekeyed, and rows dropped, if these maps were the answer."""
    out = remap_references(df, maps)
    return out.agg(F.count_if(F.col("failed_column").isNull()).alias("n_rekeyed"), F.count_if(F.col("failed_column").isNotNull()).alias("n_dropped"))


def forecast_candidates(df: DataFrame, references: dict[str, str], answers: dict[str, dict[str, DataFrame | None]], chosen: dict[str, str], entering: dict[str, dict[str, DataFrame]] | None = None) -> DataFrame:
    """(target, answer, chosen, n_rekeyed, n_dropped, n_entering) for every candidate answer of every target, from one scan.

    ``references`` names the target of each reference column; an answer is the frame of keys (source_key) that it resolves, or
    None for one that resolves nothing.  Per target, keys carry a bitmap of the answers that resolve them, so a row meets
    each target once per column however many answers there are.  An answer is looked at with the other targets at
    their chosen ones: a reference is rekeyed if it resolves and every other filled reference of its row does too; it is
    dropped if it doesn't resolve; one that resolves in a row that a sibling drops is neither.  ``entering`` are the rows
    that an answer brings into scope.
    """
    rows, exprs, names = df, [], []
    bit: dict[tuple[str, str], int] = {}
    for target, own in answers.items():
        parts = None
        for k, (answer, keys) in enumerate(own.items()):
            bit[target, answer] = k
            if keys is not None:
                part = keys.select(F.col("source_key"), F.lit(1 << k).cast("long").alias("b"))
                parts = part if parts is None else parts.unionByName(part)
        for c in (c for c, t in references.items() if t == target):
            if parts is None:
                rows = rows.withColumn(f"_bits_{c}", F.lit(0).cast("long"))
                continue
            found = parts.groupBy(F.col("source_key").alias(f"_key_{c}")).agg(F.bit_or("b").alias(f"_bits_{c}"))
            rows = rows.join(found, F.col(c) == F.col(f"_key_{c}"), "left").withColumn(f"_bits_{c}", F.coalesce(f"_bits_{c}", F.lit(0)))
    filled = {c: F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in references}
    resolves = lambda c, answer: F.col(f"_bits_{c}").bitwiseAND(F.lit(1 << bit[references[c], answer])) != 0
    for target, own in answers.items():
        for answer in own:
            survives = F.lit(True)
            for c, t in references.items():
                survives = survives & (~filled[c] | resolves(c, answer if t == target else chosen[t]))
            mine = [c for c, t in references.items() if t == target]
            rekeyed = sum((F.count_if(filled[c] & resolves(c, answer) & survives) for c in mine), F.lit(0))
            dropped = sum((F.count_if(filled[c] & ~resolves(c, answer)) for c in mine), F.lit(0))
            exprs += [rekeyed.cast("long").alias(f"r{len(names)}"), dropped.cast("long").alias(f"d{len(names)}")]
            names.append((target, answer))
    row = rows.agg(*exprs)
    out = row.select(F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(a).alias("answer"), F.lit(chosen[t] == a).alias("chosen"), F.col(f"r{k}").alias("n_rekeyed"), F.col(f"d{k}").alias("n_dropped")) for k, (t, a) in enumerate(names)])).alias("x")).select("x.*")
    sizes = None
    for t, own in (entering or {}).items():
        for a, frame in own.items():
            part = frame.agg(F.count(F.lit(1)).alias("n_entering")).select(F.lit(t).alias("target"), F.lit(a).alias("answer"), "n_entering")
            sizes = part if sizes is None else sizes.unionByName(part)
    if sizes is None:
        return out.withColumn("n_entering", F.lit(0).cast("long"))
    return out.join(sizes, ["target", "answer"], "left").withColumn("n_entering", F.coalesce("n_entering", F.lit(0)))


def escaping_references(contract, tables: dict[str, DataFrame], subset: set[str]) -> DataFrame:
    """(reference, direction, n_rows): references that leave a table subset, and dependents that point into it."""
    out = None
    for r in contract.references:
        inside, target = r.child in subset, r.parent in subset
        if inside != target and r.child in tables:
            part = tables[r.child].dropna(subset=list(r.columns)).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(r.name).alias("reference"), F.lit("escapes" if inside else "points_in").alias("direction"), "n_rows")
            out = part if out is None else out.unionByName(part)
    return out


def bridge_verdict(referenced: DataFrame, source: DataFrame, bridge: DataFrame) -> DataFrame:
    """One verdict per referenced ``key`` from rows (key, identity) of source and bridge."""
    side = lambda d, p: d.groupBy("key").agg(F.count(F.lit(1)).alias(f"{p}_n"), F.min("identity").alias(f"{p}_id"))
    both = referenced.select("key").distinct().join(side(source, "s"), "key", "left").join(side(bridge, "b"), "key", "left")
    verdict = (
        F.when(F.col("key").isNull(), "null_key").when(F.col("s_n").isNull() & F.col("b_n").isNull(), "unknown").when(F.col("s_n") > 1, "ambiguous_source").when(F.col("b_n") > 1, "ambiguous_bridge")
        .when(F.col("b_n").isNull(), "insert").when(F.col("s_n").isNull(), "bridge_only").when(F.col("s_id").eqNullSafe(F.col("b_id")), "present").otherwise("update_identity")
    )
    return both.withColumn("verdict", verdict)


def bridge_stage(verdicts: DataFrame) -> DataFrame:
    """Inserts and identity updates with the identity to write."""
    return verdicts.filter("verdict IN ('insert', 'update_identity')").select("key", F.col("s_id").alias("identity"), "verdict")


BLOCKING = ("null_key", "unknown", "ambiguous_source", "ambiguous_bridge")


def bridge_evidence(verdicts: DataFrame) -> DataFrame:
    """Counts by outcome; ``withheld`` when any verdict blocks."""
    return verdicts.agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("verdict") == "insert").alias("n_inserts"), F.count_if(F.col("verdict") == "update_identity").alias("n_updates"), F.coalesce(F.bool_or(F.col("verdict").isin(*BLOCKING)), F.lit(False)).alias("withheld"))


#: The checks of a retarget through a bridge: severity, and the condition on the measures that passes.
BRIDGE_CHECKS = {
    "bridge_key_exists": ("block", "bridge_key_present"),
    "bridge_key_unique": ("block", "n_duplicate_bridge_keys = 0"),
    "bridge_key_declared_unique": ("block", "bridge_key_declared_unique"),
    "bridge_key_non_null": ("block", "n_null_bridge_keys = 0"),
    "key_types_match": ("block", "key_types_match"),
    "not_the_bridge_primary_key": ("block", "NOT targets_bridge_primary_key"),
    "all_values_resolve": ("block", "n_unresolved = 0"),
    "original_parent_still_resolves": ("block", "n_broken_original_parent = 0"),
    "no_other_retarget": ("block", "NOT other_retarget"),
    "trusted_constraint_possible": ("block", "trusted_constraint_possible"),
    "no_orphaned_bridge_rows": ("warn", "n_orphaned_bridge_rows = 0"),
    "no_payload_conflicts": ("warn", "n_payload_conflicts = 0"),
    "identity_evidence_present": ("warn", "identity_evidence <> 'missing'"),
    "identity_evidence_unambiguous": ("warn", "identity_evidence <> 'ambiguous'"),
    "only_audit_references": ("warn", "only_audit_references"),
    "existing_constraint_trusted": ("warn", "coalesce(existing_constraint_trusted, true)"),
}


def bridge_measures(source: DataFrame, bridge: DataFrame, referenced: DataFrame) -> DataFrame:
    """One row of what the data say, from rows (key, identity) of source and bridge and the referenced ``key`` values."""
    of_bridge = bridge.filter("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("b_n"), F.min("identity").alias("b_id"))
    of_source = source.filter("key IS NOT NULL").groupBy(F.col("key").alias("s_key")).agg(F.count(F.lit(1)).alias("s_n"), F.min("identity").alias("s_id"))
    both = of_bridge.join(of_source, F.col("key") == F.col("s_key"), "full_outer").agg(
        F.count_if(F.col("b_n") > 1).alias("n_duplicate_bridge_keys"), F.count_if(F.col("b_n").isNotNull() & F.col("s_n").isNull()).alias("n_orphaned_bridge_rows"),
        F.count_if(F.col("b_n").isNotNull() & F.col("s_n").isNotNull() & ~F.col("b_id").eqNullSafe(F.col("s_id"))).alias("n_payload_conflicts"),
    )
    asked = referenced.select(F.col("key").alias("r_key")).dropna().distinct()
    found = asked.join(of_bridge, F.col("r_key") == F.col("key"), "left").select("r_key", "b_n").join(of_source, F.col("r_key") == F.col("s_key"), "left")
    counts = found.agg(F.count_if(~F.col("b_n").eqNullSafe(F.lit(1))).alias("n_unresolved"), F.count_if(F.col("s_n").isNull()).alias("n_broken_original_parent"))
    nulls = bridge.agg(F.count_if(F.col("key").isNull()).alias("n_null_bridge_keys"), (F.count(F.lit(1)) > 0).alias("bridge_key_present"))
    same = dict(source.dtypes)["key"] == dict(bridge.dtypes)["key"]
    return both.join(counts).join(nulls).withColumn("key_types_match", F.lit(same))


def bridge_readiness(measures: DataFrame, checks: dict[str, tuple[str, str]] = BRIDGE_CHECKS) -> DataFrame:
    """Of one row of measures: the checks that failed by severity, and Ready, ReadyWithWarnings or Blocked.

    A measure that is NULL or missing fails the checks that need it, but for existing_constraint_trusted.
    """
    have = set(measures.columns)
    names = {"bridge_key_declared_unique", "targets_bridge_primary_key", "other_retarget", "trusted_constraint_possible", "identity_evidence", "only_audit_references", "existing_constraint_trusted"}
    out = measures.withColumns({c: F.lit(None).cast("string" if c == "identity_evidence" else "boolean") for c in sorted(names - have)})
    failed = lambda kind: F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(test), F.lit(False)), name) for name, (severity, test) in checks.items() if severity == kind]))
    out = out.withColumn("blocked_by", failed("block")).withColumn("warned_by", failed("warn"))
    status = F.when(F.size("blocked_by") > 0, "Blocked").when(F.size("warned_by") > 0, "ReadyWithWarnings").otherwise("Ready")
    return out.withColumn("status", status).select(*measures.columns, "blocked_by", "warned_by", "status")
