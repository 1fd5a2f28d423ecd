"""Profiling: evidence about tables as long-format frames. Every axis is one aggregate over a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.contract import Contract, Reference
from granary.functions.scratch import save, union
from granary.operators import counts as vc
from granary.operators.diff import row_digest

PERCENTILES = (0.25, 0.5, 0.75, 0.95, 0.99)
LEAST_SAMPLE = 5


def _long(row: DataFrame, columns: list[str], fields: dict) -> DataFrame:
    """One aggregated row to a row per column; ``fields`` maps a name to (prefix)."""
    parts = [F.struct(F.lit(c).alias("column"), *[F.col(f"{p}_{i}").alias(n) for n, p in fields.items()]) for i, c in enumerate(columns)]
    extra = [c for c in row.columns if c in ("n_rows",)]
    return row.select(*extra, F.explode(F.array(*parts)).alias("x")).select("x.*", *extra)


def null_counts(df: DataFrame, table: str, columns: list[str] | None = None) -> DataFrame:
    """(table, column, n_rows, n_nulls): one scan for all columns, or for those given."""
    columns = columns or df.columns
    row = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"a_{i}") for i, c in enumerate(columns)])
    return _long(row, columns, {"n_nulls": "a"}).select(F.lit(table).alias("table"), "column", "n_rows", "n_nulls")


def column_profile(df: DataFrame, table: str, columns: list[str] | None = None) -> DataFrame:
    """Rows, NULLs, longest text, share of NULLs, all_null, zero_null by column."""
    columns = columns or df.columns
    text = {c for c, k in df.dtypes if k == "string"}
    longest = lambda c: F.max(F.length(c)) if c in text else F.lit(None)
    row = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"a_{i}") for i, c in enumerate(columns)],
        *[longest(c).cast("long").alias(f"b_{i}") for i, c in enumerate(columns)],
    )
    out = _long(row, columns, {"n_nulls": "a", "max_length": "b"})
    share = F.when(F.col("n_rows") > 0, F.col("n_nulls") / F.col("n_rows")).otherwise(F.lit(0.0))
    all_null = (F.col("n_rows") > 0) & (F.col("n_nulls") == F.col("n_rows"))
    return out.select(F.lit(table).alias("table"), "column", "n_rows", "n_nulls", "max_length", share.alias("null_share"), all_null.alias("all_null"), (F.col("n_nulls") == 0).alias("zero_null"))


def attribute_reality(df: DataFrame, table: str, nullable: set[str], inactive: set[str] = frozenset()) -> DataFrame:
    """has_nulls, has_duplicates (NULLs apart), declared_nullable, present_but_inactive by column, from one count of all values."""
    counts, subjects = vc.count_values({table: (df, [(c,) for c in df.columns])})
    names = F.element_at(F.array(*[F.lit(c) for _, (c,) in subjects]), F.col("id").cast("int") + 1)
    every = df.sparkSession.range(len(subjects)).join(vc.summary(counts), F.col("id") == F.col("subject"), "left").withColumn("column", names)
    known = F.when(F.col("n_rows") > 0, F.col("n_nulls") > 0).alias("has_nulls")
    return every.select(F.lit(table).alias("table"), "column", known, F.coalesce(F.col("n_repeated") > 0, F.lit(False)).alias("has_duplicates"), F.col("column").isin(*nullable).alias("declared_nullable"), F.col("column").isin(*inactive).alias("present_but_inactive"))


def percentile_cont(df: DataFrame, column: str, share: float) -> DataFrame:
    """(value): linear interpolation at (n - 1) * share of the non-NULL values; no row without any."""
    counts = save(df.select(F.lit(0).alias("subject"), F.col(column).cast("double").alias("value")).dropna().groupBy("subject", "value").agg(F.count(F.lit(1)).alias("n")), "numbers")
    return vc.distributions(counts, "subject", (share,)).select(F.col("p")[0].alias("value"))


def _distributions(counts: DataFrame, named: Column, outcome: str = "Succeeded") -> DataFrame:
    """Distribution rows of counts (subject, value, n); ``named`` is a struct of table and column made of the subject."""
    ps = [F.col("p")[i].alias(f"p{int(p * 100)}") for i, p in enumerate(PERCENTILES)]
    out = vc.distributions(counts, "subject", PERCENTILES).filter(F.col("sample_size") >= LEAST_SAMPLE)
    return out.withColumn("_named", named).select("_named.table", "_named.column", "sample_size", "min", *ps, "max", "mean", "stddev", F.lit(outcome).alias("outcome"))


def _named(pairs: list[tuple[str, str]]) -> Column:
    """(table, column) by subject number."""
    return F.element_at(F.array(*[F.struct(F.lit(t).alias("table"), F.lit(c).alias("column")) for t, c in pairs]), F.col("subject").cast("int") + 1)


def numeric_distribution(df: DataFrame, table: str, columns: list[str], exact: bool = True) -> DataFrame:
    """min, percentiles, max, mean, population deviation of non-NULL values; columns with under five are left out.

    Exact: all columns' values are counted in one shuffle, and percentiles are found by rank, see ``counts.quantiles``.
    """
    if exact:
        rows = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("subject"), F.col(c).cast("double").alias("value")) for k, c in enumerate(columns)])).alias("x")).select("x.*")
        counts = rows.filter("value IS NOT NULL").groupBy("subject", "value").agg(F.count(F.lit(1)).alias("n"))
        return _distributions(save(counts, "numbers"), _named([(table, c) for c in columns]))
    quantile = lambda c: F.percentile_approx(c, list(PERCENTILES), 100_000).cast("array<double>")
    row = df.agg(*[F.struct(F.count(c).alias("sample_size"), F.min(c).cast("double").alias("min"), quantile(c).alias("p"), F.max(c).cast("double").alias("max"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("stddev")).alias(f"a_{i}") for i, c in enumerate(columns)])
    out = _long(row, columns, {"v": "a"}).filter(F.col("v.sample_size") >= LEAST_SAMPLE)
    ps = [F.col("v.p")[i].alias(f"p{int(p * 100)}") for i, p in enumerate(PERCENTILES)]
    return out.select(F.lit(table).alias("table"), "column", "v.sample_size", "v.min", *ps, "v.max", "v.mean", "v.stddev", F.lit("Approximate").alias("outcome"))


def distribution_shape(dist: DataFrame) -> DataFrame:
    """Interquartile range, range, coefficient of variation, degenerate flag."""
    cv = F.when(F.col("mean") != 0, F.col("stddev") / F.abs("mean"))
    return dist.select("table", "column", (F.col("p75") - F.col("p25")).alias("iqr"), (F.col("max") - F.col("min")).alias("range"), cv.alias("cv"), (F.col("max") == F.col("min")).alias("degenerate"))


def _top(counts: DataFrame, value: list[str], top: int) -> DataFrame:
    """The ``top`` most frequent of (value..., n), ties by value, with the true number and a truncated flag."""
    ranked = counts.orderBy(F.col("n").desc(), *value).limit(top)
    rank = F.row_number().over(Window.orderBy(F.col("n").desc(), *value))  # over at most ``top`` rows
    total = counts.agg(F.count_if(F.col("n") > 0).alias("n_distinct"))  # all values; naming n, it shares the shuffle of the counts
    return ranked.withColumn("rank", rank.cast("long")).withColumn("n_distinct", total.scalar()).withColumn("truncated", F.col("n_distinct") > top)


def categorical_distribution(df: DataFrame, table: str, column: str, top: int = 50) -> DataFrame:
    """Value frequencies by count and then value, the true distinct count, and whether the list is cut."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return _top(counts, ["value"], top).select(F.lit(table).alias("table"), F.lit(column).alias("column"), "value", "n", "rank", "n_distinct", "truncated")


def unique_candidate(df: DataFrame, table: str, columns: list[str], nulls_together: bool = False) -> DataFrame:
    """(table, columns, n_duplicate_keys, has_duplicates) of a column or tuple; rows with a NULL are left out by default."""
    rows = df if nulls_together else df.dropna(subset=columns)
    twice = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("n_duplicate_keys"))
    return twice.select(F.lit(table).alias("table"), F.lit(",".join(columns)).alias("columns"), "n_duplicate_keys", (F.col("n_duplicate_keys") > 0).alias("has_duplicates"))


composite_unique_candidate = unique_candidate


def orphans(child: DataFrame, ref: Reference, parent: DataFrame) -> DataFrame:
    """Rows whose reference, with no column NULL, is missing from the parent's key."""
    keys = parent.select(*[F.col(k).alias(f"parent_key_{i}") for i, k in enumerate(ref.keys)])
    on = [F.col(c) == F.col(f"parent_key_{i}") for i, c in enumerate(ref.columns)]
    return child.dropna(subset=list(ref.columns)).join(keys, on, "left_anti")


def fk_reality(child: DataFrame, ref: Reference, parent: DataFrame | None, trusted: bool = False) -> DataFrame:
    """(reference, n_orphans, outcome); a trusted reference isn't probed, one without a parent table is ambiguous."""
    spark = child.sparkSession
    if trusted or parent is None:
        return spark.createDataFrame([(ref.name, 0, "TrustedConstraint" if trusted else "AmbiguousMapping")], "reference string, n_orphans long, outcome string")
    return orphans(child, ref, parent).agg(F.count(F.lit(1)).alias("n_orphans")).select(F.lit(ref.name).alias("reference"), "n_orphans", F.lit("Succeeded").alias("outcome"))


def fk_orphan_sample(child: DataFrame, ref: Reference, parent: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` least orphan values, with the rows of each."""
    found = orphans(child, ref, parent).groupBy(_value(ref).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
    return found.orderBy("value").limit(k).select(F.lit(ref.name).alias("reference"), "value", "n_rows")


def null_row_sample(df: DataFrame, key: str, column: str, k: int = 10) -> DataFrame:
    return df.filter(F.col(column).isNull()).select(F.col(key).alias("key")).orderBy("key").limit(k)


def _value(ref: Reference) -> Column:
    """The value of a reference: its column, or a struct of several."""
    return F.col(ref.columns[0]) if len(ref.columns) == 1 else F.struct(*ref.columns)


def _children(child: DataFrame, ref: Reference) -> DataFrame:
    return child.dropna(subset=list(ref.columns)).groupBy(_value(ref).alias("parent_key")).agg(F.count(F.lit(1)).alias("n"))


def fk_cardinality(child: DataFrame, ref: Reference) -> DataFrame:
    """Distribution of children per parent; needs five parents."""
    sizes = _children(child, ref).groupBy(F.lit(0).alias("subject"), F.col("n").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return _distributions(sizes, _named([(ref.name, "n")]))


def fk_selectivity(child: DataFrame, ref: Reference, top: int = 50) -> DataFrame:
    """The most referenced parent keys."""
    return _top(_children(child, ref), ["parent_key"], top).select(F.lit(ref.name).alias("reference"), "parent_key", "n", "rank", "n_distinct", "truncated")


def joint_distribution(child: DataFrame, columns: list[str], top: int = 100) -> DataFrame:
    """The most frequent tuples over several references of a table."""
    counts = child.dropna(subset=columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return _top(counts, columns, top)


def reference_value_counts(tables: dict[str, DataFrame], refs: list[Reference]) -> DataFrame:
    """Rows per referenced value, for every reference; values are numbers, or text where one reference has several columns."""
    out = None
    plain = all(len(r.columns) == 1 for r in refs)
    for r in refs:
        value = F.col("parent_key").cast("long") if plain else F.col("parent_key").cast("string") if len(r.columns) == 1 else F.concat_ws(",", *[F.col(f"parent_key.{c}").cast("string") for c in r.columns])
        part = _children(tables[r.child], r).select(F.lit(r.name).alias("reference"), value.alias("value"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def key_soundness(df: DataFrame, key: str) -> DataFrame:
    """(n_null_keys, n_duplicated_values) over the whole table."""
    by = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return by.agg(F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("n_null_keys"), F.count_if(F.col(key).isNotNull() & (F.col("n") > 1)).alias("n_duplicated_values"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("value")).dropna().distinct()


def content_mark(df: DataFrame) -> Column:
    """An aggregate: the sum, as text, of 60 bits of every row's digest.  Order doesn't count; equal rows add up."""
    row = F.conv(F.substring(row_digest(df), 1, 15), 16, 10).cast("decimal(38,0)")
    return F.coalesce(F.sum(row), F.lit(0)).cast("decimal(38,0)").cast("string")


def table_fingerprint(df: DataFrame, table: str, key: str) -> DataFrame:
    """Rows, largest key and an order-free content checksum in one scan."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.max(key).cast("string").alias("max_key"), content_mark(df).alias("checksum")).select(F.lit(table).alias("table"), "*")


def stale_tables(cached: DataFrame, live: DataFrame) -> DataFrame:
    """Tables whose stored fingerprint differs from the live one, or that one side lacks."""
    both = cached.alias("a").join(live.alias("b"), F.col("a.table") == F.col("b.table"), "full_outer")
    same = F.col("a.n_rows").eqNullSafe(F.col("b.n_rows")) & F.col("a.max_key").eqNullSafe(F.col("b.max_key")) & F.col("a.checksum").eqNullSafe(F.col("b.checksum"))
    return both.filter(~same).select(F.coalesce("a.table", "b.table").alias("table"))


def full_profile(tables: dict[str, DataFrame], contract: Contract, top: int = 50, joint_top: int = 100) -> dict[str, DataFrame]:
    """All axes over all tables of a contract, one frame per axis; text columns have their ``top`` values.

    The values of all columns, keys and tuples of references are counted first, see ``counts.count_values``, and every axis is
    derived from these counts.
    """
    spark = next(iter(tables.values())).sparkSession
    wanted: dict[str, tuple[DataFrame, list[tuple[str, ...]]]] = {}
    joint: dict[str, tuple[str, ...]] = {}
    unique: dict[str, list[tuple[str, ...]]] = {}
    for name, df in tables.items():
        declared, refs = contract.tables[name], contract.of(name)
        unique[name] = [u for u in dict.fromkeys([declared.key, *declared.unique]) if u]
        if len(refs) > 1:
            joint[name] = tuple(c for r in refs for c in r.columns)
        asked = [(c,) for c in df.columns] + unique[name] + [r.columns for r in refs] + [r.keys for r in contract.into(name)] + ([joint[name]] if name in joint else [])
        wanted[name] = (df, list(dict.fromkeys(asked)))
    counts, subjects = vc.count_values(wanted)
    at = {x: k for k, x in enumerate(subjects)}
    kinds = {(t, (f.name,)): f.dataType for t, df in tables.items() for f in df.schema.fields}
    told = save(vc.summary(counts), "summary")
    pick = lambda some, df: df.filter(F.col("subject").isin(*some))
    names = lambda: _named([(t, ",".join(c)) for t, c in subjects])
    out: dict[str, DataFrame] = {}

    singles = [k for k, x in enumerate(subjects) if x in kinds]
    every = spark.range(len(subjects)).select(F.col("id").cast("int").alias("subject")).join(told, "subject", "left").fillna(0, ["n_rows", "n_nulls", "n_distinct", "n_repeated"]).withColumn("_named", names())
    share = F.when(F.col("n_rows") > 0, F.col("n_nulls") / F.col("n_rows")).otherwise(F.lit(0.0))
    texts = [k for k in singles if kinds[subjects[k]].typeName() == "string"]
    longest = F.when(F.col("subject").isin(*texts), F.col("max_length"))
    all_null = (F.col("n_rows") > 0) & (F.col("n_nulls") == F.col("n_rows"))
    out["column_profile"] = pick(singles, every).select("_named.table", "_named.column", "n_rows", "n_nulls", longest.alias("max_length"), share.alias("null_share"), all_null.alias("all_null"), (F.col("n_nulls") == 0).alias("zero_null"))
    keys = [at[t, u] for t, us in unique.items() for u in us]
    out["unique_candidate"] = pick(keys, every).select("_named.table", F.col("_named.column").alias("columns"), F.col("n_repeated").alias("n_duplicate_keys"), (F.col("n_repeated") > 0).alias("has_duplicates"))

    # Children per parent are counts of counts; their subjects come behind the others.
    refs = [r for t in tables for r in contract.of(t)]
    numeric = [k for k in singles if vc.is_numeric(kinds[subjects[k]])]
    values = pick(numeric, counts).filter(vc.filled()).select("subject", vc.number().alias("value"), "n")
    of_ref = [at[r.child, r.columns] for r in refs]
    sizes = pick(of_ref, counts).filter(vc.filled()).groupBy((F.col("subject") + len(subjects)).alias("subject"), F.col("n").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    sizes = save(sizes, "sizes")
    behind = {at[r.child, r.columns]: r.name for r in refs}
    both = save(_distributions(values.unionByName(sizes), _named([(t, ",".join(c)) for t, c in subjects] + [(behind.get(k, ""), "#children") for k in range(len(subjects))])), "distributions")
    out["numeric_distribution"] = both.filter("column <> '#children'")
    out["fk_cardinality"] = both.filter("column = '#children'").withColumn("column", F.lit("n"))

    lists = save(vc.top_lists(pick([*texts, *of_ref, *[at[t, c] for t, c in joint.items()]], counts), max(top, joint_top)), "lists")
    lists = lists.join(told.select("subject", "n_distinct"), "subject").withColumn("_named", names())
    cut = lambda some, k: pick(some, lists).filter(F.col("rank") <= k).withColumn("truncated", F.col("n_distinct") > k)
    out["categorical_distribution"] = cut(texts, top).select("_named.table", "_named.column", F.col("text").alias("value"), "n", "rank", "n_distinct", "truncated")
    named_ref = F.element_at(F.create_map(*[F.lit(x) for k, name in behind.items() for x in (k, name)]), F.col("subject")) if behind else F.lit(None).cast("string")
    out["fk_selectivity"] = cut(of_ref, top).select(named_ref.alias("reference"), vc.shown().alias("parent_key"), "n", "rank", "n_distinct", "truncated")
    out["joint_distribution"] = cut([at[t, c] for t, c in joint.items()], joint_top).select("_named.table", F.col("text").alias("values"), "n", "rank", "n_distinct", "truncated")

    # Orphans: values of references that aren't among the values of the parent's key; both are grouped together, nothing else is.
    probed = [(k, at[r.child, r.columns], at[r.parent, r.keys]) for k, r in enumerate(refs) if r.parent in tables]
    lacking = [(r.name, 0, "AmbiguousMapping") for r in refs if r.parent not in tables]
    rows = lambda names, some: spark.range(1).select(F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, x, strict=True)]) for x in some])).alias("x")).select("x.*")
    of_refs = [rows(("reference", "n_orphans", "outcome"), lacking).withColumn("n_orphans", F.col("n_orphans").cast("long"))] if lacking else []
    if probed:
        sides = rows(("ref", "subject", "held"), [x for k, child, parent in probed for x in ((k, child, False), (k, parent, True))])
        keyed = pick(sorted({x for _, *both_ in probed for x in both_}), counts).filter(vc.filled()).join(F.broadcast(sides), "subject")
        by = keyed.groupBy("whole", "real", "text", "ref").agg(F.sum(F.when(F.col("held"), 0).otherwise(F.col("n"))).alias("n"), F.max("held").alias("held"))
        lost = by.groupBy("ref").agg(F.sum(F.when(F.col("held"), 0).otherwise(F.col("n"))).alias("n_orphans"))
        named = rows(("ref", "reference"), [(k, refs[k].name) for k, *_ in probed])
        of_refs.insert(0, named.join(lost, "ref", "left").select("reference", F.coalesce("n_orphans", F.lit(0).cast("long")).alias("n_orphans"), F.lit("Succeeded").alias("outcome")))
    out["fk_reality"] = union(of_refs) if of_refs else spark.createDataFrame([], "reference string, n_orphans long, outcome string")
    return out


SEVERITY = ("Succeeded", "TrustedConstraint", "AmbiguousMapping", "FallbackTimeout", "Cancelled")


def profile_merge(profiles: DataFrame, worst: bool = False) -> DataFrame:
    """Merge rows (table, column, n_rows, n_nulls, has_duplicates, outcome, captured_at) of several captures.

    Largest counts, either flag, newest time.  ``Succeeded`` wins, or with ``worst`` the worst outcome.
    """
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("outcome"))
    outcome = F.max_by("outcome", rank) if worst else F.min_by("outcome", rank)
    return profiles.groupBy("table", "column").agg(F.max("n_rows").alias("n_rows"), F.max("n_nulls").alias("n_nulls"), F.bool_or("has_duplicates").alias("has_duplicates"), outcome.alias("outcome"), F.max("captured_at").alias("captured_at"))


def distribution_merge(distributions: DataFrame) -> DataFrame:
    """Of several captures of ``numeric_distribution`` with captured_at, per column the one with the larger sample; of equals the newest."""
    rest = [c for c in distributions.columns if c not in ("table", "column")]
    best = distributions.groupBy("table", "column").agg(F.max_by(F.struct(*rest), F.struct("sample_size", "captured_at")).alias("b"))
    return best.select("table", "column", "b.*")


#: Axes that are lists or distributions: what names a subject, and what the larger evidence is told by.
_EVIDENCE = {
    "numeric_distribution": (("table", "column"), "sample_size"), "fk_cardinality": (("table", "column"), "sample_size"), "categorical_distribution": (("table", "column"), "n_distinct"),
    "fk_selectivity": (("reference",), "n_distinct"), "joint_distribution": (("table",), "n_distinct"),
}


def merge_profiles(profiles: list[dict[str, DataFrame]], worst: bool = False) -> dict[str, DataFrame]:
    """Profiles of several environments (axis -> frame, see ``full_profile``) as one, on every axis that any of them has.

    Counts, lengths and orphans are the largest, flags hold if they hold anywhere; of lists and distributions a subject has
    the whole of the environment with the most evidence (distinct values or sample, then rows, then by content, so the order
    of the environments doesn't count).  An orphan probe that succeeded anywhere did,
    or with ``worst`` the worst outcome stands.
    """
    out: dict[str, DataFrame] = {}
    for axis in dict.fromkeys(a for p in profiles for a in p):
        parts = [p[axis].withColumn("_env", F.lit(k)) for k, p in enumerate(profiles) if axis in p]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        if axis in _EVIDENCE:
            subject, by = _EVIDENCE[axis]
            columns = [c for c in parts[0].columns if c != "_env"]
            size = F.sum("n") if "n" in columns else F.max(by)
            told = every.groupBy(*subject, "_env").agg(F.max(by).alias("_by"), size.alias("_size"), F.sum(F.shiftright(F.xxhash64(*columns), 16)).alias("_mark"))
            best = told.groupBy(*subject).agg(F.max_by("_env", F.struct("_by", "_size", "_mark", -F.col("_env"))).alias("_best"))
            out[axis] = every.join(best, list(subject)).filter("_env = _best").select(*columns)
        elif axis == "column_profile":
            most = every.groupBy("table", "column").agg(*[F.max(c).alias(c) for c in ("n_rows", "n_nulls", "max_length")])
            share = F.when(F.col("n_rows") > 0, F.col("n_nulls") / F.col("n_rows")).otherwise(F.lit(0.0))
            out[axis] = most.select("*", share.alias("null_share"), ((F.col("n_rows") > 0) & (F.col("n_nulls") == F.col("n_rows"))).alias("all_null"), (F.col("n_nulls") == 0).alias("zero_null"))
        elif axis == "unique_candidate":
            out[axis] = every.groupBy("table", "columns").agg(F.max("n_duplicate_keys").alias("n_duplicate_keys"), F.bool_or("has_duplicates").alias("has_duplicates"))
        elif axis == "fk_reality":
            rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("outcome"))
            out[axis] = every.groupBy("reference").agg(F.max("n_orphans").alias("n_orphans"), (F.max_by("outcome", rank) if worst else F.min_by("outcome", rank)).alias("outcome"))
    return out


def worst_case_merge(profiles: DataFrame) -> DataFrame:
    return profile_merge(profiles, worst=True)


def sentinel_split(child: DataFrame, ref: Reference, parent: DataFrame, sentinel: int = 0) -> DataFrame:
    """Orphans that are the unset value, in all columns of the reference, and true orphans."""
    unset = F.lit(True)
    for c in ref.columns:
        unset = unset & (F.col(c) == sentinel)
    return orphans(child, ref, parent).agg(F.count_if(unset).alias("n_sentinel"), F.count_if(~unset).alias("n_orphans"))


def date_sentinel(df: DataFrame, column: str, sentinel: str = "1900-01-01") -> DataFrame:
    return df.agg(F.count_if(F.to_date(column) == F.lit(sentinel).cast("date")).alias("n_sentinel"))


def collation_collision(df: DataFrame, column: str) -> DataFrame:
    """Values that differ as stored but agree in lower case."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.lower(column).alias("folded")).agg(F.count_distinct(column).alias("n_forms")).filter("n_forms > 1")


def key_headroom(df: DataFrame, key: str, limit: int = 2**31 - 1) -> DataFrame:
    """Share of the storage ceiling that the largest key uses."""
    return df.agg(F.max(key).cast("long").alias("max_key")).select("max_key", (F.col("max_key") / F.lit(limit)).alias("used_share"))


def row_asymmetry(counts: DataFrame, factor: float = 2.0) -> DataFrame:
    """Tables of (env, table, n_rows) whose counts differ by more than a factor."""
    by = counts.groupBy("table").agg(F.min("n_rows").alias("least"), F.max("n_rows").alias("most"))
    return by.filter(F.col("most") > F.col("least") * factor)
