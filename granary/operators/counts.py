"""Value counts of many columns from one shuffle, and what follows from them: order statistics, moments, top lists.

``count_values`` turns every wanted column, or tuple of columns, of a table into rows (subject, value) in one scan and
counts equal ones; map-side partial counts make hot values cheap.  Everything else reads these counts, which are written
once and are never larger than the values that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, DecimalType, DoubleType, FloatType, IntegralType, StringType, TimestampNTZType, TimestampType

from granary.functions.scratch import save, union

#: Rows of counts in a range of values, see ``distributions``.
RANGE = 100_000
#: One in so many counted values, by hash, bounds the lists of the most frequent, see ``top_lists``.
BOUND = 256

#: A subject: a table and one or several of its columns.
Subject = tuple[str, tuple[str, ...]]


def is_numeric(kind: DataType) -> bool:
    return isinstance(kind, IntegralType | DoubleType | FloatType | DecimalType)


def _text(c: str, kind: DataType) -> Column:
    """A cell as text that keeps its place in a tuple."""
    if isinstance(kind, StringType):
        return F.regexp_replace(F.col(f"`{c}`"), r"([\\,])", r"\\$1")
    return F.col(f"`{c}`").cast("string")


def _micros(c: Column) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone is."""
    minutes = (F.unix_date(c.cast("date")).cast("long") * 24 + F.hour(c)) * 60 + F.minute(c)
    return minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")


#: The columns of a counted value; one of them is filled, but of a decimal both text and real; none is NULL's mark.
KINDS = {"whole": "long", "real": "double", "text": "string"}


def _cells(df: DataFrame, columns: tuple[str, ...]) -> dict[str, Column]:
    """The columns of ``KINDS`` that hold a value."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if len(columns) > 1:
        known = F.lit(True)
        for c in columns:
            known = known & F.col(f"`{c}`").isNotNull()
        return {"text": F.when(known, F.concat_ws(",", *[_text(c, kinds[c]) for c in columns]))}
    c, kind = F.col(f"`{columns[0]}`"), kinds[columns[0]]
    if isinstance(kind, IntegralType):
        return {"whole": c.cast("long")}
    if isinstance(kind, DoubleType | FloatType):
        return {"real": c.cast("double")}
    if isinstance(kind, DateType):
        return {"whole": F.unix_date(c).cast("long")}
    if isinstance(kind, TimestampType):
        return {"whole": F.unix_micros(c)}
    if isinstance(kind, TimestampNTZType):
        return {"whole": _micros(c)}
    return {"text": c.cast("string")} | ({"real": c.cast("double")} if isinstance(kind, DecimalType) else {})


def _fixed(columns: tuple[str, ...], kinds: dict[str, DataType]) -> bool:
    """Whether a subject's values are numbers or dates of fixed width."""
    return len(columns) == 1 and isinstance(kinds[columns[0]], IntegralType | DoubleType | FloatType | DateType | TimestampType | TimestampNTZType)


def _whole_tuple(columns: tuple[str, ...], kinds: dict[str, DataType]) -> bool:
    """Whether a subject is a tuple of whole numbers: equal numbers have equal text, and the other way round."""
    return len(columns) > 1 and all(isinstance(kinds[c], IntegralType) for c in columns)


def _rows(df: DataFrame, own: list[tuple[int, tuple[str, ...]]], stored: list[str]) -> DataFrame:
    """(subject and the ``stored`` kinds) of every row and subject: only the subjects' numbers are exploded, each picks its cell."""
    cells = {(kind, k): cell for k, c in own for kind, cell in _cells(df, c).items()}
    rows = df.select(*[cell.alias(f"{kind}_{k}") for (kind, k), cell in cells.items()]).select("*", F.explode(F.array(*[F.lit(k) for k, _ in own])).alias("subject"))
    picked = []
    for kind in stored:
        cell = F
        for k in [k for of, k in cells if of == kind]:
            cell = cell.when(F.col("subject") == k, F.col(f"{kind}_{k}"))
        picked.append((F.lit(None) if cell is F else cell).cast(KINDS[kind]).alias(kind))
    return rows.select("subject", *picked)


def _completed(counted: DataFrame) -> DataFrame:
    """Saved counts of some kinds with the columns of all kinds."""
    return counted.select("subject", *[F.col(k) if k in counted.columns else F.lit(None).cast(kind).alias(k) for k, kind in KINDS.items()], "n")


def _tuples(df: DataFrame, subject: int, columns: tuple[str, ...]) -> DataFrame:
    """Saved counts of a tuple of whole numbers, grouped as numbers and written as text once each; NULL may come in several rows."""
    counted = df.groupBy(*[F.col(f"`{c}`").alias(f"k_{i}") for i, c in enumerate(columns)]).agg(F.count(F.lit(1)).alias("n"))
    text = _cells(counted, tuple(f"k_{i}" for i in range(len(columns))))["text"]
    return save(counted.select(text.alias("text"), "n"), "tuples").withColumn("subject", F.lit(subject))


def count_values(wanted: dict[str, tuple[DataFrame, list[tuple[str, ...]]]]) -> tuple[DataFrame, list[Subject]]:
    """(subject, whole, real, text, n) and the subjects by number; NULL, or a tuple with one, has all three NULL.

    Numbers and dates have short keys of fixed width and are counted apart from texts and other tuples, so a table is read
    twice, each time only the columns of its kind, and each kind is one shuffle for all tables.  A tuple of whole numbers is
    read and counted by itself, as numbers.  Each part is saved by itself: a step that needs one kind reads the files of that
    kind only, and these are split evenly.
    """
    subjects: list[Subject] = []
    parts: dict[bool, list[tuple[DataFrame, list[tuple[int, tuple[str, ...]]]]]] = {False: [], True: []}
    counted: list[DataFrame] = []
    for name, (df, columns) in wanted.items():
        first = len(subjects)
        subjects += [(name, c) for c in columns]
        kinds = {f.name: f.dataType for f in df.schema.fields}
        counted += [_tuples(df, first + k, c) for k, c in enumerate(columns) if _whole_tuple(c, kinds)]
        for fixed in parts:
            own = [(first + k, c) for k, c in enumerate(columns) if _fixed(c, kinds) is fixed and not _whole_tuple(c, kinds)]
            if own:
                parts[fixed].append((df, own))
    for fixed, of in parts.items():
        if of:
            held = {kind for df, own in of for _, c in own for kind in _cells(df, c)}
            stored = [kind for kind in KINDS if kind in held]
            counted.append(save(union([_rows(df, own, stored) for df, own in of]).groupBy("subject", *stored).agg(F.count(F.lit(1)).alias("n")), "numbers" if fixed else "texts"))
    return union([_completed(x) for x in counted]), subjects


def filled() -> Column:
    """Whether a row of counts has a value."""
    return F.coalesce(F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("text").isNotNull(), F.lit(False))


def number() -> Column:
    return F.coalesce(F.col("real"), F.col("whole").cast("double"))


def shown() -> Column:
    """A counted value as text."""
    return F.coalesce("text", F.col("whole").cast("string"), F.col("real").cast("string"))


def summary(counts: DataFrame) -> DataFrame:
    """(subject, n_rows, n_nulls, n_distinct, n_repeated, max_length): one row per subject."""
    return counts.groupBy("subject").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(~filled(), F.col("n"))), F.lit(0)).alias("n_nulls"), F.count_if(filled()).alias("n_distinct"),
        F.count_if(filled() & (F.col("n") > 1)).alias("n_repeated"), F.max(F.length("text")).cast("long").alias("max_length"),
    )


def distributions(counts: DataFrame, group: str, shares: tuple[float, ...]) -> DataFrame:
    """(group, sample_size, min, max, mean, stddev, p) of rows (group, value, n); a value may come in several rows.

    ``p`` has the linear interpolation at (sample_size - 1) * share for each share, deviations are taken from the mean.  The
    counts are dealt once into ranges of (group, value), about ``RANGE`` rows each however large the input is.  Sums per group and range tell in which range each wanted rank lies,
    and only these ranges are summed up value by value to find the two neighbours of a share.
    """
    ranges = counts.count() // RANGE + 2
    ranged = save(counts.select(group, "value", "n").repartitionByRange(ranges, group, "value").withColumn("_part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(group)
    spans = ranged.groupBy(group, "_part").agg(F.sum("n").alias("_rows"), F.min("value").alias("_min"), F.max("value").alias("_max"), F.sum(F.col("value") * F.col("n")).alias("_sum"))
    spans = save(spans.withColumn("_before", F.sum("_rows").over(own.orderBy("_part")) - F.col("_rows")).withColumn("_all", F.sum("_rows").over(own)), "spans")
    asked = spans.select(group, "_part", "_before", "_rows", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), ((F.col("_all") - 1) * F.lit(p)).alias("at")) for k, p in enumerate(shares)])).alias("s"))
    asked = asked.select(group, "_part", "_before", "_rows", "s.k", "s.at", F.floor("s.at").alias("low"), F.ceil("s.at").alias("high"))
    inside = lambda rank, first, n: (F.col(rank) >= first) & (F.col(rank) < first + n)
    asked = asked.filter(inside("low", F.col("_before"), F.col("_rows")) | inside("high", F.col("_before"), F.col("_rows"))).drop("_rows")
    near = ranged.join(asked.select(group, "_part").distinct(), [group, "_part"], "left_semi")
    running = Window.partitionBy(group, "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("_upto", F.sum("n").over(running))
    first = F.col("_before") + F.col("_upto") - F.col("n")
    found = near.join(asked, [group, "_part"]).filter(inside("low", first, F.col("n")) | inside("high", first, F.col("n")))
    hit = lambda rank: F.max(F.when(inside(rank, first, F.col("n")), F.col("value")))
    ends = found.groupBy(group, "k", "at", "low", "high").agg(hit("low").alias("a"), hit("high").alias("b"))
    value = F.when(F.col("low") == F.col("high"), F.col("a")).otherwise((F.col("high") - F.col("at")) * F.col("a") + (F.col("at") - F.col("low")) * F.col("b"))
    points = ends.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", value.alias("v")))), lambda x: x["v"]).alias("p"))
    whole = spans.groupBy(group).agg(F.sum("_rows").alias("sample_size"), F.min("_min").alias("min"), F.max("_max").alias("max"), (F.sum("_sum") / F.sum("_rows")).alias("mean"))
    apart = F.col("value") - F.col("_mean")
    spread = ranged.join(whole.select(group, F.col("mean").alias("_mean")), group).groupBy(group).agg(F.sqrt(F.sum(F.col("n") * apart * apart) / F.sum("n")).alias("stddev"))
    return whole.join(spread, group).join(points, group)


def contenders(counts: DataFrame, top: int) -> DataFrame:
    """The rows of counts that can be among the ``top`` of their subject.

    Where one in ``BOUND`` values, taken by hash, already holds ``top`` of a subject, the last of these bounds the list: whatever
    comes behind it has ``top`` values before it.  About ``top * BOUND`` rows a subject are left, so the sort stays small.
    """
    place = F.struct((-F.col("n")).alias("n"), "whole", "real", "text")
    some = counts.filter(filled() & (F.pmod(F.xxhash64("whole", "real", "text"), F.lit(BOUND)) == 0))
    order = Window.partitionBy("subject").orderBy(F.col("n").desc(), "whole", "real", "text")
    last = some.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= top).filter(F.col("_at") == top).select("subject", place.alias("_last"))
    return counts.filter(filled()).join(F.broadcast(last), "subject", "left").filter(F.col("_last").isNull() | (place <= F.col("_last"))).drop("_last")


def top_lists(counts: DataFrame, top: int) -> DataFrame:
    """The ``top`` most frequent values of each subject with ``rank``; of equal counts the smaller value.

    Each partition keeps its own ``top`` before any row is dealt by subject, and sorts ``contenders`` only.
    """
    order = Window.partitionBy("subject").orderBy(F.col("n").desc(), "whole", "real", "text")
    return contenders(counts, top).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))
