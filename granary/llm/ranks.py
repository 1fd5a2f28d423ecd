"""Ranks within groups of any size from one range shuffle: sorted ranges, the rows of each group in them, offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.scratch import save


def ranked_in(df: DataFrame, group: list[str], order: list[str], name: str = "i") -> DataFrame:
    """``df`` with the rank from 0 of each row in its group and ``{name}_of``, the group's rows.

    A group may spread over many ranges; what is counted and summed per group is one row for each range that it is in.
    The ranges are written once, since their bounds come from a sample.
    """
    at, part = f"{name}_at", f"{name}_part"
    dealt = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn(at, F.monotonically_increasing_id())
    dealt = save(dealt.withColumn(part, F.shiftright(at, 33)), "ranked")
    spans = dealt.groupBy(*group, part).agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    own = Window.partitionBy(*group)
    spans = spans.withColumn("_before", F.sum("_rows").over(own.orderBy(part)) - F.col("_rows")).withColumn(f"{name}_of", F.sum("_rows").over(own))
    keys = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group] + [F.col(part) == F.col("_part")]
    few = spans.select(*[F.col(c).alias(f"_{c}") for c in group], F.col(part).alias("_part"), (F.col("_before") - F.col("_first")).alias("_shift"), f"{name}_of")
    joined = dealt.join(few, keys, "left").withColumn(name, F.col(at) + F.col("_shift"))
    return joined.select(*df.columns, name, f"{name}_of")
