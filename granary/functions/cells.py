"""Scalar column expressions: predicates, canonical text, keys, masks, draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COL = Column | str


def _c(c: COL) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- typed predicates: NULL reads as empty text where a value is compared -------------------------------------------
def equals(c: COL, value: str) -> Column:
    return F.coalesce(_c(c).cast("string"), F.lit("")) == F.lit(value)


def is_in(c: COL, values: list[str]) -> Column:
    return F.coalesce(_c(c).cast("string"), F.lit("")).isin(values)


def all_of(*predicates: Column) -> Column:
    out = F.lit(True)
    for p in predicates:
        out = out & p
    return out


def raw(sql: str) -> Column:
    return F.expr(sql)


# -- text forms -----------------------------------------------------------------------------------------------------
def canonical_text(c: COL, kind: T.DataType) -> Column:
    """One text form per type, different for different values; NULL stays NULL.

    Binary floating point has the digits that tell it from its neighbours, NaN and Infinity by name.
    """
    c = _c(c)
    if isinstance(kind, T.BooleanType):
        return F.when(c, "true").when(~c, "false")
    if isinstance(kind, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    return c.cast("string")


def truncate_ms(c: COL) -> Column:
    return F.date_trunc("millisecond", _c(c))


def match_key(c: COL) -> Column:
    """Key for matching: blanks at the right end and letter case don't count."""
    return F.lower(F.rtrim(_c(c)))


def is_key(c: COL) -> Column:
    """Whether a raw value is a key at all; a blank one isn't."""
    return F.coalesce(F.trim(_c(c)) != "", F.lit(False))


def space_sentinel(c: COL) -> Column:
    """A single blank stands for NULL."""
    return F.when(_c(c) != F.lit(" "), _c(c))


def mask(c: COL, mode: str, n: int = 0) -> Column:
    """``redact``, ``keep_last``, ``keep_first`` (n characters) or ``hash``."""
    c = _c(c)
    stars = F.repeat(F.lit("*"), F.greatest(F.length(c) - n, F.lit(0)))
    if mode == "redact":
        return F.repeat(F.lit("*"), F.length(c))
    if mode == "keep_last":
        return F.when(F.length(c) <= n, c).otherwise(F.concat(stars, F.right(c, F.lit(n))))
    if mode == "keep_first":
        return F.when(F.length(c) <= n, c).otherwise(F.concat(F.left(c, F.lit(n)), stars))
    if mode == "hash":
        return F.substring(F.sha2(c, 256), 1, 8)
    raise ValueError(mode)


def cell_draw(seed: int, table: str, column: str, row: COL) -> Column:
    """A 60-bit draw that depends on seed, table, column and row only, so on no partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), F.lit(table), F.lit(column), _c(row).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def weighted_pick(draw: Column, weights: list[tuple[str, int]]) -> Column:
    """The value whose cumulated weight first exceeds draw mod the total, in the order given."""
    total, out, run = sum(w for _, w in weights), None, 0
    at = F.pmod(draw, F.lit(total))
    for value, w in weights:
        run += w
        out = F.when(at < run, value) if out is None else out.when(at < run, value)
    return out


def regex_extract(c: COL, pattern: str) -> Column:
    """Group ``target`` if named, else the first group, else the whole match; NULL without a match."""
    import re

    names = re.compile(pattern.replace("(?<", "(?P<")).groupindex
    groups = re.compile(pattern.replace("(?<", "(?P<")).groups
    group = names.get("target", 1 if groups else 0)
    return F.when(F.regexp_like(_c(c), F.lit(pattern)), F.regexp_extract(_c(c), pattern, group))


# -- whole-frame projections ----------------------------------------------------------------------------------------
def align_names(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def writable_projection(df: DataFrame, order: list[str], computed: list[str] = []) -> DataFrame:  # noqa: B006
    return df.select(*[c for c in order if c not in computed])


def canonical_order(df: DataFrame, key: list[str]) -> DataFrame:
    """Sorted by key, then all other columns, NULL first."""
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in [*key, *[c for c in df.columns if c not in key]]])
