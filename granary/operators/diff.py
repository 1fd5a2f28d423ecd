"""Digests and diffs of tables; all of them shuffle on the key once, or not at all."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from granary.contract import Contract
from granary.functions.cells import canonical_text
from granary.functions.scratch import drop, save, union
from granary.operators.components import connected_components

SEP = "\x1e"


def row_digest(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of name=length:value joined, names sorted, NULL cells left out; the length keeps cells apart."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def cell(c: str) -> Column:
        text = canonical_text(c, kinds[c])
        return F.concat(F.lit(f"{c}="), F.length(text).cast("string"), F.lit(":"), text)

    return F.sha2(F.concat_ws(SEP, *[cell(c) for c in sorted(columns or df.columns)]), 256)


#: Hex digits of a limb of a digest; sums of so many bits as longs hold for 2**35 rows in one partial sum.
_DIGITS = 7


def table_digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(n_rows, digest): the sum of all row hashes modulo 2**256 as hex; order and partitions don't matter.

    Limbs of 28 bits are summed apart as longs; more rows than these hold raise an overflow.  The carries run on the one
    row of the result, as an array.
    """
    h = df.select(row_digest(df, columns).alias("h"))
    cuts = [(max(0, 64 - _DIGITS * (k + 1)), 64 - _DIGITS * k) for k in range(-(-64 // _DIGITS))]  # lowest first
    limb = lambda a, b: F.conv(F.substring("h", a + 1, b - a), 16, 10).cast("long")
    sums = h.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*[F.coalesce(F.sum(limb(a, b)), F.lit(0)) for a, b in cuts]).alias("s"))
    base = 1 << (4 * _DIGITS)
    step = lambda acc, x: F.struct((F.shiftright(acc["carry"] + x, 4 * _DIGITS)).alias("carry"), F.concat(F.lpad(F.hex((acc["carry"] + x).bitwiseAND(F.lit(base - 1))), _DIGITS, "0"), acc["text"]).alias("text"))
    text = F.aggregate("s", F.struct(F.lit(0).cast("long").alias("carry"), F.lit("").alias("text")), step)["text"]
    return sums.select("n_rows", F.lower(F.right(text, F.lit(64))).alias("digest"))


def server_digest(df: DataFrame, key: list[str]) -> DataFrame:
    """``table_digest`` for tables that two servers can be trusted to read alike: those with one whole number as their key.

    Text keys are ordered by collation, which two servers may not share, and several or no key columns name no single order;
    such tables are refused and take the cell by cell comparison.
    """
    if len(key) != 1:
        raise ValueError("the table has no key" if not key else "the key has several columns")
    if not isinstance(df.schema[key[0]].dataType, IntegralType):
        raise ValueError(f"the key {key[0]} isn't a whole number")
    return table_digest(df)


def _sides(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Full outer join on the key with the columns as a_* and b_*, and in_a, in_b."""
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns], F.lit(True).alias("in_a"))
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns], F.lit(True).alias("in_b"))
    on = F.lit(True)
    for k in key:
        on = on & (F.col(f"a_{k}") == F.col(f"b_{k}"))
    return left.join(right, on, "full_outer")


def differing_columns(columns: list[str], limit: int | None = 4) -> Column:
    """Names of differing cells of a joined row, sorted, at most ``limit``."""
    names = F.array_compact(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), c) for c in sorted(columns)]))
    return F.slice(names, 1, limit) if limit else names


#: Most key ranges of a comparison whose numbers come to the driver, and rows in one at least.
RANGES, RANGE_ROWS = 1 << 16, 256
#: The same for ``row_diff``, so that scattered differences leave most rows alone; numbers beyond ``RANGES`` stay a bitmap.
FINE_RANGES, FINE_ROWS = 1 << 24, 32
#: Most intervals of ranges that go to the scan as a condition on the key.
INTERVALS = 200


@dataclass(frozen=True)
class KeyRanges:
    """Equal widths of the first key column between two ends, or, for keys that aren't numbers, classes of hashes."""

    key: tuple[str, ...]
    n: int
    low: float | None
    width: float

    @staticmethod
    def of(a: DataFrame, b: DataFrame, key: list[str], most: int = RANGES, least: int = RANGE_ROWS) -> KeyRanges:
        kind = a.schema[key[0]].dataType
        if not isinstance(kind, IntegralType) or not isinstance(b.schema[key[0]].dataType, IntegralType):
            rows = a.count() + b.count()
            return KeyRanges(tuple(key), max(1, min(most, rows // least)), None, 0)
        ends = a.select(key[0]).union(b.select(key[0])).agg(F.count(F.lit(1)), F.min(key[0]), F.max(key[0])).first()
        n = max(1, min(most, ends[0] // least))
        return KeyRanges(tuple(key), n, ends[1] or 0, max(1, -(-((ends[2] or 0) - (ends[1] or 0) + 1) // n)))

    def number(self) -> Column:
        """The range of a row; -1 for a NULL in the first key column."""
        if self.low is None:
            return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.key]), F.lit(self.n)).cast("int")
        return F.coalesce(F.expr(f"cast((cast(`{self.key[0]}` as long) - {self.low}L) div {self.width}L as int)"), F.lit(-1))

    def rows_of(self, df: DataFrame, numbers: list[int]) -> DataFrame:
        """The rows in some ranges; few intervals are a condition on the key, so that the scan skips the rest."""
        own = sorted(numbers)
        if self.low is not None:
            first = [x for k, x in enumerate(own) if x >= 0 and (not k or own[k - 1] != x - 1 or own[k - 1] < 0)]
            last = [x for k, x in enumerate(own) if x >= 0 and (k + 1 == len(own) or own[k + 1] != x + 1)]
            if len(first) <= INTERVALS:
                key, some = F.col(f"`{self.key[0]}`"), F.lit(False)
                for x, y in zip(first, last, strict=True):
                    some = some | key.between(self.low + x * self.width, self.low + (y + 1) * self.width - 1)
                return df.filter((some | key.isNull()) if -1 in own else some)
        few = df.sparkSession.createDataFrame([(x,) for x in own], "_range int")  # at most RANGES numbers
        return df.withColumn("_range", self.number()).join(F.broadcast(few), "_range", "left_semi").drop("_range")

    def rows_of_bits(self, df: DataFrame, bits: DataFrame) -> DataFrame:
        """The rows in the ranges of a bitmap (word, mask), which has at most a row for 64 ranges."""
        ranged = df.withColumn("_range", self.number()).withColumn("_word", F.shiftright("_range", 6))
        found = ranged.join(F.broadcast(bits), F.col("_word") == F.col("word"))
        return found.filter(F.expr("shiftright(mask, _range & 63) & 1 = 1")).select(*[F.col(f"`{c}`") for c in df.columns])


def _differing(a: DataFrame, b: DataFrame, ranges: KeyRanges, columns: list[str]) -> DataFrame:
    """(range): the key ranges whose rows aren't the same on both sides; one scan of each.

    Per range the rows are counted and a hash of them summed in halves, those of b negative: a range that differs passes for
    equal with a probability of 2**-64.  Order, copies of a range's parts and partitions don't matter.
    """
    cells = [F.col(f"`{c}`") for c in columns]
    # A hash passes over NULL cells, so where they are is hashed too, 32 columns a number.
    flags = [F.when(c.isNull(), F.lit(1 << (k % 32))).otherwise(F.lit(0)).cast("long") for k, c in enumerate(cells)]
    nulls = [reduce(lambda x, y: x.bitwiseOR(y), flags[k : k + 32]) for k in range(0, len(flags), 32)]
    side = lambda df, sign: df.select(ranges.number().alias("range"), F.xxhash64(*cells, *nulls).alias("_h"), F.lit(sign).cast("long").alias("_sign"))
    halves = [F.sum(F.col("_sign") * x) for x in (F.col("_h").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("_h", 32))]
    sums = side(a, 1).union(side(b, -1)).groupBy("range").agg(F.sum("_sign").alias("s"), *[x.alias(f"s{k}") for k, x in enumerate(halves)])
    return sums.filter(" OR ".join(f"{c} <> 0" for c in sums.columns[1:])).select("range")


def differing_ranges(a: DataFrame, b: DataFrame, ranges: KeyRanges, columns: list[str]) -> list[int]:
    """The key ranges whose rows aren't the same on both sides, for at most ``RANGES`` ranges."""
    return [r["range"] for r in _differing(a, b, ranges, columns).collect()]


def paired_rows(a: DataFrame, b: DataFrame, key: list[str], keep_equal: bool = False) -> DataFrame:
    """Rows of both sides as multisets: (a_*, b_*, in_a, in_b, same), NULL keys being equal to each other.

    Equal rows of both sides cancel out, copy by copy (with ``keep_equal`` they stay as pairs).  What is left of a key is
    paired in the order of its cells, the rest stands alone.  With ``keep_equal`` everything happens in one shuffle by the
    key; without, rows cancel out by all their cells first, so that many rows of one key don't meet, and the rest goes by the key.
    """
    columns = a.columns
    side = lambda df, x, y: df.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)], F.lit(x).alias("_a"), F.lit(y).alias("_b"))
    own = [f"c{columns.index(k)}" for k in key]
    rest = [f"c{k}" for k in range(len(columns))]
    counted = side(a, 1, 0).union(side(b, 0, 1)).repartition(*(own if keep_equal else rest)).groupBy(*rest).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    if not keep_equal:
        counted = counted.filter("_a <> _b")
    entry = lambda x, n: F.transform(F.sequence(F.lit(1), n), lambda _: F.lit(x))
    none = F.array().cast("array<string>")
    equal = F.least("_a", "_b")
    copies = F.concat(
        F.when((equal > 0) & F.lit(keep_equal), entry("=", equal)).otherwise(none), F.when(F.col("_a") > F.col("_b"), entry("a", F.col("_a") - F.col("_b"))).otherwise(none),
        F.when(F.col("_b") > F.col("_a"), entry("b", F.col("_b") - F.col("_a"))).otherwise(none),
    )
    rows = counted.select(*rest, F.explode(copies).alias("_side"))
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*own, "_side").orderBy(*[x for x in rest if x not in own], "_side")))
    cells = F.struct(*rest)
    of = lambda x: F.first(F.when(F.col("_side").isin(x, "="), cells), ignorenulls=True)
    pairs = rows.groupBy(*own, F.when(F.col("_side") == "=", "=").otherwise("x").alias("_kind"), "_at").agg(of("a").alias("_a"), of("b").alias("_b"))
    return pairs.select(
        *[F.col(f"_a.c{k}").alias(f"a_{c}") for k, c in enumerate(columns)], *[F.col(f"_b.c{k}").alias(f"b_{c}") for k, c in enumerate(columns)],
        F.when(F.col("_a").isNotNull(), True).alias("in_a"), F.when(F.col("_b").isNotNull(), True).alias("in_b"), (F.col("_kind") == "=").alias("same"),
    )


def row_diff(a: DataFrame, b: DataFrame, key: list[str], limit: int | None = 4) -> DataFrame:
    """(key..., state, columns): rows that are missing from b, extra in b, or differ.

    Additive digests per key range find the ranges that differ, in one scan of each side; only the rows of these are
    read again and compared, so equal ranges never travel.  Ranges are short, as differences may be all over the keys.
    Rows of a key are compared as multisets and NULL keys are equal, so a table never differs from itself.
    """
    columns = a.columns
    b = b.select(*[F.col(f"`{c}`") for c in columns])
    ranges = KeyRanges.of(a, b, key, FINE_RANGES, FINE_ROWS)
    found = save(_differing(a, b, ranges, columns), "differing")
    if found.count() <= RANGES:
        some = [r["range"] for r in found.collect()]
        left = [ranges.rows_of(x, some) for x in (a, b)]
        drop(found)
    else:
        bits = found.groupBy(F.shiftright("range", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, range & 63)")).alias("mask"))
        left = [ranges.rows_of_bits(x, bits) for x in (a, b)]
    both = paired_rows(*left, key)
    names = differing_columns([c for c in columns if c not in key], limit)
    state = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").otherwise("differs")
    return both.select(*[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in key], state.alias("state"), F.when(state == "differs", names).otherwise(F.array().cast("array<string>")).alias("columns"))


def fidelity_report(pairs: dict[str, tuple[DataFrame, DataFrame, list[str]]]) -> DataFrame:
    """Per table: rows, digests, differences and verdict; a table without a key keeps the digest verdict."""
    out = None
    for name, (a, b, key) in pairs.items():
        da = table_digest(a).select(F.col("n_rows").alias("n_source"), F.col("digest").alias("source_digest"))
        db = table_digest(b).select(F.col("n_rows").alias("n_target"), F.col("digest").alias("target_digest"))
        row = da.join(db)
        if key:
            row = row.join(row_diff(a, b, key).agg(F.count(F.lit(1)).alias("n_differences")))
        else:
            row = row.withColumn("n_differences", F.lit(None).cast("long"))
        row = row.select(F.lit(name).alias("table"), "*", F.when(F.col("source_digest") == F.col("target_digest"), "identical").otherwise("different").alias("verdict"))
        out = row if out is None else out.unionByName(row)
    return out


def replay_rewrites(df: DataFrame, key: str, key_map: DataFrame, fk_maps: dict[str, DataFrame]) -> DataFrame:
    """Key and references of a source as the target has them; maps are (source_key, assigned_key)."""
    out = df
    for column, m in {key: key_map, **fk_maps}.items():
        m = m.select(F.col("source_key").alias("_s"), F.col("assigned_key").alias("_t"))
        out = out.join(m, F.col(column) == F.col("_s"), "left").withColumn(column, F.coalesce("_t", F.col(column))).drop("_s", "_t")
    return out


def digest_reconcile(live: DataFrame, stored: DataFrame) -> DataFrame:
    """Tables of (table, n_rows, digest) whose live digest isn't the stored one."""
    both = live.alias("a").join(stored.alias("b"), F.col("a.table") == F.col("b.table"), "full_outer")
    return both.select(F.coalesce("a.table", "b.table").alias("table"), (F.col("a.digest").eqNullSafe(F.col("b.digest")) & F.col("a.n_rows").eqNullSafe(F.col("b.n_rows"))).alias("same"))


def integrity_check(a: DataFrame, b: DataFrame) -> DataFrame:
    """Deltas between two ``null_counts`` frames: rows, NULLs, and columns on one side only."""
    both = a.alias("a").join(b.alias("b"), (F.col("a.table") == F.col("b.table")) & (F.col("a.column") == F.col("b.column")), "full_outer")
    out = both.select(F.coalesce("a.table", "b.table").alias("table"), F.coalesce("a.column", "b.column").alias("column"), (F.col("b.n_rows") - F.col("a.n_rows")).alias("row_delta"), (F.col("b.n_nulls") - F.col("a.n_nulls")).alias("null_delta"))
    return out.filter("row_delta IS NULL OR row_delta <> 0 OR null_delta <> 0")


def classify_changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Added, Deleted, Changed or Unchanged per row, with the fields before and after; without a key all are added.

    Rows of a repeated key are compared as multisets, and NULL keys are equal, see ``paired_rows``.
    """
    if not key:
        return after.select(F.lit("Added").alias("change"))
    rest = [c for c in before.columns if c not in key]
    both = paired_rows(before, after.select(*before.columns), key, keep_equal=True)
    field = lambda c: F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").cast("string").alias("before"), F.col(f"b_{c}").cast("string").alias("after"))
    fields = F.array_compact(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), field(c)) for c in sorted(rest)]))
    change = F.when(F.col("in_a").isNull(), "Added").when(F.col("in_b").isNull(), "Deleted").when(F.size(fields) > 0, "Changed").otherwise("Unchanged")
    return both.select(*[F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in key], change.alias("change"), F.when(change == "Changed", fields).alias("fields"))


def impact_summary(changes: DataFrame) -> DataFrame:
    """Per table of (table, change): rows before, added, deleted, changed, unchanged."""
    n = lambda k: F.count_if(F.col("change") == k)
    return changes.groupBy("table").agg((n("Deleted") + n("Changed") + n("Unchanged")).alias("n_before"), n("Added").alias("n_added"), n("Deleted").alias("n_deleted"), n("Changed").alias("n_changed"), n("Unchanged").alias("n_unchanged"))


def impact_documents(roots: DataFrame, key: str, parents: dict[str, tuple[DataFrame, str]], children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Changed roots with each referenced parent inlined as a struct and children nested as sorted arrays."""
    out = roots
    for column, (parent, parent_key) in parents.items():
        p = parent.select(F.col(parent_key).alias("_k"), F.struct(*parent.columns).alias(f"{column}_row"))
        out = out.join(p, F.col(column) == F.col("_k"), "left").drop("_k")
    for name, (child, fk) in children.items():
        c = child.groupBy(F.col(fk).alias("_k")).agg(F.sort_array(F.collect_list(F.struct(*child.columns))).alias(name))
        out = out.join(c, F.col(key) == F.col("_k"), "left").drop("_k")
    return out


def nested_documents(contract: Contract, tables: dict[str, DataFrame], root: str, reconciled: set[str] = frozenset()) -> DataFrame:
    """One document per row of ``root``: rows that refer to it nested as sorted arrays, to any depth, parents in ``reconciled`` inlined.

    The nesting follows the contract from the leaves up: a table's rows get the documents of their children, are grouped
    by the reference, and go on to their own parents, one shuffle per reference.  A table that is on the way from the root
    already isn't nested again.  The array of a reference is named ``child.columns``, the struct of a parent ``columns_row``;
    rows without children have NULL.
    """

    def documents(table: str, way: tuple[str, ...]) -> DataFrame:
        out = tables[table]
        for r in contract.of(table):
            if r.parent in reconciled and r.parent in tables:
                p = tables[r.parent]
                inlined = p.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(r.keys)], F.struct(*p.columns).alias(f"{'+'.join(r.columns)}_row"))
                out = out.join(inlined, [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(r.columns)], "left").drop(*[f"_k{i}" for i in range(len(r.keys))])
        for r in contract.into(table):
            if r.child in tables and r.child not in reconciled and r.child not in way:
                child = documents(r.child, (*way, r.child))
                lists = child.dropna(subset=list(r.columns)).groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(r.columns)]).agg(F.sort_array(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in child.columns]))).alias(r.name))
                out = out.join(lists, [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(r.keys)], "left").drop(*[f"_k{i}" for i in range(len(r.columns))])
        return out

    return documents(root, (root,))


def change_units(contract: Contract, changed: dict[str, DataFrame], scope: set[str]) -> DataFrame:
    """(unit, n_added, n_deleted, n_changed, escapes): changed rows that references tie together, over all tables.

    ``changed`` holds per table its rows with ``change`` (see ``classify_changes``); unchanged rows tie nothing.  Two changed
    rows are of one unit if one refers to the other, directly or over others; a unit is named by its least row
    (``table:key``).  It escapes if a row of it refers to a table outside ``scope``.
    """
    node = lambda t, columns: F.concat(F.lit(f"{t}:"), F.concat_ws(",", *[F.col(c).cast("string") for c in columns]))
    rows, edges = [], []
    moved = {t: df.filter("change <> 'Unchanged'") for t, df in changed.items()}
    for t, df in moved.items():
        out = F.lit(False)
        for r in contract.of(t):
            filled = F.lit(True)
            for c in r.columns:
                filled = filled & F.col(c).isNotNull()
            if r.parent not in scope:
                out = out | filled
            if r.parent in moved and tuple(r.keys) == tuple(contract.tables[r.parent].key):
                edges.append(df.filter(filled).select(node(t, contract.tables[t].key).alias("src"), node(r.parent, r.columns).alias("dst")))
        rows.append(df.select(node(t, contract.tables[t].key).alias("node"), "change", out.alias("_out")))
    every = save(union(rows), "changed-rows")
    if edges:
        there = every.select("node").distinct()
        ties = union(edges).join(there.select(F.col("node").alias("dst")), "dst", "left_semi")
        of = connected_components(ties)
        every = every.join(of, "node", "left").withColumn("unit", F.coalesce("component", "node"))
    else:
        every = every.withColumn("unit", F.col("node"))
    n = lambda k: F.count_if(F.col("change") == k)
    return every.groupBy("unit").agg(n("Added").alias("n_added"), n("Deleted").alias("n_deleted"), n("Changed").alias("n_changed"), F.bool_or("_out").alias("escapes"))


def impact_triage(units: DataFrame) -> DataFrame:
    """Rank units (unit, n_added, n_deleted, n_changed, escapes): band first, then churn, 1000 more if it escapes."""
    churn = F.col("n_added") + F.col("n_deleted") + F.col("n_changed")
    band = F.when(F.col("escapes"), "escaping").when(F.col("n_deleted") > 0, "deleting").when(F.col("n_changed") > 0, "changing").when(F.col("n_added") > 0, "adding").otherwise("quiet")
    out = units.withColumn("class", band).withColumn("score", churn + F.when(F.col("escapes"), 1000).otherwise(0))
    order = F.array_position(F.array(*map(F.lit, ("escaping", "deleting", "changing", "adding", "quiet"))), F.col("class"))
    return out.withColumn("band", order).orderBy("band", F.col("score").desc(), "unit")


def drift_guard(seed: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks; a load is refused unless this is empty."""
    one = seed.exceptAll(target).select(F.lit("missing").alias("side"), "*")
    return one.unionByName(target.exceptAll(seed).select(F.lit("extra").alias("side"), "*"))
