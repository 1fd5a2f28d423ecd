"""Schema contracts: small driver-side metadata about tables, keys and references."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Reference:
    """Columns of a child that name a row of a parent; for a composite reference both sides are tuples in one order."""

    child: str
    column: str | tuple[str, ...]
    parent: str
    key: str | tuple[str, ...]

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.column,) if isinstance(self.column, str) else self.column

    @property
    def keys(self) -> tuple[str, ...]:
        return (self.key,) if isinstance(self.key, str) else self.key

    @property
    def name(self) -> str:
        return f"{self.child}.{'+'.join(self.columns)}"


@dataclass(frozen=True)
class Table:
    name: str
    key: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    computed: tuple[str, ...] = ()


@dataclass(frozen=True)
class Contract:
    tables: dict[str, Table]
    references: tuple[Reference, ...] = field(default=())

    def of(self, child: str) -> list[Reference]:
        return [r for r in self.references if r.child == child]

    def into(self, parent: str) -> list[Reference]:
        return [r for r in self.references if r.parent == parent]

    def levels(self) -> list[list[str]]:
        """Tables in load order: parents first; tables on a cycle come last, together."""
        left, out = dict.fromkeys(self.tables), []
        while left:
            ready = [t for t in left if not any(r.parent in left and r.parent != t for r in self.of(t))] or list(left)
            out.append(ready)
            for t in ready:
                left.pop(t)
        return out


STAR = Contract(
    {
        t.name: t
        for t in (
            Table("region", ("r_regionkey",), ("r_name",), (("r_name",),)),
            Table("nation", ("n_nationkey",), ("n_name",), (("n_name",),)),
            Table("customer", ("c_custkey",), ("c_name",), (("c_name",),)),
            Table("supplier", ("s_suppkey",), ("s_name",)),
            Table("part", ("p_partkey",), ("p_name",)),
            Table("orders", ("o_orderkey",), ("o_custkey",)),
            Table("lineitem"),
            Table("events", ("event_id",)),
        )
    },
    (
        Reference("nation", "n_regionkey", "region", "r_regionkey"),
        Reference("customer", "c_nationkey", "nation", "n_nationkey"),
        Reference("supplier", "s_nationkey", "nation", "n_nationkey"),
        Reference("orders", "o_custkey", "customer", "c_custkey"),
        Reference("lineitem", "l_orderkey", "orders", "o_orderkey"),
        Reference("lineitem", "l_partkey", "part", "p_partkey"),
        Reference("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        Reference("events", "user_id", "customer", "c_custkey"),
    ),
)


def read_table(spark: SparkSession, folder: str, name: str, schema=None) -> DataFrame:
    """One table of a folder; with a schema no inference takes place."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")
