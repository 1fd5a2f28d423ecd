"""Merkle manifest of a dataset: a tree of digests per source, and proofs that survive or betray a changed row.

Every row is a leaf; runs of ``FAN`` nodes become the digest of their digests until one is left per source (its subroot),
and subroots in the order of their sources become the root in the same way.  Trees are cut into aligned blocks of
``FAN ** HEIGHT`` nodes.  A block is built in one task as a persistent tree; a tampered leaf makes a version of it that
shares every untouched node and copies only the ancestors of the leaf (``with_leaf``).  The roots of blocks are the nodes
of the next, far smaller, round, and so on; a version goes on above its block along the siblings of the block's root,
which come to the task with the block, so versions never meet in one place however many there are.

Two passes read the leaves: one for the roots of blocks, and, when the upper rounds are done, one for proofs and versions.
Texts are digested in the scan and never travel.

Defined results: a null doc_id is the leaf ``-`` in that place, stands before all ids and is never tampered with; equal
doc_ids of a source stand in the order of their leaves; a null source is a tree of its own, first in order; an empty table
has no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.scratch import drop, save
from granary.llm.ranks import ranked_in

FAN = 3
#: Levels of a block: 729 leaves.
HEIGHT = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ALL = ""


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


class Node(NamedTuple):
    """A node that never changes; versions of a tree share it."""

    digest: str
    children: tuple[Node, ...] = ()


def build(leaves: list[str], size: int) -> tuple[Node, int]:
    """(top, height) of a block's persistent tree; it is as high as a whole tree of ``size`` leaves, but for ``HEIGHT``."""
    level, height = [Node(d) for d in leaves], 0
    while size > 1 and height < HEIGHT:
        level = [Node(digest([x.digest for x in level[k : k + FAN]]), tuple(level[k : k + FAN])) for k in range(0, len(level), FAN)]
        size, height = -(-size // FAN), height + 1
    return level[0], height


def with_leaf(node: Node, height: int, at: int, leaf: str) -> Node:
    """The version of a tree with another leaf at a place: copies of its ancestors, all else shared."""
    if not height:
        return Node(leaf)
    own, rest = divmod(at, FAN ** (height - 1))
    children = (*node.children[:own], with_leaf(node.children[own], height - 1, rest, leaf), *node.children[own + 1 :])
    return Node(digest([x.digest for x in children]), children)


def siblings(node: Node, height: int, at: int) -> list[tuple[str, str]]:
    """What stands left and right of a leaf and of each of its ancestors, from the leaf upwards."""
    out = []
    while height:
        height -= 1
        own, at = divmod(at, FAN**height)
        out.append(("".join(x.digest for x in node.children[:own]), "".join(x.digest for x in node.children[own + 1 :])))
        node = node.children[own]
    return out[::-1]


def fold(start: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        start = digest([left, start, right])
    return start


_NODES = "tree string, i long, size long, digest string"
_PATHS = "tree string, i long, size long, path array<struct<l:string,r:string>>, top string"


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("i")


def _tops(table: pa.Table) -> pa.Table:
    table = _in_order(table)
    i, size = table["i"][0].as_py(), table["size"][0].as_py()
    top, _ = build(table["digest"].to_pylist(), size)
    return pa.table({"tree": table["tree"][:1], "i": [i // FAN**HEIGHT], "size": [-(-size // FAN**HEIGHT)], "digest": [top.digest]})


def _paths(table: pa.Table) -> pa.Table:
    table = _in_order(table)
    size = table["size"][0].as_py()
    top, height = build(table["digest"].to_pylist(), size)
    paths = [[{"l": a, "r": b} for a, b in siblings(top, height, k)] for k in range(table.num_rows)]
    kind = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
    return pa.table({"tree": table["tree"], "i": table["i"], "size": table["size"], "path": pa.array(paths, kind), "top": pa.array([top.digest] * table.num_rows)})


def _block() -> Column:
    return F.floor(F.col("i") / FAN**HEIGHT)


def climb(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths of all nodes (tree, i, size, digest) to the roots of their trees, and these roots (tree, digest)."""
    rounds, kept = [], []
    while True:
        most = nodes.agg(F.max("size")).first()[0] or 0
        found = save(nodes.groupBy("tree", _block().alias("block")).applyInArrow(_paths, _PATHS), "merkle-paths")
        kept.append(found)
        rounds.append(found.select("tree", "i", "path"))
        tops = found.filter(F.col("i") % FAN**HEIGHT == 0).select("tree", _block().alias("i"), F.ceil(F.col("size") / FAN**HEIGHT).alias("size"), F.col("top").alias("digest"))
        if most <= FAN**HEIGHT:
            break
        nodes = tops
    whole = rounds[-1]
    for lower in rounds[-2::-1]:
        upper = whole.select("tree", F.col("i").alias("block"), F.col("path").alias("rest"))
        whole = lower.withColumn("block", _block()).join(upper, ["tree", "block"]).select("tree", "i", F.concat("path", "rest").alias("path"))
    out = save(whole, "merkle-whole"), save(tops.select("tree", "digest"), "merkle-roots")
    for t in kept:
        drop(t)
    return out


def _finish(leaves: pa.Table, above: pa.Table) -> pa.Table:
    """Proofs and versions of the leaves of a block, given the way from the block's top to the root."""
    leaves = _in_order(leaves)
    plain, other = leaves["digest"].to_pylist(), leaves["other"].to_pylist()
    top, height = build(plain, leaves["size"][0].as_py())
    upper = [(x["l"], x["r"]) for x in above["path"][0].as_py()]
    rest = [x for pair in upper for x in pair]
    subroot, root = above["subroot"][0].as_py(), above["root"][0].as_py()
    proofs, folded = [], []
    for k, changed in enumerate(other):
        own = [x for pair in siblings(top, height, k) for x in pair]
        proofs.append(digest(own + rest))
        version = top if changed == plain[k] else with_leaf(top, height, k, changed)
        folded.append(fold(version.digest, upper))
    n = leaves.num_rows
    return pa.table({"doc_id": leaves["doc_id"], "leaf": leaves["digest"], "subroot": pa.array([subroot] * n), "root": pa.array([root] * n), "proof_sha256": pa.array(proofs), "folded_root": pa.array(folded), "verified": pa.array([x == root for x in folded], pa.bool_())})


def leaf_digest(columns: dict[str, Column]) -> Column:
    """The digest of a row: each field as its length in bytes and its value, or a dash."""
    text = {k: c.cast("string") for k, c in columns.items()}
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text.values()]), 256)


def dataset_manifest(docs: DataFrame, tampered: Column | None = None, changed: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row.

    ``changed`` is the text that rows have where ``tampered`` is true; without both no row is.
    """
    rows = docs.select(*[F.col(f"`{c}`").cast("long" if c in ("doc_id", "n_chars") else "string").alias(c) for c in FIELDS])
    plain = {c: F.col(c) for c in FIELDS}
    other = F.when(tampered, leaf_digest(plain | {"text": changed})) if tampered is not None and changed is not None else F.lit(None)
    # A source's tree is named so that null stands first and no two sources share a name.
    tree = F.coalesce(F.concat(F.lit("="), "source"), F.lit(_ALL))
    leaves = rows.select("doc_id", tree.alias("tree"), leaf_digest(plain).alias("digest"), other.cast("string").alias("other"))
    leaves = ranked_in(save(leaves, "merkle-leaves"), ["tree"], ["doc_id", "digest"]).withColumnRenamed("i_of", "size")
    leaves = leaves.withColumn("block", _block())
    blocks = save(leaves.select("tree", "i", "size", "digest", "block").groupBy("tree", "block").applyInArrow(_tops, _NODES), "merkle-blocks")
    paths, subroots = climb(blocks)
    # Sources are the leaves of the last tree.
    order = ranked_in(subroots.withColumn("all", F.lit(_ALL)), ["all"], ["tree"], "k").select("tree", "digest", "k", "k_of")
    last, root = climb(order.select(F.lit(_ALL).alias("tree"), F.col("k").alias("i"), F.col("k_of").alias("size"), "digest"))
    over = order.join(last.select(F.col("i").alias("k"), F.col("path").alias("rest")), "k").crossJoin(F.broadcast(root.select(F.col("digest").alias("root"))))
    over = over.select("tree", F.col("digest").alias("subroot"), "root", "rest")
    above = paths.join(over, "tree").select("tree", F.col("i").alias("block"), F.concat("path", "rest").alias("path"), "subroot", "root")
    pairs = leaves.withColumn("other", F.coalesce("other", "digest")).groupBy("tree", "block").cogroup(save(above, "merkle-above").groupBy("tree", "block"))
    return pairs.applyInArrow(_finish, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def without_line_breaks(docs: DataFrame) -> DataFrame:
    """The manifest where every other row, by the checksum of its id, has lost the line breaks of its text."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return dataset_manifest(docs, hit, F.replace("text", F.lit("\n"), F.lit("")))
