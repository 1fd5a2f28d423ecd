"""Conflict-constrained best-fit packing of documents into bins of ``CAPACITY`` words.

Each bin carries its residual capacity and two bitmaps: the sources and the duplicate clusters it holds.  No bin gets
two pieces of one source or of one cluster.  Pieces come largest first.  Bins are kept in order of residual; the search
starts at the tightest bin that fits and goes on to its successors until one is compatible, else a new bin opens.

Documents are dealt by a hash of doc_id into shards of about ``SHARD`` documents, whose number follows the table, and
each shard is packed by itself: a hot source or cluster spreads over all shards, and only ids, sizes and the two
groups travel, never texts.  A document over the capacity is cut into full pieces, each a bin of its own, and a rest.

Defined results: a null text, or one without words, has size 0 and takes a place in a bin; a null source or cluster
conflicts with nothing; ties go by doc_id and then cluster; repeated rows are one cluster, so they never share a bin;
extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.kernels import word_counts
from granary.llm.near_dedup import near_duplicates

CAPACITY = 2048
SHARD = 4096
PACKED = "doc_id long, piece long, start_word long, n_words long, bin_id string, source string, cluster long"
SPACE = " \t\n\x0b\f\r"


class Packer:
    """Bins of one shard."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (residual, bin), ascending
        self.sources: list[int] = []  # bitmaps by bin
        self.clusters: list[int] = []
        self.source_bit: dict = {None: 0}
        self.cluster_bit: dict = {None: 0}

    def place(self, size: int, source, cluster) -> int:
        """The bin of a piece: the tightest that fits and has neither its source nor its cluster."""
        s = self.source_bit.setdefault(source, 1 << len(self.source_bit))
        c = self.cluster_bit.setdefault(cluster, 1 << len(self.cluster_bit))
        at = bisect_left(self.order, (size, -1))
        while at < len(self.order) and (self.sources[b := self.order[at][1]] & s or self.clusters[b] & c):
            at += 1
        if at < len(self.order):
            residual, b = self.order.pop(at)
        else:
            residual, b = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[b] |= s
        self.clusters[b] |= c
        insort(self.order, (residual - size, b))
        return b


def _pack(capacity: int):
    """Rows (shard, rest, doc_id, source, cluster, size) sorted by shard and falling rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, packer = None, Packer(capacity)
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for now, rest, doc, source, cluster, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now != shard:
                    shard, packer = now, Packer(capacity)
                full = (size - rest) // capacity
                pieces = [(k, k * capacity, capacity) for k in range(full)]
                if rest or not full:
                    pieces.append((full, full * capacity, rest))
                for k, start, n in pieces:
                    row = (doc, k, start, n, f"{now}-{packer.place(n, source, cluster)}", source, cluster)
                    for col, v in zip(out, row, strict=True):
                        col.append(v)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "piece", "start_word", "n_words", "bin_id", "source", "cluster"])

    return run


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, source, cluster) with the number of words in the text's place."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(word_counts(b.column(1))), b.column(2), b.column(3)], ["doc_id", "size", "source", "cluster"])


def near_clusters(docs: DataFrame) -> DataFrame:
    """(doc_id, cluster): near copies, 0.8 alike in five-word shingles, are a cluster; texts without words have none."""
    found = near_duplicates(docs.select("doc_id", "text"), width=5, per_cent=80).filter("n_shingles > 0 AND doc_id IS NOT NULL")
    return found.groupBy("doc_id").agg(F.min("component_id").alias("cluster"))


def pack(docs: DataFrame, *, capacity: int = CAPACITY, shard: int = SHARD, cluster: str | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """(doc_id, piece, start_word, n_words, bin_id, source, cluster): one row per piece.

    ``cluster`` names a column of ``docs`` with the duplicate cluster; without it, texts that agree but for case and
    white space at the ends are a cluster.  ``clusters`` has (doc_id, cluster), one row per doc_id, which goes first.
    """
    text = F.btrim(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(SPACE))
    group = F.col(cluster).cast("long") if cluster else F.xxhash64(F.lower(text))
    shards = max(1, -(-docs.count() // shard))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), group.alias("cluster"))
    rows = rows.mapInArrow(_sized, "doc_id long, size long, source string, cluster long")
    if clusters is not None:  # sizes travel to this join, not texts
        found = clusters.select(F.col("doc_id").alias("d"), F.col("cluster").cast("long").alias("c"))
        rows = rows.join(found, F.col("doc_id") == F.col("d"), "left").select("doc_id", "size", "source", F.coalesce("c", "cluster").alias("cluster"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).withColumn("rest", F.col("size") % capacity)
    rows = rows.select("shard", "rest", "doc_id", "source", "cluster", "size").repartition("shard")
    # Full pieces fill a bin each, so the order that counts is that of the rests.
    rows = rows.sortWithinPartitions("shard", F.col("rest").desc(), "doc_id", "cluster", "size", "source")
    return rows.mapInArrow(_pack(capacity), PACKED)
