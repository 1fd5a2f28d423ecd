"""Importance resampling towards a target distribution, drawn without replacement by a distributed radix sort.

Features are runs of 1 to ``RUN`` words, hashed to ``BUCKETS`` buckets by CRC-32.  One scan counts the buckets of the
corpus and of the target; the smoothed log-ratios are an array of gains, a fixed ``BUCKETS`` numbers, that a second scan
sums over each text's features.  With Gumbel noise from the id, the highest scores are a draw without replacement with
probabilities in proportion to the exponentials of the weights.

The draw sorts all candidates by (score descending, id ascending) with least-significant-digit radix passes.  Rows have
places in blocks of bounded length.  A pass counts each digit in each block, sums the counts over smaller digits and over
earlier blocks, and so gives every row the place it goes to: that offset plus its rank among equal digits in its
block (a stable counting sort).  A row's block is then its place divided by the length of a block; after the last digit
the place is the final rank.  Digits follow from the range of the keys, so the number of passes is its logarithm.

CRC-32 is linear: the checksum of a run of words comes from the checksums of its words and their lengths, so a text's
features are array operations, a few numbers per word.  Very long texts go through in slices of words.

Defined results: a null or empty text, or one without words, has no features and weight 0; a row without doc_id has null
score and rank and is not among the candidates; rows of one doc_id and score take neighbouring ranks in the order in which
they are stored; empty tables on either side count nothing.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.scratch import drop, save
from granary.llm.kernels import chunks, utf8

BUCKETS = 10_000
RUN = 3
LEAST_WORDS, PER_CENT = 20, 5
#: Words that one slice of array operations works on.
SLICE = 1 << 17
#: Bits of a digit; rows of a block at least, and blocks at most.
DIGIT, BLOCK, BLOCKS = 12, 4096, 1 << 16

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ONES = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    """Checksum register after one zero byte, by the register's low byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_TABLE = _byte_table()


def _apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A linear map of registers, given as its values by each of four bytes."""
    return tables[0][c & 255] ^ tables[1][(c >> 8) & 255] ^ tables[2][(c >> 16) & 255] ^ tables[3][c >> 24]


#: Words up to this length have tables of their own for what their bytes do to a register.
SHORT = 64


def _shift_tables() -> np.ndarray:
    """For 0 to SHORT + 1 zero bytes: what becomes of a register, by each of its four bytes."""
    one = np.arange(256, dtype=np.uint32)
    out = [np.stack([one << np.uint32(8 * k) for k in range(4)])]
    for _ in range(SHORT + 1):
        out.append(_TABLE[out[-1] & 255] ^ (out[-1] >> np.uint32(8)))
    return np.stack(out)


_SHIFT = _shift_tables()


def _doublings() -> list[np.ndarray]:
    """The same for 1, 2, 4, ... zero bytes."""
    out = [_SHIFT[1]]
    for _ in range(40):
        out.append(_apply(out[-1], out[-1]))
    return out


_DOUBLE = _doublings()


def shift(c: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Registers after so many zero bytes."""
    few = np.minimum(by, SHORT + 1)
    out = _SHIFT[few, 0, c & 255] ^ _SHIFT[few, 1, (c >> 8) & 255] ^ _SHIFT[few, 2, (c >> 16) & 255] ^ _SHIFT[few, 3, c >> 24]
    long = np.flatnonzero(by > SHORT + 1)
    if len(long):
        x, n = c[long], by[long]
        for k in range(int(n.max()).bit_length()):
            x = np.where((n >> k) & 1, _apply(_DOUBLE[k], x), x)
        out[long] = x
    return out


def registers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The register that each word leaves behind, from zero; byte by byte over all words at once, the longest first."""
    n = ends - starts
    out = np.zeros(len(n), np.uint32)
    short = np.flatnonzero(n <= SHORT)
    order = short[np.argsort(-n[short], kind="stable")]
    lengths, first, c = n[order], starts[order], np.zeros(len(order), np.uint32)
    for k in range(int(lengths[0]) if len(lengths) else 0):
        m = int(np.searchsorted(-lengths, -k, "left"))  # words longer than k
        c[:m] = _TABLE[(c[:m] ^ data[first[:m] + k]) & 255] ^ (c[:m] >> np.uint32(8))
    out[order] = c
    for k in np.flatnonzero(n > SHORT):
        out[k] = zlib.crc32(data[starts[k] : ends[k]], 0xFFFFFFFF) ^ 0xFFFFFFFF
    return out


_BLANK = _TABLE[32]


def run_buckets(own: np.ndarray, n: np.ndarray, text: np.ndarray, fresh: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of the runs that end in a word from place ``fresh`` on, from the words' registers, lengths and texts."""
    with_blank = shift(np.full(len(own), _BLANK, np.uint32), n) ^ own
    run = shift(np.full(len(own), _ONES, np.uint32), n) ^ own
    for k in range(RUN):
        if k:
            run = shift(run[:-1], n[k:] + 1) ^ with_blank[k:]
        keep = np.arange(len(run)) + k >= fresh
        keep &= text[k:] == text[: len(text) - k]
        yield text[k:][keep], ((run[keep] ^ _ONES) % np.uint32(BUCKETS)).astype(np.int64)
        if len(run) < 2:
            return


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """(first row, rows, words of each row, (row, bucket) arrays) for chunks of the texts of a column."""
    data, offsets = utf8(column)
    for a, b in chunks(offsets):
        own, at = _FOLD[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        inside = _WORD[own]
        edge = np.zeros(len(own) + 1, bool)
        edge[at] = True
        starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1])) if len(own) else np.zeros(0, np.int64)
        ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1 if len(own) else starts
        text = np.searchsorted(at, starts, "right") - 1
        words = np.bincount(text, minlength=b - a)[: b - a]

        def slices(own=own, starts=starts, ends=ends, text=text) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for x in range(0, len(starts), SLICE):
                first, last = max(0, x - RUN + 1), min(len(starts), x + SLICE)
                yield from run_buckets(registers(own, starts[first:last], ends[first:last]), ends[first:last] - starts[first:last], text[first:last], x - first)

        yield a, b - a, words, slices()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(side, bucket, n) of all texts of a task: two arrays, whatever the number of texts."""
    n = np.zeros((2, BUCKETS), np.int64)
    for b in batches:
        side = b.column(0).to_numpy(zero_copy_only=False)
        for first, _, _, found in features(b.column(1)):
            for row, bucket in found:
                if len(row):
                    n += np.bincount(bucket + BUCKETS * side[first + row], minlength=2 * BUCKETS).reshape(2, BUCKETS)
    side, bucket = np.nonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(side.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(n[side, bucket])], ["side", "bucket", "n"])


def bucket_gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """1000 times the log-ratio of the smoothed shares of each bucket, rounded down."""
    sides = docs.select(F.lit(0).alias("side"), F.col("text").cast("string").alias("text")).union(target.select(F.lit(1), F.col("text").cast("string")))
    n = sides.mapInArrow(_count, "side int, bucket int, n long").groupBy("bucket").agg(*[F.coalesce(F.sum(F.when(F.col("side") == k, F.col("n"))), F.lit(0)).alias(x) for k, x in ((0, "s"), (1, "t"))])
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(n, "bucket", "left").fillna(0)
    rows = sorted(every.collect())  # BUCKETS rows
    s, t = (np.array([r[k] for r in rows], np.float64) for k in ("s", "t"))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def importance_weights(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_features, weight) per row: the sum of its features' gains."""
    gains = bucket_gains(docs, target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, n, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for first, rows, own, found in features(b.column(1)):
                words[first : first + rows] = own
                for row, bucket in found:
                    n[first : first + rows] += np.bincount(row, minlength=rows)
                    sums = np.concatenate([[0], np.cumsum(gains[bucket])])
                    edge = np.searchsorted(row, np.arange(rows + 1))
                    weight[first : first + rows] += sums[edge[1:]] - sums[edge[:-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def radix_ranks(rows: DataFrame, keys: list[str], name: str = "rank", *, digit: int = DIGIT, block: int = BLOCK) -> DataFrame:
    """``rows`` with their ranks from 1 by ``keys`` (not null, not negative, the first most significant); ties stay in stored order."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), *[F.max(k).alias(k) for k in keys]).first()
    size = max(block, -(-found["n"] // BLOCKS))
    now = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_block", F.shiftright("_at", 33))
    before = None
    passes = [(k, low) for k in reversed(keys) for low in range(0, max(1, (found[k] or 0).bit_length()), digit)]
    for k, low in passes:
        dealt = now.withColumn("_digit", F.shiftright(k, low).bitwiseAND((1 << digit) - 1))
        counts = dealt.groupBy("_digit", "_block").agg(F.count(F.lit(1)).alias("_n"))
        earlier = counts.withColumn("_earlier", F.sum("_n").over(Window.partitionBy("_digit").orderBy("_block")) - F.col("_n"))
        total = counts.groupBy("_digit").agg(F.sum("_n").alias("_total"))  # at most 2 ** digit rows
        less = total.select("_digit", (F.sum("_total").over(Window.orderBy("_digit")) - F.col("_total")).alias("_less"))
        offset = earlier.join(F.broadcast(less), "_digit").select("_digit", "_block", (F.col("_earlier") + F.col("_less")).alias("_offset"))
        ranked = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_digit", "_block").orderBy("_at")) - 1)
        moved = ranked.join(offset, ["_digit", "_block"]).withColumn("_at", F.col("_offset") + F.col("_own"))
        now = save(moved.withColumn("_block", F.floor(F.col("_at") / size)).select(*rows.columns, "_at", "_block"), "radix")
        drop(before)
        before = now
    return now.withColumn(name, F.col("_at") + 1).select(*rows.columns, name)


def importance_resample(docs: DataFrame, target: DataFrame, *, least_words: int = LEAST_WORDS, per_cent: int = PER_CENT, seed: int = 42) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) per row; of the candidates ``per_cent`` have a rank."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = save(importance_weights(docs, target).withColumn("score", F.col("weight") + noise), "scores")
    may = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    ends = scored.filter(may).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("high"), F.min("doc_id").alias("low")).first()
    drawn = ends["n"] * per_cent // 100
    keyed = scored.filter(may).select("doc_id", "n_features", "weight", "score", (F.lit(ends["high"] or 0) - F.col("score")).alias("k1"), (F.col("doc_id") - F.lit(ends["low"] or 0)).alias("k2"))
    ranked = radix_ranks(keyed, ["k1", "k2"]).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.filter(~may).withColumn("rank", F.lit(None).cast("long"))
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*names).unionByName(rest.select(*names))
