"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, weighted-shingle proof.

Word shingles of ``WIDTH`` words (fewer for shorter items) are hashed.  A window as long as a benchmark item, wherever
it starts, gets a fingerprint if its shingles can reach ``threshold`` with any item at all: its weight and the weight that
benchmark shingles have in it are known exactly for every start, repeats counted once, from one pass of sums over the
document per length.  The items that a window may be like come from its SimHash of ``BITS`` bits: fingerprints are cut in
blocks of 16 bits, whose reaches, each plus one, sum to ``RADIUS`` + 1, so an item's fingerprint within ``RADIUS`` bits
is within reach in one block (pigeonhole).  A block is looked up in its table at all values within reach; below
``TABLES`` items all fingerprints are compared, which then costs less.  Candidates within the radius are verified
exactly: weighted Jaccard similarity of the window's and the item's shingles of at least ``threshold``.  A
shingle's weight is 1 / the number of items that have it, and 1 outside the benchmark.  Fingerprints take the roots of
the weights: then the cosine of two sets of similarity t is at least 2t / (1 + t), 0.89 at 0.8, whatever the weights.
Fingerprints slide: a window's is the difference of two running sums, less what it has twice.  An item's candidates are
verified from the highest bound down, as far as they can be more alike than the best.

The numbers of items are counted once over the whole benchmark.  Items come to the tasks in blocks of ``ITEMS``, with
all lengths of items and the weights under 1; a larger benchmark means more passes over the documents, with the same
results.  A worker builds the index of a block once.  Documents are one scan, without any shuffle but that of the few leaks.
What is held per task grows with the benchmark only, not with the documents.

Defined results: null or empty texts on either side never match; items that repeat are each reported; the leak of a
document by an item is its most similar window, the first of equals; a null doc_id is reported as null.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.kernels import chunks, mix, shingle_hashes, utf8, word_hashes

WIDTH = 5
THRESHOLD = 0.8
BITS = 256
RADIUS = 76
BLOCKS = BITS // 16
#: Bits that a block of a fingerprint within the radius may differ by, in one block at least.
REACH = [(RADIUS + 1 + b) // BLOCKS - 1 for b in range(BLOCKS)]
#: Items in one pass over the documents: some tens of MB in each task.
ITEMS = 20_000
_BLOOM = 1 << 22
LEAK = "doc_id long, item_id long, similarity double, start_word long, n_words long"


_VALUES = np.arange(1 << 16, dtype=np.uint16)
_BALLS = {t: _VALUES[np.bitwise_count(_VALUES) <= t] for t in set(REACH)}
#: Fewer items than this are compared with one by one, which is faster than all values within reach of the tables.
TABLES = 8192
#: Comparisons of fingerprints at once; starts of windows whose sums are kept at once.
SLAB, STARTS = 1 << 18, 2048
_SALTS = mix(np.arange(1, BITS // 64 + 1, dtype=np.uint64))


def _signed(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per shingle the root of its weight in each of ``BITS`` places, with the sign of its bit."""
    salted = mix((shingles[:, None] ^ _SALTS).ravel()).astype("<u8")
    bits = np.unpackbits(salted.view(np.uint8).reshape(-1, BITS // 8), axis=1)
    return np.sqrt(weights)[:, None] * (2.0 * bits - 1.0)


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 1e-9, axis=-1).view("<u8")


def simhash(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The SimHash of weighted shingle hashes in words of 64 bits; its vector has the roots of the weights."""
    return _packed(_signed(shingles, weights).sum(axis=0))


def _fingerprints(grams: np.ndarray, weight: np.ndarray, before: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The SimHashes of windows (start, shingles) from sums that slide over the text; repeats count once."""
    if not len(start):
        return np.zeros((0, BITS // 64), "<u8")
    low = int(start.min())
    high = int((start + size).max())
    signed = _signed(grams[low:high], weight[low:high])
    sums = np.concatenate([np.zeros((1, BITS)), np.cumsum(signed, axis=0)])
    again = np.flatnonzero(before[low:high] >= low) + low
    out = np.empty((len(start), BITS // 64), "<u8")
    for m in np.unique(size):
        own = np.flatnonzero(size == m)
        found = sums[start[own] + m - low] - sums[start[own] - low]
        repeats = again[again - before[again] < m]
        if len(repeats):
            # What a window from a to before(p) has of place p it has already.
            twice = np.zeros((high - low + 1, BITS))
            np.add.at(twice, np.maximum(repeats - m + 1, low) - low, signed[repeats - low])
            np.subtract.at(twice, before[repeats] + 1 - low, signed[repeats - low])
            found -= np.cumsum(twice, axis=0)[start[own] - low]
        out[own] = _packed(found)
    return out


class Common:
    """Of the whole benchmark: shingles that several items have, with the number of these, and all lengths of items."""

    def __init__(self, shingles: np.ndarray, items: np.ndarray, lengths: list[int]) -> None:
        order = np.argsort(shingles)
        self.shingles, self.weight, self.lengths = shingles[order], 1.0 / items[order], sorted(lengths)

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.ones(len(shingles))
        where = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        return np.where(self.shingles[where] == shingles, self.weight[where], 1.0)


def _sums(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(values)])


def _bound(weight: np.ndarray, held: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The similarity that a window of some weight can have at most with an item, holding so much of the benchmark's."""
    common = np.minimum(held, total)
    return common / np.maximum(weight + total - common, 1e-300)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class Index:
    """Benchmark items: shingles by hash with the items that have them, fingerprints by block."""

    def __init__(self, items: list[tuple[int, str]], common: Common, width: int = WIDTH, threshold: float = THRESHOLD) -> None:
        self.width, self.threshold, self.weights, self.ids = width, threshold, common.weights, []
        self.n_words, self.sets = [], []
        data, offsets = utf8(pa.array([t for _, t in items], pa.string()))
        words, at = word_hashes(data, offsets)
        for k, (i, _) in enumerate(items):
            own = words[at[k] : at[k + 1]]
            if len(own):
                self.ids.append(i)
                self.n_words.append(len(own))
                self.sets.append(np.unique(shingle_hashes(own, width)))
        flat = np.concatenate([np.zeros(0, np.uint64), *self.sets])
        order = np.argsort(flat, kind="stable")
        self.keys, self.first = np.unique(flat[order], return_index=True)
        self.first = np.append(self.first, len(flat))
        self.owners = np.repeat(np.arange(len(self.sets)), [len(x) for x in self.sets])[order]
        self.total = np.array([self.weights(x).sum() for x in self.sets])
        # Lengths of windows by words in a shingle; an item shorter than a shingle is met by windows of its length.
        self.lengths = {w: [n for n in common.lengths if n == w or n > w == width] for w in {min(width, n) for n in self.n_words}}
        self.bloom = np.zeros(_BLOOM, bool)
        self.bloom[(self.keys & np.uint64(_BLOOM - 1)).astype(np.int64)] = True
        self.widths = sorted({min(width, n) for n in self.n_words})
        self.prints = np.array([simhash(s, self.weights(s)) for s in self.sets], "<u8").reshape(-1, BITS // 64)
        # Per block: items in the order of its values, and where each value begins.
        self.tables = [] if len(self.prints) < TABLES else [(np.argsort(x, kind="stable"), np.searchsorted(np.sort(x), np.arange((1 << 16) + 1)).astype(np.int32)) for x in self.prints.view("<u2").T]

    def candidates(self, fingerprint: np.ndarray) -> np.ndarray:
        """Items that a block table finds within reach; none within the radius is missing."""
        found = np.zeros(len(self.prints), bool)
        for (order, first), reach, value in zip(self.tables, REACH, fingerprint.view("<u2"), strict=True):
            values = (_BALLS[reach] ^ value).astype(np.int64)
            times = first[values + 1] - first[values]
            some = np.flatnonzero(times)
            start, times = first[values[some]], times[some]
            found[order[np.arange(times.sum()) + np.repeat(start - np.cumsum(times) + times, times)]] = True
        return np.flatnonzero(found)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (fingerprint, item) within the radius."""
        rows, items = [], []
        few = max(1, SLAB // max(1, len(self.prints)))
        for at in range(0, len(prints), few if not self.tables else 1):
            if self.tables:
                some = self.candidates(prints[at])
                own = some[np.bitwise_count(self.prints[some] ^ prints[at]).sum(axis=1) <= RADIUS]
                row = np.full(len(own), at)
            else:
                row, own = np.nonzero(np.bitwise_count(prints[at : at + few, None] ^ self.prints).sum(axis=2) <= RADIUS)
                row = row + at
            rows.append(row)
            items.append(own)
        return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *items])

    def hits(self, grams: np.ndarray) -> np.ndarray:
        some = np.flatnonzero(self.bloom[(grams & np.uint64(_BLOOM - 1)).astype(np.int64)])
        if not len(some):
            return some
        where = np.minimum(np.searchsorted(self.keys, grams[some]), len(self.keys) - 1)
        return some[self.keys[where] == grams[some]]

    def _possible(self, grams: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items of which the text has shingles enough, and the places of their shingles."""
        key = np.searchsorted(self.keys, grams[places])
        once = np.unique(key)
        times = self.first[once + 1] - self.first[once]
        shift = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        owner, of = self.owners[np.repeat(self.first[once], times) + shift], np.repeat(once, times)
        has = np.bincount(owner, self.weights(self.keys[of]), len(self.total))
        some = has >= self.threshold * self.total - 1e-9
        return np.flatnonzero(some), places[np.isin(key, of[some[owner]])]

    def _windows(self, n_words: int, width: int, grams: np.ndarray, weight: np.ndarray, before: np.ndarray, held: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, ...]:
        """(weight, held weight, start, words) of the windows that may be like an item of one of the totals."""
        at, out = np.arange(len(grams)), []
        starts_w, starts_h = _sums(weight), _sums(held)
        least, most = self.threshold * totals[0] - 1e-9, totals[-1] / self.threshold + 1e-9
        for n in {min(n, n_words) for n in self.lengths[width]}:
            m = n - width + 1
            if m < least:
                continue
            # A shingle counts in the windows that begin behind its last place before and hold this one.
            first = np.maximum(np.maximum(before + 1, at - m + 1), 0)
            stop = len(grams) - m + 1
            w = np.cumsum(np.bincount(first, weight, len(grams)))[:stop] - starts_w[:stop]
            h = np.cumsum(np.bincount(first, held, len(grams)))[:stop] - starts_h[:stop]
            start = np.flatnonzero((h >= np.maximum(self.threshold * w - 1e-9, least)) & (w <= most))
            if len(start):
                w, h = w[start], h[start]
                # The most similar total is one of the two around what is held.
                k = np.searchsorted(totals, h)
                best = np.zeros(len(start))
                for t in (totals[np.minimum(k, len(totals) - 1)], totals[np.maximum(k - 1, 0)]):
                    best = np.maximum(best, _bound(w, h, t))
                keep = best >= self.threshold - 1e-9
                out.append((w[keep], h[keep], start[keep], np.full(int(keep.sum()), n)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def leaks(self, words: np.ndarray, hits: dict[int, np.ndarray]) -> Iterator[tuple[int, float, int, int]]:
        """(item, similarity, start, words) of a document given the places of its benchmark shingles by their words."""
        for width, places in hits.items():
            whole = shingle_hashes(words, width)
            some, places = self._possible(whole, places)
            if not len(some):
                continue
            # Beyond the longest window around the shingles that count there is nothing to find.
            reach = max(self.lengths[width])
            low, high = max(0, int(places.min()) - reach), min(len(whole), int(places.max()) + reach)
            grams, n_words = whole[low:high], high - low + width - 1
            weight = self.weights(grams)
            held = np.zeros(len(grams))
            held[places - low] = weight[places - low]
            order = np.argsort(grams, kind="stable")
            before = np.full(len(grams), -1)
            again = np.flatnonzero(grams[order[1:]] == grams[order[:-1]])
            before[order[again + 1]] = order[again]
            wanted = np.zeros(len(self.total), bool)
            wanted[some] = True
            w, h, start, n = self._windows(n_words, width, grams, weight, before, held, np.sort(self.total[some]))
            pairs = [np.zeros((4, 0))]
            for low_start in np.unique(start // STARTS) * STARTS:
                own = np.flatnonzero((start >= low_start) & (start < low_start + STARTS))
                row, item = self.near(_fingerprints(grams, weight, before, start[own], n[own] - width + 1))
                row, item = own[row[wanted[item]]], item[wanted[item]]
                pairs.append(np.stack([_bound(w[row], h[row], self.total[item]), item, start[row], n[row]]))
            bound, *rest = np.concatenate(pairs, axis=1)
            item, first, words_in = (x.astype(np.int64) for x in rest)
            best: dict[int, tuple[float, int, int]] = {}
            for x in np.lexsort((-bound, item)).tolist():
                k, a, m = int(item[x]), int(first[x]), int(words_in[x]) - width + 1
                least = best.get(k, (-self.threshold + 1e-12, -1, 0))
                if bound[x] >= -least[0] - 1e-9:  # none behind the best can be more alike than its bound
                    inside = np.flatnonzero(before[a : a + m] < a) + a
                    mine, heavy = grams[inside], weight[inside]
                    common = heavy[_among(mine, self.sets[k])].sum()
                    found = (-float(common / (heavy.sum() + self.total[k] - common)), low + a, int(words_in[x]))
                    if found < least:
                        best[k] = found
            yield from ((k, -b[0], b[1], b[2]) for k, b in sorted(best.items()))

    def scan(self, column: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, item, similarity, start, words) over the texts of a column."""
        if not self.ids:
            return
        data, offsets = utf8(column)
        for a, b in chunks(offsets):
            words, at = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            by_text: dict[int, dict[int, np.ndarray]] = {}
            for width in self.widths:
                if len(words) < width:
                    continue
                grams = shingle_hashes(words, width)
                where = self.hits(grams)
                text = np.searchsorted(at, where, "right") - 1
                inside = where + width <= at[text + 1]
                where, text = where[inside], text[inside]
                edge = np.flatnonzero(np.diff(text, prepend=-1, append=-1)) if len(text) else text
                for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    by_text.setdefault(int(text[x]), {})[width] = where[x:y] - at[text[x]]
            for k, hits in sorted(by_text.items()):
                for item, similarity, start, n in self.leaks(words[at[k] : at[k + 1]], hits):
                    yield a + k, self.ids[item], similarity, start, n


def _blocks(benchmark: DataFrame, items: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about ``items`` rows."""
    rows = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    parts = max(1, -(-rows.count() // items))
    for k in range(parts):
        yield [(r.item_id, r.text) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()]


def _common(benchmark: DataFrame, width: int) -> Common:
    """What blocks need to know of the whole benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(0))
            words, at = word_hashes(data, offsets)
            sets = [np.unique(shingle_hashes(words[x:y], width)) for x, y in zip(at[:-1], at[1:], strict=True)]
            n = np.diff(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)), pa.array(np.repeat(n, [len(x) for x in sets]), pa.int64())], ["shingle", "words"])

    rows = benchmark.filter("text IS NOT NULL").select(F.col("text").cast("string").alias("text")).mapInArrow(run, "shingle long, words long")
    lengths = [r.words for r in rows.select("words").distinct().collect()]
    shared = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").toArrow()
    return Common(shared["shingle"].to_numpy().view(np.uint64), shared["n"].to_numpy(), lengths)


_indexes: dict[str, Index] = {}


def _index(name: str, shared: Broadcast, width: int, threshold: float) -> Index:
    """The index of a block of items, built once in each Python worker."""
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = Index(*shared.value, width, threshold)
    return _indexes[name]


def _shared(docs: DataFrame, benchmark: DataFrame, width: int, items: int) -> Iterator[tuple[str, Broadcast]]:
    """Blocks of items, each sent to an executor once."""
    common = _common(benchmark, width)
    for block in _blocks(benchmark, items):
        yield uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((block, common))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, threshold: float = THRESHOLD, items: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): one row per document and item that it holds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for name, shared in _shared(docs, benchmark, width, items):

        def run(batches: Iterator[pa.RecordBatch], name=name, shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared, width, threshold)
            for b in batches:
                found = list(index.scan(b.column(1)))
                ids = b.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                cols = [pa.array([f[k] for f in found], t) for k, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
                yield pa.RecordBatch.from_arrays([ids, *cols], ["doc_id", "item_id", "similarity", "start_word", "n_words"])

        part = rows.mapInArrow(run, LEAK)
        out = part if out is None else out.unionByName(part)
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, threshold: float = THRESHOLD, items: int = ITEMS) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows pass through the scan, nothing is joined."""
    names = docs.columns
    for name, shared in _shared(docs, benchmark, width, items):

        def run(batches: Iterator[pa.RecordBatch], name=name, shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(name, shared, width, threshold)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[f[0] for f in index.scan(b.column(names.index("text")))]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
