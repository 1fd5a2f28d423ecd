"""Removal of repeated byte strings by prefix-free parsing.

Parse.  A rolling hash of ``TRIGGER`` bytes cuts every text into phrases.  Neighbouring phrases overlap by ``length - 1``
bytes, so each string of ``length`` bytes starts in exactly one phrase, and no suffix of a phrase that is as long is a
prefix of another one.  The parse is the list of (phrase, document), a phrase being named by 128 bits of BLAKE2b.
Sorted, it is the suffix array of the parse, cut at one phrase since a phrase already spans ``length`` bytes: the
least document of an interval owns the phrase, and in any other document all strings that start in it are repeats.

Dictionary.  What is left are phrases in the document that owns them, each once: the dictionary.  Its suffixes are
sorted by their bytes down to ``length`` (``equal_suffixes``); an interval of suffixes that agree so far, with the owners
that the parse gives to their phrases, is corpus order, and its least document keeps the string.

Distribution.  A suffix array of everything would ship ``length`` bytes for each byte.  Each string chooses its least
hashed ``GRAM``-byte gram (leftmost of equals), equal strings choose equal grams, and runs of strings with one gram
travel as one context.  The suffixes are sorted gram by gram, only under grams that two documents have in the dictionary.

Hot grams and phrases.  Every task settles what it can see itself before a shuffle: occurrences of a phrase behind the
least document of the task, contexts that the task has for a lesser document, and grams that it has ``HOT`` times or
more.  These go to their document at once, and one representative stands for them, so a key has at most one row from
each task, or for a gram under ``HOT`` in all tasks fewer than that.  Strings under a hot gram travel one by one, dealt by all
their bytes, so documents with one line between different neighbours spread out.

The texts are shuffled once by document; the three joins below use that exchange.

Defined results: a null text is empty; matches never cross documents; rows with one doc_id are one document, each row
with its own positions; rows with a null doc_id neither match nor change; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.kernels import chunks, mix, powers, utf8

TRIGGER = 12
#: A phrase has about this many bytes; a power of two.
PHRASE = 128
GRAM = 18
#: A gram that one task finds so often in ``SEEN`` bytes is hot; in less text, by proportion, but ``LEAST_HOT`` at least.
HOT, LEAST_HOT = 128, 8
#: Bytes of text over which a task gathers what it settles itself.
SEEN = 1 << 24
#: Bits of a gram's hash that travel: a chance agreement costs a needless comparison, never a wrong result.
_GRAM_BITS = np.uint64(0xFFFFFFFFFFFF0000)
_RAW = mix(np.arange(256).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x51ED2701))
#: A code is the start of a gram, with a bit for a hot one; what a task has settled itself is below 0.
_HOT_BIT = 1 << 40
_START = _HOT_BIT - 1


def _sums(data: np.ndarray, table: np.ndarray = _RAW) -> np.ndarray:
    """Prefix sums from which the hash of any span follows."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def _span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


def _gram_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    n = len(sums) - width
    return mix((sums[width:] - sums[:n]) * powers(len(sums))[1][:n]) if n > 0 else np.zeros(0, np.uint64)


def phrases(sums: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the phrases of the texts, and ends with the bytes behind them."""
    n = int(offsets[-1])
    first = np.zeros(n + 1, bool)
    cut = _gram_hashes(sums, TRIGGER)
    first[: len(cut)] = (cut & np.uint64(PHRASE - 1)) == 0
    text = np.searchsorted(offsets, np.flatnonzero(first), "right")
    where = np.flatnonzero(first)
    first[where[where + TRIGGER > offsets[np.minimum(text, len(offsets) - 1)]]] = False  # a trigger lies in one text
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(first[:n])
    ends = offsets[np.searchsorted(offsets, starts, "right")]
    return starts, np.minimum(np.append(starts[1:], n) + length - 1, ends)


def anchors(sums: np.ndarray, offsets: np.ndarray, length: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings of ``length`` bytes that choose one gram: its position, first and last start of the strings.

    Only strings whose start is ``wanted``, and inside one text.
    """
    none = (np.zeros(0, np.int64),) * 3
    width = length - GRAM + 1
    grams = _gram_hashes(sums, GRAM)
    if len(grams) < width:
        return none
    best = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if width > span:
        best = np.minimum(best[: len(best) - (width - span)], best[width - span :])
    # Strings that would cross the end of a text choose nothing.
    inside = np.zeros(len(best) + 1, np.int32)
    lo, hi = offsets[:-1], np.maximum(offsets[1:] - length + 1, offsets[:-1])
    np.add.at(inside, np.minimum(lo, len(best)), 1)
    np.add.at(inside, np.minimum(hi, len(best)), -1)
    take = np.cumsum(inside[:-1]) > 0
    if wanted is not None:
        take &= wanted[: len(best)]
    starts = np.flatnonzero(take)
    if not len(starts):
        return none
    chosen = (best[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(chosen), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
    return chosen[new], starts[new], starts[np.append(new[1:], True)]


def _dealt(doc: np.ndarray) -> np.ndarray:
    """A key for rows that only pass through an exchange."""
    return mix(doc.astype(np.int64).view(np.uint64) + np.uint64(0x77)).view(np.int64)


def _frame(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names.split())


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


# -- the parse ------------------------------------------------------------------------------------------------------
#: Columns that vary stand side by side behind those that repeat, which compresses well.
_PARSE = "doc long, row long, k1 long, k2 long, start long"


def _parse(length: int):
    """(doc, row, k1, k2, start) of every phrase; below 0 for those the task has in a lesser document."""

    def settle(k: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((doc, k[:, 1], k[:, 0]))
        k1, k2 = k[:, 0], k[:, 1]
        at = _groups(k1[order], k2[order])
        known = np.zeros(len(doc), bool)  # rows stay in the order of the texts, which compresses well
        known[order] = doc[order] > np.repeat(doc[order][at], np.diff(np.append(at, len(doc))))
        return _frame("doc row k1 k2 start", doc, row, np.where(known, _dealt(doc), k1), np.where(known, 0, k2), np.where(known, -1 - start, start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            data, offsets = utf8(b.column(2))
            ids, rows = b.column(0).to_numpy(), b.column(1).to_numpy()
            for x, y in chunks(offsets):
                own, at = data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x]
                if not len(own):
                    continue
                s, e = phrases(_sums(own), at, length)
                s, e = s[e - s >= length], e[e - s >= length]
                raw = own.tobytes()
                k = np.frombuffer(b"".join([hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(s.tolist(), e.tolist(), strict=True)]), np.int64).reshape(-1, 2)
                text = np.searchsorted(at, s, "right") - 1
                held.append((k, ids[x + text], rows[x + text], s - at[text]))
                size += len(own)
                if size >= SEEN:
                    yield settle(*map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield settle(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _outside_owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the parse sorted by phrase and document: occurrences of phrases outside the document that owns them."""
    key, owner = None, 0
    for b in batches:
        doc, row, k1, k2, start = (c.to_numpy() for c in b.columns)
        known = start < 0
        out = [(doc[known], row[known], -1 - start[known])]
        k1, k2, doc, row, start = (c[~known] for c in (k1, k2, doc, row, start))
        if len(doc):
            at = _groups(k1, k2)
            low = doc[at]
            if key == (k1[0], k2[0]):
                low[0] = owner
            key, owner = (k1[-1], k2[-1]), low[-1]
            later = doc > np.repeat(low, np.diff(np.append(at, len(doc))))
            out.append((doc[later], row[later], start[later]))
        yield _frame("doc row start", *map(np.concatenate, zip(*out, strict=True)))


# -- texts on their way ---------------------------------------------------------------------------------------------
def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the one exchange that carries them."""
    press = zstandard.ZstdCompressor(level=6)
    for b in batches:
        data, offsets = utf8(b.column(2))
        yield _frame("doc_id row z", b.column(0), b.column(1), pa.array([press.compress(data[s:e]) for s, e in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary()))


def _lists(column: pa.Array, k: int) -> np.ndarray:
    return column[k].values.to_numpy(zero_copy_only=False) if column[k].is_valid else np.zeros(0, np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Chunks of texts in the order of their documents: (documents, rows, bytes, offsets, their place in the batch, batch)."""
    press = zstandard.ZstdDecompressor()
    for b in batches:
        ids = b.column(0)
        some = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
        ids, rows = ids.fill_null(0).to_numpy(), b.column(1).to_numpy()
        some = some[np.argsort(ids[some], kind="stable")]
        texts: list[bytes] = []
        place: list[int] = []
        size = 0
        for k in [*some.tolist(), -1]:
            if texts and (k < 0 or size >= 1 << 20):
                yield ids[place], rows[place], np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), place, b
                texts, place, size = [], [], 0
            if k >= 0:
                texts.append(press.decompress(b.column(2)[k].as_py()))
                place.append(k)
                size += len(texts[-1])


def _unsettled(sums: np.ndarray, offsets: np.ndarray, length: int, covered: pa.Array, place: list[int]) -> np.ndarray:
    """For every byte whether its phrase is in the dictionary with this document as owner."""
    starts = phrases(sums, offsets, length)[0]
    left = np.ones(len(starts), bool)
    left[np.searchsorted(starts, np.concatenate([_lists(covered, k) + o for k, o in zip(place, offsets, strict=False)]))] = False
    return np.repeat(left, np.diff(np.append(starts, offsets[-1])))


# -- the dictionary: grams that two documents have -------------------------------------------------------------------
_GRAMS = "doc long, row long, deal long, code long"


def _grams(length: int, hot: int):
    """(doc, row, deal, code) of the chosen grams of owned phrases, dealt by hash; see ``_HOT_BIT`` for codes."""

    def settle(size: int, h: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((doc, h))
        at = _groups(h[order])
        n = np.diff(np.append(at, len(h)))
        least, most = doc[order[at]], doc[order[at + n - 1]]
        often, other = np.zeros((2, len(h)), bool)  # rows stay in the order of the texts, which compresses well
        often[order] = np.repeat((n >= min(hot, max(LEAST_HOT, hot * size // SEEN))) & (least != most), n)
        other[:] = often
        other[order[at]] = False
        return _frame("doc row deal code", doc, row, np.where(other, _dealt(doc), h), np.where(often, -1 - start - np.where(other, _HOT_BIT, 0), start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for ids, rows, own, at, place, b in _texts(batches):
            if not len(own):
                continue
            sums = _sums(own)
            pos = anchors(sums, at, length, _unsettled(sums, at, length, b.column(3), place))[0]
            text = np.searchsorted(at, pos, "right") - 1
            h = (_span_hash(sums, pos, pos + GRAM) & _GRAM_BITS).view(np.int64)
            held.append((h, ids[text], rows[text], pos - at[text]))
            size += len(own)
            if size >= SEEN:
                yield settle(size, *map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if held:
            yield settle(size, *map(np.concatenate, zip(*held, strict=True)))

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by gram, hot ones first, and document: (doc, row, code) of grams that two documents have.

    State between batches is one gram with its least document, and that document's rows while they are alone.
    """
    none = np.zeros(0, np.int64)
    key, least, shared, hot, held = None, 0, False, False, (none, none, none)
    for b in batches:
        doc, row, deal, code = (c.to_numpy() for c in b.columns)
        known = code < -_HOT_BIT
        out = [(doc[known], row[known], -1 - code[known])]
        deal, doc, row, code = (c[~known] for c in (deal, doc, row, code))
        if len(deal):
            at = _groups(deal)
            n = np.diff(np.append(at, len(deal)))
            low, warm = doc[at].copy(), code[at] < 0
            both = warm | (np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at))
            if goes_on := key == deal[0]:
                both[0] |= shared or bool((doc[: n[0]] != least).any())
                warm[0] |= hot
                low[0] = least
                if both[0]:
                    out.append(held)
            if not goes_on or both[0]:
                held = (none, none, none)
            take = np.repeat(both, n)
            start = np.where(code < 0, -1 - code, code) | np.where(np.repeat(warm, n), _HOT_BIT, 0)
            out.append((doc[take], row[take], start[take]))
            key, least, shared, hot = deal[-1], low[-1], bool(both[-1]), bool(warm[-1])
            if not shared:
                held = tuple(np.concatenate([a, c[at[-1] :]]) for a, c in zip(held if goes_on and len(at) == 1 else (none,) * 3, (doc, row, start), strict=True))  # type: ignore[assignment]
        yield _frame("doc row code", *map(np.concatenate, zip(*out, strict=True)))


# -- the dictionary: its suffixes -------------------------------------------------------------------------------------
_CONTEXT = "deal long, doc long, row long, start long, n long, around binary, more binary"


def _spans_of(doc: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Spans joined where they follow or overlap each other in this order."""
    if not len(doc):
        return []
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (start[1:] > end[:-1]) | (start[1:] < start[:-1])
    last = np.append(new[1:], True)
    return list(zip(doc[new].tolist(), row[new].tolist(), start[new].tolist(), end[last].tolist(), strict=True))


def _once(around: list[bytes], text: list[int], some: list[int]) -> tuple[list[int], dict[int, list[int]]]:
    """Of some contexts those that are the first of their bytes in a text, and by these the later ones."""
    heads, again, mine, last = [], {}, {}, -1  # type: ignore[var-annotated]
    for k in some:
        if text[k] != last:
            mine, last = {}, text[k]
        if (j := mine.setdefault(around[k], k)) == k:
            heads.append(k)
        else:
            again.setdefault(j, []).append(k)
    return heads, again


def _contexts(length: int):
    """(deal, doc, row, start, n, around, more): bytes ``around`` a shared gram that strings outside covered phrases chose.

    ``start`` is where they begin, ``more`` where else in the text.  Strings under a hot gram are rows of their own.
    What the task has in a lesser document is settled: a span of n bytes, without its bytes.
    """
    names = "deal doc row start n around more"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        size, batch = 0, None
        for ids, rows, own, at, place, b in _texts(batches):
            if batch is not b and size >= SEEN:  # documents are in order within a batch only
                seen, size = {}, 0
            batch = b
            wanted = [_lists(b.column(4), k) for k in place]
            codes = np.concatenate([(w & _START) + o for w, o in zip(wanted, at, strict=False)])
            if not len(codes):
                continue
            size += len(own)
            sums = _sums(own)
            pos, first, last = anchors(sums, at, length, _unsettled(sums, at, length, b.column(3), place))
            order = np.argsort(codes)
            where = np.minimum(np.searchsorted(codes[order], pos), len(codes) - 1)
            take = codes[order][where] == pos
            hot = (np.concatenate(wanted)[order][where] & _HOT_BIT > 0)[take]
            pos, first, last = pos[take], first[take], last[take]
            # A run under a hot gram becomes runs of one string.
            n = np.where(hot, last - first + 1, 1)
            shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pos, hot = np.repeat(pos, n), np.repeat(hot, n)
            first, last = np.repeat(first, n) + shift, np.where(hot, np.repeat(first, n) + shift, np.repeat(last, n))
            text = np.searchsorted(at, first, "right") - 1
            doc, row, end = ids[text], rows[text], last + length
            deal = np.where(hot, _span_hash(sums, first, end), _span_hash(sums, pos, pos + GRAM) & _GRAM_BITS).view(np.int64)
            raw = own.tobytes()
            around = [raw[s:e] for s, e in zip(first.tolist(), end.tolist(), strict=True)]
            known = np.array([seen.setdefault(x, d) < d for x, d in zip(around, doc.tolist(), strict=True)], bool)
            start = first - at[text]
            spans = _spans_of(doc[known], row[known], start[known], start[known] + (end - first)[known])
            if spans:
                d, r, s, e = (np.array(c, np.int64) for c in zip(*spans, strict=True))
                yield _frame(names, _dealt(d), d, r, s, e - s, pa.nulls(len(d), pa.binary()), pa.nulls(len(d), pa.binary()))
            heads, again = _once(around, text.tolist(), np.flatnonzero(~known).tolist())
            more = [start[again[k]].tobytes() if k in again else None for k in heads] if again else pa.nulls(len(heads), pa.binary())
            yield _frame(names, deal[heads], doc[heads], row[heads], start[heads], (end - first)[heads], pa.array([around[k] for k in heads], pa.binary()), more)

    return run


def equal_suffixes(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Intervals of the suffix array that agree in ``depth`` bytes: members in order, and where each interval starts.

    Suffixes are sorted by eight bytes at a time; those alone in their interval need no more.
    """
    some, name = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    eight = np.arange(8)
    for d in [*range(0, depth - 8, 8), depth - 8]:
        value = data[(starts[some] + d)[:, None] + eight].view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((value, name))
        value, name, some = value[order], name[order], some[order]
        new = np.ones(len(some), bool)
        new[1:] = (name[1:] != name[:-1]) | (value[1:] != value[:-1])
        alone = new & np.append(new[1:], True)
        name = np.cumsum(new)[~alone]
        some = some[~alone]
        if not len(some):
            break
    return some, _groups(name) if len(some) else some


def _sorted_suffixes(length: int, group: int = 20_000):
    """Of contexts sorted by key: the spans (doc, row, start, end) of strings that a smaller document has."""

    def settle(doc: list, row: list, begin: list, around: list, more: list) -> list[tuple[int, int, int, int]]:
        size = np.array([len(x) for x in around])
        off = np.concatenate([[0], np.cumsum(size)])
        count = size - length + 1
        owner = np.repeat(np.arange(len(around)), count)
        shift = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        some, at = equal_suffixes(np.frombuffer(b"".join(around), np.uint8), off[owner] + shift, length)
        if not len(some):
            return []
        mine = np.array(doc)[owner[some]]
        low = np.repeat(np.minimum.reduceat(mine, at), np.diff(np.append(at, len(some))))
        hit = np.sort(some[mine > low])
        out = []
        for k, _, s, e in _spans_of(owner[hit], owner[hit], shift[hit], shift[hit] + length):
            out.append((doc[k], row[k], begin[k] + s, begin[k] + e))
            if more[k] is not None:
                out += [(doc[k], row[k], b + s, b + e) for b in np.frombuffer(more[k], np.int64).tolist()]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[], [], [], [], []]
        key = None
        for b in batches:
            known = b.filter(b.column(5).is_null())
            s = known.column(3).to_numpy()
            out = list(zip(known.column(1).to_pylist(), known.column(2).to_pylist(), s.tolist(), (s + known.column(4).to_numpy()).tolist(), strict=True))
            left = b.filter(b.column(5).is_valid())
            for deal, *values in zip(*(left.column(k).to_pylist() for k in (0, 1, 2, 3, 5, 6)), strict=True):
                if deal != key:
                    if len(rows[0]) >= group:
                        out += settle(*rows)
                        rows = [[], [], [], [], []]
                    key = deal
                for r, v in zip(rows, values, strict=True):
                    r.append(v)
            yield _spans(out)
        if rows[0]:
            yield _spans(settle(*rows))

    return run


def _spans(out: list) -> pa.RecordBatch:
    return _frame("doc row start end", *(pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([],) * 4)))


def _remove(length: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for b in batches:
            cols: list[list] = [[], [], [], []]
            left = []
            for k, z in enumerate(b.column(2).to_pylist()):
                own = np.frombuffer(press.decompress(z), np.uint8)
                step = np.zeros(len(own) + 1, np.int32)
                covered = _lists(b.column(3), k)
                if len(covered):
                    s, e = phrases(_sums(own), np.array([0, len(own)]), length)
                    at = np.searchsorted(s, covered)
                    np.add.at(step, s[at], 1)
                    np.add.at(step, e[at], -1)
                np.add.at(step, _lists(b.column(4), k), 1)
                np.add.at(step, _lists(b.column(5), k), -1)
                gone = np.cumsum(step[:-1]) > 0
                kept = own[~gone].tobytes()
                cols[0].append(len(own))
                cols[1].append(int(gone.sum()))
                cols[2].append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(own) else 0)
                cols[3].append(hashlib.sha256(kept).hexdigest())
                left.append(kept)
            arrays = [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if texts:
                arrays.append(pa.array(left, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def remove_repeats(docs: DataFrame, *, length: int = 50, hot: int = HOT, texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row, and with ``texts`` the kept bytes themselves."""
    if length < GRAM + 8:
        raise ValueError(f"strings of {GRAM + 8} bytes at least")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)).alias("row"), text.alias("text"))
    parse = rows.filter("doc_id IS NOT NULL").mapInArrow(_parse(length), _PARSE)
    outside = parse.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "doc").mapInArrow(_outside_owner, "doc long, row long, start long")
    by_text = lambda df, *values: df.groupBy("doc", "row").agg(*(F.collect_list(v).alias(v) for v in values))

    def beside(left, right, *values: str) -> DataFrame:
        on = (left["doc_id"] == right["doc"]) & (left["row"] == right["r"])
        return left.join(right, on, "left").select(*left.columns, *values)

    # Joined thrice in form: the exchange of the texts is the same in all branches, so Spark reuses it.
    covered = by_text(outside, "start").select("doc", F.col("row").alias("r"), F.array_distinct("start").alias("covered"))
    parsed = beside(rows.mapInArrow(_zipped, "doc_id long, row long, z binary"), covered, "covered")
    grams = parsed.mapInArrow(_grams(length, hot), _GRAMS)
    shared = grams.repartition("deal").sortWithinPartitions("deal", F.col("code") >= 0, "doc").mapInArrow(_shared, "doc long, row long, code long")
    marked = beside(parsed, by_text(shared, "code").select("doc", F.col("row").alias("r"), "code"), "code")
    contexts = marked.mapInArrow(_contexts(length), _CONTEXT)
    spans = contexts.repartition("deal").sortWithinPartitions("deal").mapInArrow(_sorted_suffixes(length), "doc long, row long, start long, end long")
    every = beside(parsed, by_text(spans, "start", "end").select("doc", F.col("row").alias("r"), "start", "end"), "start", "end")
    return every.mapInArrow(_remove(length, texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)
