"""Secret scan: fixed patterns, and sliding-window entropy over candidate strings with an allow list.

Base kinds (leftmost, not overlapping within a kind): ``assign``, ``access``, ``hex``.  The entropy method looks at
every maximal run of ``[A-Za-z0-9+/_=-]`` of at least ``WINDOW`` characters.  A window of that length slides over the
run; counts per character and the sum of c*log2(c) are changed by one step in and one step out, so each position
costs constant time.  A window counts as random when it has a letter and a digit and its Shannon entropy reaches the
limit of its character class (hex, one-case letters with digits, mixed); windows of letters alone or digits alone are left
out, since words and numbers written together reach any limit that keys of one kind do.  Random windows that touch make
one span, reported as ``entropy`` unless it overlaps a base span.  The allow list suppresses by part: a window that
touches a part of the run, between ``/`` or ``=``, in which an allowed pattern is found, isn't random.

Defined results: a null text is empty; rows are kept one for one; spans are in code points, end exclusive; a run
found twice is reported twice; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.kernels import chunks, utf8

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: What makes the text worth the first pattern: a cheap test of the folded text.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits a character that a window of the class must reach; a window of 20 can't pass log2(20) = 4.32.
LIMITS = {"hex": 3.0, "one case": 3.6, "mixed": 3.8}
ALLOWED = tuple(
    re.compile(p)
    for p in (
        r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9a-fA-F])",  # UUID
        r"EXAMPLE|example|placeholder|changeme|xxxxxxxx|XXXXXXXX",
        r"0123456789|abcdefghijkl|ABCDEFGHIJKL",
    )
)
_XLOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 2)]
_TOKEN = np.zeros(256, bool)
_TOKEN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True


def random_spans(run: str, allowed=ALLOWED, limits=LIMITS, window: int = WINDOW) -> list[tuple[int, int]]:
    """Spans of a candidate run made of windows at or over the entropy limit of their class."""
    if len(run) < window:
        return []
    parts = []  # suppressed ones, in order
    for a, b in sorted(m.span() for p in allowed for m in p.finditer(run)):
        a, b = max(run.rfind("/", 0, a), run.rfind("=", 0, a)) + 1, min(x if x >= 0 else len(run) for x in (run.find("/", b), run.find("=", b)))
        if not parts or parts[-1][1] < a:
            parts.append((a, b))
    at = 0
    counts: dict[str, int] = {}
    digits = upper = lower = beyond = 0  # per class: digits, capitals, small letters, and letters past f
    total, out = 0.0, []
    xlog = _XLOG if window == WINDOW else [0.0] + [c * math.log2(c) for c in range(1, window + 2)]
    for i, c in enumerate(run):
        for ch, step in ((c, 1), (run[i - window], -1)) if i >= window else ((c, 1),):
            n = counts.get(ch, 0)
            total += xlog[n + step] - xlog[n]
            counts[ch] = n + step
            if ch.isdigit():
                digits += step
            elif ch.isalpha():
                beyond += step * (ch.lower() > "f")
                upper += step * ch.isupper()
                lower += step * ch.islower()
            else:
                beyond += step
        while at < len(parts) and parts[at][1] <= i - window + 1:
            at += 1
        if i >= window - 1 and digits and upper + lower and not (at < len(parts) and parts[at][0] <= i):
            kind = "hex" if not beyond and not (upper and lower) else "mixed" if upper and lower else "one case"
            if math.log2(window) - total / window >= limits[kind]:
                start = i - window + 1
                if out and out[-1][1] >= start:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((start, i + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, in no order."""
    folded = text.lower()
    out = []
    if any(k in folded for k in KEYWORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return out


def scan(text: str, long_run: bool = True, allowed=ALLOWED) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans of a text, by start and then kind; ``long_run``: it has a run of 16 token characters."""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = base_spans(text)
    more: list[tuple[int, int, str]] = []
    if long_run:
        base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
        ends, reach = sorted((s, e) for s, e, _ in base), 0
        at = 0  # base spans that start before the end of the window span, and how far they reach
        for m in RUN.finditer(text):
            for a, b in random_spans(m[0], allowed):
                a, b = a + m.start(), b + m.start()
                while at < len(ends) and ends[at][0] < b:
                    reach = max(reach, ends[at][1])
                    at += 1
                if reach <= a:
                    more.append((a, b, "entropy"))
    return sorted(base, key=order), sorted(base + more, key=order)


def _told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _long_runs(column: pa.Array, least: int = 16) -> np.ndarray:
    """For every row whether its text has a run of ``least`` token characters."""
    data, offsets = utf8(column)
    out = np.zeros(len(offsets) - 1, bool)
    for a, b in chunks(offsets):
        inside = np.zeros(offsets[b] - offsets[a] + 2, np.int8)
        inside[1:-1] = _TOKEN[data[offsets[a] : offsets[b]]]
        step = np.diff(inside)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        # A run over the end of a text only makes a text worth a look that isn't.
        for s, e in zip(starts[ends - starts >= least], ends[ends - starts >= least], strict=True):
            first = np.searchsorted(offsets, s + offsets[a], "right") - 1
            last = np.searchsorted(offsets, e - 1 + offsets[a], "right") - 1
            out[first : last + 1] = True
    return out


def _scan_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[], [], [], [], []]
        for text, worth in zip(b.column(1).to_pylist(), _long_runs(b.column(1)), strict=True):
            base, every = scan(text or "", bool(worth))
            for col, kind in zip(cols, KINDS[:3], strict=False):
                col.append(sum(s[2] == kind for s in base))
            cols[3].append(hashlib.sha256(_told(base).encode()).hexdigest())
            cols[4].append(_told(every))
        types = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) per row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan_all, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
