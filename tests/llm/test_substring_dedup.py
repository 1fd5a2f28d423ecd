import hashlib
import random

import numpy as np
import pytest

from granary.llm.substring_dedup import _sums, equal_suffixes, phrases, remove_repeats

SCHEMA = "doc_id long, text string"


def brute(rows, length=50):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - length + 1):
            w = raw[k : k + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


def test_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rng = random.Random(3)
    pool = rows[0][1] + rows[7][1]
    for k in range(60):  # shared passages of lengths around the limit, embedded anywhere
        n = rng.choice([48, 49, 50, 51, 60, 130, 400])
        at = rng.randrange(len(pool) - n)
        rows.append((5000 - k, f"own{k} " * rng.randrange(4) + pool[at : at + n] + f" tail{k}é" * rng.randrange(3)))
    assert got(remove_repeats(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize("text", ["a" * 300, "ab" * 200, "x" * 49, "é" * 40])
def test_periodic_texts(spark, text):
    rows = [(1, text), (2, text), (3, text[:120] + "!" + text[:70]), (4, text)]
    assert got(remove_repeats(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_a_passage_twice_in_one_document(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    rows = []
    for k in range(40):
        p = word(rng.randrange(50, 75))
        around = word(40)
        rows += [(10 * k, word(90) + p + word(90)), (10 * k + 1, (around + p + around) * 2 + word(20) + around + p + around)]
    assert got(remove_repeats(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_nulls_empty_and_repeated_rows(spark):
    t = "the quick brown fox jumps over the lazy dog and then it sleeps for a very long time"
    rows = [(1, None), (2, ""), (3, t), (3, t), (4, t + t)]
    assert got(remove_repeats(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    extra = spark.createDataFrame([(None, t, 1), (1, t, 2)], "doc_id long, text string, h long")
    assert sorted((r.doc_id or 0, r.n_removed) for r in remove_repeats(extra).collect()) == [(0, 0), (1, 0)]
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_strings_of_an_owned_phrase_between_covered_ones(spark):
    """All bytes of M lie in phrases of Z1 and Z2, but the strings that start in [a, b) are first in M; C repeats them."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows = []
    while len(rows) < 160:
        m = word(400)
        raw = np.frombuffer(m.encode(), np.uint8)
        s = phrases(_sums(raw), np.array([0, len(raw)]), 50)[0].tolist()
        for a, b in zip(s[1:], s[2:], strict=False):
            if 60 < a < 300 and 12 <= b - a <= 49:
                i = len(rows)
                rows += [(i, m[: a + 49]), (i + 1, m[b:]), (i + 2, m), (i + 3, word(30) + m[a + 1 : b + 49] + word(30))]
                break
    assert got(remove_repeats(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_two_texts_under_one_id(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    p, q = word(600), word(500)
    rows = [(1, word(30) + p), (2, q + word(9)), (3, word(700) + p), (3, word(10) + q + word(90) + p), (3, word(50)), (4, p + q)]
    assert got(remove_repeats(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize("hot,parts", [(2, 1), (2, 7), (8, 3), (64, 4)])
def test_a_line_that_most_documents_share(spark, hot, parts):
    """Between different neighbours, and in copies; keys that a task finds ``hot`` times go another way."""
    rng = random.Random(hot)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    line, long_line, copy = word(64), word(420), word(300)
    rows = [(i, word(rng.randrange(90)) + rng.choice([line, long_line, line[:49], line + long_line]) + word(rng.randrange(90))) for i in range(150)]
    rows += [(200 + i, copy if i % 2 else copy + word(20)) for i in range(60)] + [(300, line * 30), (301, "a" * 700), (302, "a" * 400), (303, "a" * 400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    assert got(remove_repeats(df, hot=hot)) == brute(rows)


def test_equal_suffixes_is_a_suffix_array_cut_at_a_depth():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    starts = np.arange(2900)
    for depth in (9, 12, 16, 50):
        some, at = equal_suffixes(data, starts, depth)
        text = data.tobytes()
        runs = [[text[s : s + depth] for s in x.tolist()] for x in np.split(some, at[1:])] if len(some) else []
        assert all(len(set(r)) == 1 and len(r) > 1 for r in runs)
        heads = [r[0] for r in runs]
        assert heads == sorted(set(heads))
        every = [text[s : s + depth] for s in starts.tolist()]
        assert sum(map(len, runs)) == sum(every.count(h) for h in heads)
        assert {w for w in every if every.count(w) > 1} == set(heads)
