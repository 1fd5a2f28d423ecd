import re

import numpy as np
import pyarrow as pa

from granary.llm import kernels, near_dedup


def test_word_counts_equal_runs(monkeypatch):
    texts = ["", None, " ", "a", " a", "a ", "a b", "\tx\n\x0b\x0cy\r", "\u00e9\u00a0\u2003 z", "", "b", "a" * 40 + " " * 40, "q"]
    want = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(kernels.chunks, "__defaults__", (size,))
        assert kernels.word_counts(pa.array(texts)).tolist() == want
        assert kernels.word_counts(pa.array(["x y", *texts])[1:]).tolist() == want
    assert kernels.word_counts(pa.array([], pa.string())).tolist() == []


def test_rows_of_a_slice_have_their_own_lists():
    b = pa.record_batch({"value": [1, 2, 3], "sig": pa.array([[1], [2, -3], []], pa.list_(pa.int64()))})
    rows = list(near_dedup._rows([b.slice(1)]))
    assert [r["value"] for r in rows] == [2, 3] and [r["sig"].tolist() for r in rows] == [[2, -3], []]
    assert all(isinstance(r["sig"], np.ndarray) for r in rows)
