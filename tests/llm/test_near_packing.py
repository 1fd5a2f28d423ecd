from collections import Counter

from granary.llm.queries import QUERIES


def test_near_copies_never_share_a_bin(spark, tmp_path):
    rows = []
    for k in range(60):
        words = [f"w{k // 6}x{j}" for j in range(100)]
        words[k % 6 * 15] = f"changed{k}"
        rows.append((k, " ".join(words), f"source{k}"))
    rows += [(100, None, "a"), (101, "", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op3_best_fit_packing"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    held = Counter((r.bin_id, r.doc_id // 6) for r in got if r.doc_id < 60)
    assert max(held.values()) == 1
    assert len({r.cluster for r in got if r.doc_id < 60}) == 10
    assert len({r.bin_id for r in got if r.doc_id >= 100}) == 2
