"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.decontaminate import find_leaks
from granary.llm.embed_dedup import embedding_duplicates
from granary.llm.html_text import extract_main_text
from granary.llm.line_dedup import dedup_lines
from granary.llm.merkle import without_line_breaks
from granary.llm.near_dedup import near_duplicates
from granary.llm.packing import near_clusters, pack
from granary.llm.quality import quality_rules
from granary.llm.resample import importance_resample
from granary.llm.secrets import scan_secrets
from granary.llm.substring_dedup import remove_repeats
from granary.llm.token_counts import token_counts
from granary.llm.warc import archive_round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pack(docs, clusters=near_clusters(docs))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return scored.drop("text")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_line_breaks(_table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_html_extraction": op5_html_extraction,
    "op6_quality_rules": op6_quality_rules,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_warc_archive": op10_warc_archive,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_embedding_near_dedup": op13_embedding_near_dedup,
}

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {10 * g + 1}, 10) AS BIGINT) >> {35 - 5 * k}) & 31 AS INT) + 1, 1)" for g in range(4) for k in range(8))

def _field(x: str) -> str:
    return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _crc32(x: str) -> str:
    """CRC-32 bit by bit: the register, then each byte with the seven shifts that follow it."""
    bits = f"flatten(list_transform(range(0, strlen({x})), lambda k: [CAST('0x' || substr(hex({x}), CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {bits}), lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))))"


#: Levels of a tree of digests over rows (tree, i, cnt, dig), and what stands beside each node of a level.
_LEVELS = "SELECT tree, lvl + 1, i // 3, (cnt + 2) // 3, sha256(string_agg(dig, '' ORDER BY i)) FROM {0} WHERE cnt > 1 GROUP BY tree, lvl, i // 3, cnt"
_BESIDE = "SELECT tree, lvl, i, cnt, coalesce(string_agg(dig, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(dig, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {0} WINDOW w AS (PARTITION BY tree, lvl, i // 3 ORDER BY i)"

#: SQL over the same tables; the other operators are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_FOLD}), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        t AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
        g AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM t),
        l AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT doc_id AS id, doc_id AS root FROM t UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id),
        c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, component_id = doc_id AS kept FROM t JOIN c ON c.id = t.doc_id""",
    "op8_line_dedup": f"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        x AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
        k AS (SELECT *, translate(trim(line, {_SPACE}), {_FOLD}) AS key FROM x),
        h AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        m AS (SELECT k.*, h.keeper IS NOT NULL AND h.keeper <> doc_id AS gone FROM k LEFT JOIN h USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op10_warc_archive": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        f AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
    "op11_merkle_manifest": f"""
        WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf("text")} AS leaf, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS other FROM documents),
        o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY tree) AS cnt FROM d),
        n AS (SELECT tree, 0 AS lvl, i, cnt, leaf AS dig FROM o UNION ALL {_LEVELS.format("n")}),
        b AS MATERIALIZED ({_BESIDE.format("n")}),
        s AS MATERIALIZED (SELECT tree AS source, dig AS subroot, row_number() OVER (ORDER BY tree) - 1 AS k, count(*) OVER () AS cnt FROM n WHERE cnt = 1),
        m AS (SELECT '' AS tree, 0 AS lvl, k AS i, cnt, subroot AS dig FROM s UNION ALL {_LEVELS.format("m")}),
        c AS MATERIALIZED ({_BESIDE.format("m")}),
        f AS (SELECT doc_id, tree, 0 AS lvl, i, other AS dig, '' AS way FROM o UNION ALL SELECT f.doc_id, f.tree, f.lvl + 1, f.i // 3, sha256(b.l || f.dig || b.r), f.way || b.l || b.r FROM f JOIN b ON b.tree = f.tree AND b.lvl = f.lvl AND b.i = f.i WHERE b.cnt > 1),
        g AS (SELECT f.doc_id, s.k AS i, 0 AS lvl, f.dig, f.way FROM (SELECT *, max(lvl) OVER (PARTITION BY doc_id) AS top FROM f) f JOIN s ON s.source = f.tree WHERE f.lvl = f.top
              UNION ALL SELECT g.doc_id, g.i // 3, g.lvl + 1, sha256(c.l || g.dig || c.r), g.way || c.l || c.r FROM g JOIN c ON c.lvl = g.lvl AND c.i = g.i WHERE c.cnt > 1),
        e AS (SELECT * FROM (SELECT *, max(lvl) OVER (PARTITION BY doc_id) AS top FROM g) WHERE lvl = top)
        SELECT o.doc_id, o.leaf, s.subroot, r.dig AS root, sha256(e.way) AS proof_sha256, e.dig AS folded_root, e.dig = r.dig AS verified FROM o JOIN s ON s.source = o.tree JOIN e ON e.doc_id = o.doc_id CROSS JOIN (SELECT dig FROM m WHERE cnt = 1) r""",
    "op12_importance_resampling": f"""
        WITH a AS (SELECT doc_id, 0 AS side, text FROM documents UNION ALL SELECT NULL, 1, text FROM benchmark),
        w AS (SELECT doc_id, side, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_FOLD}), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM a),
        g AS MATERIALIZED (SELECT doc_id, side, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS x FROM w),
        b AS MATERIALIZED (SELECT x, {_crc32("x")} % 10000 AS bucket FROM (SELECT DISTINCT x FROM g)),
        n AS MATERIALIZED (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM g JOIN b USING (x) GROUP BY bucket),
        k AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (sum(s) OVER () + 10000) / (CAST(s + 1 AS DOUBLE) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM n),
        v AS (SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM g JOIN b USING (x) JOIN k USING (bucket) WHERE side = 0 GROUP BY doc_id),
        h AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN v USING (doc_id) WHERE side = 0),
        z AS (SELECT doc_id, n_words >= 20 AS may, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM h),
        r AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id) AS rank, count(*) FILTER (may) OVER () AS n FROM z)
        SELECT doc_id, n_features, weight, score, CASE WHEN may AND rank <= 5 * n // 100 THEN rank END AS rank FROM r""",
    "op13_embedding_near_dedup": """
        WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        u AS MATERIALIZED (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL),
        l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
        r AS (SELECT vec_id AS id, vec_id AS root FROM v UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.id),
        c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
        SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = v.vec_id) AS n_links, component_id, component_id = vec_id AS kept FROM v JOIN c ON c.id = v.vec_id""",
}
