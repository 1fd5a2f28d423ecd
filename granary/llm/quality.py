"""Quality rules in DataFrame operations only: plain counts, and a hashed n-gram log-likelihood ratio.

Base counts per text: words, their code points, symbols, repeated lines, and words inside 8-word windows that occur
twice.  Then two multinomials over ``BUCKETS`` hashed word unigrams and bigrams are counted: one over all documents of
the corpus, one over trusted ones (labelled good; at most ``TRUSTED`` of them, those with the least hash of doc_id).
A text's score is the mean over its n-grams of ln(trusted share / corpus share) with additive smoothing, so length
plays no part, and every document whose score is below ``THRESHOLD`` is rejected.  The bucket weights are ``BUCKETS``
numbers whatever the corpus, so they come to the driver and enter the scan as one constant, rounded to six decimals.

Defined results: a null text has no words and fails; without trusted documents every weight is 0; rows are kept one
for one, whatever their ids; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
TRUSTED = 20_000
SMOOTHING = 1.0
THRESHOLD = -0.05
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"]
SYMBOLS = "#*$%&|<>"
SPACE = " \t\n\x0b\f\r"
WORD_GAP = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))


def _hashed(docs: DataFrame) -> DataFrame:
    """Adds the text without null, and the hashes of its words."""
    out = docs.withColumn("q_text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    return out.withColumn("q_words", F.transform(words_of(F.col("q_text")), lambda w: F.xxhash64(w)))


def _ngrams() -> Column:
    """Buckets of the unigrams and bigrams of q_words."""
    low = lambda h: h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    pair = lambda w, i: low(F.xxhash64(w, F.get("q_words", i + 1)))
    return F.concat(F.transform("q_words", low), F.transform(F.slice("q_words", 1, F.greatest(F.size("q_words") - 1, F.lit(0))), pair))


def trusted_ids(labels: DataFrame, bound: int = TRUSTED) -> DataFrame:
    """The documents the target is counted on: labelled good and not toxic, at most ``bound`` of them."""
    good = labels.filter("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("trusted_id")).distinct()
    return good.orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(bound)


def bucket_weights(docs: DataFrame, trusted: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """One row with the weights of all buckets as an array."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(trusted), F.col("doc_id") == F.col("trusted_id"), "left")
    grams = _hashed(rows).select(F.col("trusted_id").isNotNull().alias("t"), F.explode(_ngrams()).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("r"), F.count_if("t").alias("t"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0)
    table = every.agg(F.sum("r").alias("rs"), F.sum("t").alias("ts"), F.array_sort(F.collect_list(F.struct("bucket", "r", "t"))).alias("b"))
    share = lambda n, total: F.log((n + smoothing) / (total + smoothing * BUCKETS))
    weight = lambda x: F.when(F.col("ts") == 0, F.lit(0.0)).otherwise(share(x["t"], F.col("ts")) - share(x["r"], F.col("rs")))
    return table.select(F.transform("b", lambda x: F.round(weight(x), 6)).alias("weights"))


def _constant(weights: list[float]) -> Column:
    """An array constant: one string, cast once when the plan is optimised."""
    return F.split(F.lit(",".join(f"{w:.6f}" for w in weights)), ",").cast("array<double>")


def quality_rules(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, bound: int = TRUSTED) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed and kept, which replace columns so named."""
    names = [c for c in docs.columns if c not in RESULTS]
    docs = docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in names]).alias("rest"), "doc_id", "text")
    weights = _constant(bucket_weights(docs, trusted_ids(labels, bound)).first()["weights"])
    out = _hashed(docs)
    n = F.size("q_words")
    window = lambda i: F.xxhash64(F.slice("q_words", i + 1, 8))
    out = out.withColumn("q_windows", F.when(n >= 8, F.transform(F.sequence(F.lit(0), n - 8), window)).otherwise(F.array().cast("array<long>")))
    some = F.size(F.array_distinct("q_windows")) < F.size("q_windows")
    out = out.withColumn("q_sorted", F.when(some, F.array_sort(F.transform("q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = lambda x, j: (F.coalesce(F.get("q_sorted", j - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get("q_sorted", j + 1)["h"] == x["h"], F.lit(False)))
    out = out.withColumn("q_at", F.sort_array(F.transform(F.filter("q_sorted", twice), lambda x: x["i"])))
    covered = F.aggregate(F.transform("q_at", lambda p, j: F.least(F.lit(8), F.coalesce(F.get("q_at", j + 1) - p, F.lit(8)))), F.lit(0), lambda a, b: a + b)
    lines = F.filter(F.split("q_text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    out = out.withColumn("q_lines", lines)
    grams = F.size("q_words") + F.greatest(F.size("q_words") - 1, F.lit(0))
    total = F.aggregate(_ngrams(), F.lit(0.0), lambda a, b: a + F.get(weights, b))
    chars = lambda dropped: (F.length("q_text") - F.length(F.translate("q_text", dropped, ""))).cast("long")
    # Not deterministic to the optimiser: a filter on the results stays above this step.  Pushed below, it would carry
    # the word arrays into the functions over their elements and make them anew for each.
    zero = F.monotonically_increasing_id() * F.lit(0)
    out = out.select(
        "rest", n.cast("long").alias("n_words"), (F.length("q_text").cast("long") - chars(SPACE)).alias("word_chars"), chars(SYMBOLS).alias("n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        (F.when(n > 0, total / grams).otherwise(F.lit(0.0)) + zero).alias("score"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
    return out.select(*[F.col("rest")[c].alias(c) for c in names], *RESULTS)
