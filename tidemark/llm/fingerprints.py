"""Bottom-k sketches of shingle hashes; DataFrame operations only.

A document's shingles are its runs of five white-space separated words (all its words, if fewer). Its sketch is the k
smallest of their 48-bit hashes, ascending. The sketch of a union is the k smallest of both sketches, so sketches of
parts merge exactly. Null, empty and blank texts have the empty sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.shared import documents, order_key, range_buckets

K, WORDS, BITS = 128, 5, 48
_BLANK = "[\\x20\\x09-\\x0D]+"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Array of the 48-bit hash of every shingle, repeats included."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), _BLANK), lambda w: w != "")
    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    return _let(
        hashes,
        lambda h: F.slice(
            F.transform(h, lambda x, i: F.shiftrightunsigned(F.xxhash64(x, *[F.get(h, i + j) for j in range(1, words)]), 64 - BITS)),
            F.lit(1),
            F.when(F.size(h) == 0, 0).otherwise(F.greatest(F.size(h) - (words - 1), F.lit(1))),
        ),
    )


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, words))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two documents (or parts)."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def _shared(a: Column, b: Column, union: Column) -> Column:
    return F.size(F.array_intersect(F.array_intersect(a, b), union))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; exact when both have at most k shingles together; 1 for two empty sketches."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(_let(merged(a, b, k), lambda u: _shared(a, b, u).cast("double") / F.greatest(F.size(u), F.lit(1))))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(float(2**BITS)) / F.element_at(a, -1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: resemblance times the union's count over a's, at most 1."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * distinct_count(merged(a, b, k), k) / distinct_count(a, k)))


def merge_by(df: DataFrame, keys: list[str], column: str, k: int = K, salts: int = 64) -> DataFrame:
    """One sketch for each group of rows. Hashes above the k-th smallest of a salted part never leave it, so a hot
    group sends at most salts x k hashes on."""
    part = W.partitionBy(*keys, "_salt").orderBy("_h")
    whole = W.partitionBy(*keys).orderBy("_h")
    each = df.select(*keys, F.explode(column).alias("_h")).withColumn("_salt", F.pmod(F.xxhash64("_h"), F.lit(salts)))
    each = each.distinct().withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= k)
    each = each.withColumn("_r", F.row_number().over(whole)).filter(F.col("_r") <= k)
    return each.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(column))


def encoded(a: Column) -> Column:
    """The sketch as text: base64 of its hashes, six bytes each."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), BITS // 4, "0")), "")))


def with_next(docs: DataFrame, rows_per_bucket: int = 1000) -> DataFrame:
    """Each document with the text and the sketch of the next one in order of doc_id; the first follows the last.

    Documents are dealt into id ranges by one shuffle. The first document of a range is also sent to the range before
    it, as a guard row, so that every range finds its last successor itself. Equal ids are ordered by text, null ids
    come first.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), order_key().alias("_key"))
    dealt, starts = range_buckets(slim, "_key", rows_per_bucket)
    last = len(starts) - 1
    is_start = F.col("_key").isin(starts) if starts else F.lit(False)
    before = F.when(F.col("bucket") > 0, F.col("bucket") - 1).otherwise(F.lit(max(last, 0)))
    homes = F.when(is_start, F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("guard")), F.struct(before.alias("b"), F.lit(1).alias("guard")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("guard")))
    )
    rows = dealt.withColumn("sketch", sketch(F.col("text"))).withColumn("home", F.explode(homes)).select("doc_id", "text", "_key", "sketch", F.col("home.b").alias("_b"), F.col("home.guard").alias("_guard"))
    order = W.partitionBy("_b").orderBy("_guard", "_key", "text")
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order))
    return rows.filter("_guard = 0").drop("_b", "_guard", "_key")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited form; see fingerprint_documents."""
    return fingerprint_documents(documents(spark, sf_dir))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row and of its edited text. A single document is its own successor. Equal texts have equal
    fingerprints, whatever their ids. Null texts are empty, null ids come first, rows of one id follow one another by text. Texts
    of any length give all their shingles. Other columns are not read. An empty table gives no rows."""
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = with_next(docs).withColumn("_edited", edited)
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), "sketch", "next_sketch", sketch(F.col("_edited")).alias("_es"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", encoded(F.col("sketch")).alias("fingerprint"), encoded(F.col("_es")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("_es")).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"), distinct_count(F.col("sketch")).alias("distinct_shingles"),
    )
