"""Bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A fingerprint is the k smallest distinct 64-bit hashes of a text's five-word shingles, in
ascending order. Two fingerprints give resemblance, containment and the distinct shingle
counts of their texts; fingerprints of parts merge into that of the whole.

Words are runs of characters other than white space, in lower case. A text with one to four
words has one shingle, all its words; a null, empty or blank text has none. Likeness of two
fingerprints without shingles is 1, of one without and one with is 0. Rows that repeat an id
are ordered among themselves by the hash of their text; a null id comes first. Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_or_least, shuffle_partitions, text_or_empty

WORDS, K = 5, 128


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def word_hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """The hash of every run of ``words`` words, repeats included."""

    def of(w: Column) -> Column:
        n = F.size(w)
        runs = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(words))))
        return F.when(n >= words, runs).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return let(word_hashes(text), of)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    return smallest(shingle_hashes(text, words), k)


def smallest(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def likeness(a: Column, b: Column, k: int = K) -> Column:
    """Estimated resemblance (Jaccard similarity) of the texts behind two sketches."""
    union = smallest(F.concat(a, b), k)
    share = let(union, lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.greatest(F.size(u), F.lit(1)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(share)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    kth = F.element_at(a, -1).cast("double") / F.lit(2.0**64) + 0.5
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    j = likeness(a, b, k)
    both = j / (1 + j) * (distinct_count(a, k) + distinct_count(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def merged(parts: DataFrame, key: str, column: str = "sketch", k: int = K, fan_in: int = 4096) -> DataFrame:
    """The sketch of each key's parts together. Two levels, so that no task gathers all parts of one key."""
    first = parts.groupBy(key, F.pmod(F.monotonically_increasing_id(), F.lit(fan_in)).alias("_part"))
    gather = smallest(F.flatten(F.collect_list(column)), k).alias(column)
    return first.agg(gather).groupBy(key).agg(gather)


def as_text(a: Column) -> Column:
    """The hashes as base64 of their 8 bytes each, highest first."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def _bucket(at: Column, splits: list[int]) -> Column:
    """How many splitters are at or below ``at``: one array of every 256th, then one of 256."""
    count = lambda of: F.size(F.filter(of, lambda s: s <= at))
    runs = [splits[i : i + 256] for i in range(0, len(splits), 256)]
    if len(runs) <= 1:
        return count(F.array(*map(F.lit, splits)).cast("array<bigint>"))
    run = F.greatest(count(F.array(*(F.lit(r[0]) for r in runs))) - 1, F.lit(0))
    return run * 256 + count(F.get(F.array(*(F.array(*map(F.lit, r)) for r in runs)), run))


def with_next(docs: DataFrame, rows_per_bucket: int = 4096, most_buckets: int = 65536) -> DataFrame:
    """doc_id, text, sketch, and next_text, next_sketch of the document that follows in ascending order, the first after the last.

    Documents are dealt into buckets of consecutive ids by sampled quantiles; the first
    document of each bucket is also sent to the bucket before, so one shuffle suffices.
    The driver holds one pair of ids a bucket.
    """
    spark = docs.sparkSession
    source = docs.select(id_or_least().alias("_at"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    n = source.count()
    buckets = min(most_buckets, max(1, n // rows_per_bucket, min(n // 64, shuffle_partitions(spark))))
    wanted = [i / buckets for i in range(1, buckets)]
    splits = sorted(set(source.agg(F.percentile_approx("_at", wanted, 100_000)).first()[0] or [])) if wanted else []
    bucket = _bucket(F.col("_at"), splits)
    firsts = sorted((r[0], r[1]) for r in source.groupBy(bucket.alias("b")).agg(F.min("_at")).collect())
    guests = spark.createDataFrame([(b, firsts[(i + 1) % len(firsts)][1]) for i, (b, _) in enumerate(firsts)], "_bucket int, _at long")
    own = source.withColumn("_bucket", bucket).withColumn("_guest", F.lit(False))
    sent = source.join(F.broadcast(guests), "_at").withColumn("_guest", F.lit(True))
    both = own.unionByName(sent.select(own.columns)).withColumn("sketch", sketch(F.col("text")))
    order = Window.partitionBy("_bucket").orderBy("_guest", "_at", F.xxhash64("text"))
    return (
        both.withColumn("_next", F.lead(F.struct("text", "sketch")).over(order))
        .filter(~F.col("_guest"))
        .select("doc_id", "text", "sketch", F.col("_next.text").alias("next_text"), F.col("_next.sketch").alias("next_sketch"))
    )


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last half of code points replaced by the first as many of ``other``."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))
