"""The registered queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fingerprints, html_text, jaccard_join, licenses, line_dedup, packing, quality, sharding, token_files
from .common import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def held_out() -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def op1_nb_support_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(~held_out()).select("doc_id", F.col("quality").cast("int").alias("label"))
    scored = quality.score(docs, quality.fit_table(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=8)


def op3_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary(), capacity=2048, end_id=0)


def op4_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_files(token_files.write_files(table(spark, sf_dir, "documents"), vocabulary(), end_id=2))


def op5_segment_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"), least_equal=1)


def op6_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fingerprints.with_next(table(spark, sf_dir, "documents"))
    both = docs.withColumn("edited", fingerprints.edited(F.col("text"), F.col("next_text")))
    sketched = both.withColumn("edited_sketch", fingerprints.sketch(F.col("edited")))
    return sketched.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op8_pigeonhole_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), words=3, percent=90)


def op10_diagonal_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_nb_support_vectors, op2_sampled_splitters, op3_vector_best_fit, op4_bit_packed_ids, op5_segment_partition, op6_tree_scoring,
        op7_bottom_k, op8_pigeonhole_edit, op9_signature_trees, op10_diagonal_voting,
    )
}
ORACLE_SQL: dict[str, str] = {}
