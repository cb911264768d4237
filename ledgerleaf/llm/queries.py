"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, boosted_rules, bpe, compression_quality, filter_audit, html_extract, labelled, language_id, lattice, mixing, pii, relative_lz, simhash, suffix_dedup
from .common import table

#: The key of the registered PII query; a deployment passes its own secret.
PII_KEY = b"registered query, not a secret"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.pseudonymise(docs, PII_KEY)
    return out.select("doc_id", "text", F.size("pii_spans").cast("long").alias("n_replaced"), F.array_join(F.array_sort(F.array_distinct("pii_spans.kind")), ",").alias("kinds"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.trained(docs))
    return found.select("doc_id", F.coalesce(labelled.fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = compression_quality.score(docs, compression_quality.trained(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(labelled.fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_boosted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = boosted_rules.judge(docs, boosted_rules.trained(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", *boosted_rules.BASE, "base_failed", "kept")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.cut_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return lattice.near_vectors(vectors).select("vec_id", "n_links", F.col("component_id").cast("long").alias("component_id"), "kept")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = simhash.near_groups(docs)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return alignment.align(docs, *map(tokenizer_path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")))


def op12_relative_lz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return relative_lz.cut_passages(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_language_id": op4_language_id,
    "op5_html_blocks": op5_html_blocks,
    "op6_lattice_near_dedup": op6_lattice_near_dedup,
    "op7_source_mixing": op7_source_mixing,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_compression_quality": op9_compression_quality,
    "op10_boosted_rules": op10_boosted_rules,
    "op11_token_alignment": op11_token_alignment,
    "op12_relative_lz_dedup": op12_relative_lz_dedup,
    "op13_filter_audit": op13_filter_audit,
}

SQL: dict[str, str] = {"op2_suffix_dedup": suffix_dedup.SQL, "op6_lattice_near_dedup": lattice.SQL, "op7_source_mixing": mixing.SQL, "op12_relative_lz_dedup": relative_lz.SQL, "op13_filter_audit": filter_audit.SQL}
