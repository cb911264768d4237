"""From documents to token ids: what is kept, once, without personal data, mixed and encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm import bpe, compression_quality, mixing, pii, simhash
from ledgerleaf.llm.common import forget, forget_paths, stored, table, unused, written
from ledgerleaf.llm.queries import PII_KEY, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good ones; it is fitted on labelled documents outside the held-out fold.

    Null and empty texts, and others without evidence, go; rows repeated stay or go together; without labels of both classes all
    stay. Scores of exactly a half stay. An empty table gives an empty one; all columns stay, but one called like the score.
    """
    score, = unused(docs, "_score")
    model = compression_quality.trained(docs, table(spark, sf_dir, "labels"))
    return compression_quality.score(docs, model, out=score).where(F.col(score) >= 0.5).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least doc_id, of each group that SimHash fingerprints of three-word shingles link, at 3 differing bits or fewer.

    Of rows repeated, and of null and empty texts, one stays. Texts of any length count whole. An empty table gives an empty one; all columns
    stay.
    """
    return simhash.first_of_groups(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with surrogates for its entities and n_chars of the new text.

    Null and empty texts stay so; rows repeated get the same text. Texts of any length are searched whole. An empty table gives an empty one; all
    columns stay.
    """
    spans, = unused(docs, "_spans")
    out = pii.pseudonymise(docs, PII_KEY, spans=spans).drop(spans)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document none, one or two times, by its source's target.

    Null sources are one source; null and empty texts have no words and come along at their source's rate; rows repeated may trade their
    copies. An empty table gives an empty one; all columns stay.
    """
    return mixing.emitted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and the SHA-256 of what they decode to.

    Null and empty texts have no ids; texts of any length are encoded whole; rows repeated get the same. An empty table gives an empty one. Of the
    columns doc_id, lang and source stay.
    """
    path = tokenizer_path()
    coded = bpe.round_trip(docs, path)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("private_data", private_data), ("mix", mix), ("encode", encode)]

#: SQL can express neither the classifier nor the fingerprints; tests/llm holds the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each one's result stored in the shared folder; what a stage stored on its way is deleted once its result is."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES:
        n = len(written(spark))
        docs = stored(stage(spark, docs, sf_dir))
        forget_paths(spark, written(spark)[n:-1])
        if before is not None:
            forget(before)
        before = docs
    return docs
