"""The bounded sample of labelled documents that classifiers are fitted on."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(key: str, folds: int):
    """crc32 of a key's decimal text, modulo folds; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def likely(h, wanted: int, of: int):
    """Whether an MD5 is among so many of the least that, of `of` rows, four times `wanted` are; all are if there are few.

    Only these go to the driver from any partition, so what it receives doesn't grow with the number of partitions.
    """
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") <= min(1.0, 4 * wanted / max(1, of)) * float(1 << 32)


def sample(docs: DataFrame, labels: DataFrame, *, per_class: int, folds: int, held_out: int, label: str = "quality") -> DataFrame:
    """doc_id, text and label of at most per_class labelled documents of each class, outside the held-out fold.

    The rows are those whose key has the least MD5, so the same whatever the partitions; null keys and labels are left out, and so are
    keys labelled twice in different ways. Of rows that share a key the least text counts, so no key comes twice. per_class bounds what
    is broadcast and, later, what reaches the driver.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(fold("doc_id", folds) != held_out)
    known = known.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("_most")).where("label = _most").drop("_most")
    chosen, h = None, F.md5(F.col("doc_id").cast("string").cast("binary"))
    counts = dict(known.groupBy("label").count().collect())
    for c in (0, 1):
        part = known.where((F.col("label") == c) & likely(h, per_class, counts.get(c, 0))).orderBy(h, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def pieces(rows: DataFrame, size: int, *keys: str) -> DataFrame:
    """doc_id, keys and pieces: the pieces of `size` bytes that every whole text of rows (doc_id, text, keys) is made of, in order."""

    @F.arrow_udf("array<binary>")
    def cut(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            data = (t.as_py() or "").encode("utf-8", "surrogatepass")
            out.append([data[i : i + size] for i in range(0, len(data), size)])
        return pa.array(out, pa.list_(pa.binary()))

    return rows.select("doc_id", *keys, cut(F.col("text").cast("string")).alias("pieces"))
