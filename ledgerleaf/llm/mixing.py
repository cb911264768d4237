"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected target / source_size times. The expected copies are summed in a fixed order, one offset per
source is added, and a document is emitted once for each whole number its interval crosses. The order is by size, largest first: what
has been taken then never strays from what was expected by more than the largest document.

A source may hold any share of the rows, so its documents are never ranked in one window. Ranks come from three levels: the
sizes of a source, SPREAD buckets of each size, and the rows of one bucket. Sources may be many, such as hosts: their running sums are
taken by ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, join_alike, quoted, stored, unused

WEIGHTS = (5, 2, 1)
#: Buckets into which the documents of one source and size are dealt by a hash of key and text, as many as three hexadecimal digits give.
SPREAD = 4096
SEED = "mix-1"


def running(df: DataFrame, order: list, **values) -> DataFrame:
    """df with a column for each value: its sum over all rows that come before in an order without ties. Ranges of the order are summed each
    by itself, and then the ranges' totals, of which there are as many as partitions."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = stored(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(*[F.sum(v).alias(f"_{n}") for n, v in values.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in values])
    here = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumns({n: F.coalesce(F.sum(v).over(here), F.lit(0)) for n, v in values.items()}).join(F.broadcast(totals), "_part")
    return out.select(*df.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in values])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes: source, source_size, a row for each source. Adds target: `share` of all sizes by weight, each at most `most` times its size.

    Resharing the excess until none is above fills all sources to one level per weight; sources stop in the order of
    most * size / weight, so running sums over the sources find which have stopped. Sources take the weights by
    code point in turn, null last. The result is stored.
    """
    by_name = F.col("source").asc_nulls_last()
    df = running(sizes, [by_name], _turn=F.lit(1))
    df = df.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_turn") % len(weights) + 1).cast("int")))
    df = df.withColumn("_cap", most * F.col("source_size")).withColumn("_level", F.col("_cap") / F.col("_weight")).drop("_turn")
    df = stored(running(df, [F.col("_level"), by_name], _filled=F.col("_cap"), _passed=F.col("_weight")))
    size, weight = df.agg(F.sum("source_size"), F.sum("_weight")).first()
    # a source is still below its cap if what is left, dealt by weight among it and the later ones, doesn't reach it
    left = F.lit(share * (size or 0)) - F.col("_filled")
    at = left / (F.lit(float(weight or 0)) - F.col("_passed"))
    first = df.where(at < F.col("_level")).agg(F.min(F.struct("_level", at.alias("at")))["at"]).first()[0]
    full = F.col("_cap")
    target = full if first is None else F.when(at < F.col("_level"), F.least(full, F.lit(first) * F.col("_weight"))).otherwise(full)
    return df.select("source", "source_size", target.cast("double").alias("target"))


def offset(source) -> F.Column:
    """The random number in [0, 1) that a source starts from, the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(source, F.lit("\0")))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A row per document: key, source, size, source_size, target, copies, taken.

    key may be of any type that sorts. Null texts have size 0; null sources are one source, last; rows alike in source, size, key and text are
    interchangeable. Documents without words are emitted like others, and take no words. Very long texts are measured whole. An
    empty table gives an empty one. Columns besides the three named are not looked at.
    """
    id_, body = quoted(key), quoted(text).cast("string")
    rows = df.select(id_.alias("key"), quoted(source).cast("string").alias("source"), F.coalesce(F.regexp_count(body, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.substring(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit("/"), F.coalesce(body, F.lit(""))).cast("binary")), 1, 3).alias("bucket"))
    rows = stored(rows)
    cells = stored(rows.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n")))
    steps = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sums = targets(steps.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")))
    above = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select("source", "size", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("_above"))
    within = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "size", "bucket", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("_within"))
    cells = join_alike(join_alike(cells, steps, ["source", "size"]), sums, ["source"])
    cells = cells.select("source", "size", "bucket", "source_size", "target", (F.col("_above") + F.col("_within")).alias("_first"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("key")))
    ranked = join_alike(ranked, cells, ["source", "size", "bucket"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    place = (F.col("_first") + F.col("_rank")).cast("double")
    crossed = F.floor(offset(F.col("source")) + place * rate) - F.floor(offset(F.col("source")) + (place - 1) * rate)
    ranked = ranked.withColumn("copies", F.least(crossed, F.lit(2)).cast("long"))
    return ranked.select("key", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emitted(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: df's rows, all columns, each as often as the mix takes it; see mix() for nulls, ties and long texts.

    A row is found again by its key, source and size, and, where several rows share those, by its turn among them; such rows may
    trade their copies, which changes no source's total. An empty table gives an empty one.
    """
    names = key_, source_, size_, turn_, copies_ = unused(df, "_key", "_source", "_size", "_turn", "_copies")
    taken = mix(df, key, text, source).select(F.col("key").alias(key_), F.col("source").alias(source_), F.col("size").alias(size_), F.col("copies").alias(copies_))
    taken = stored(taken)
    on = list(names[:3])
    size = F.coalesce(F.regexp_count(quoted(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = df.withColumns({key_: quoted(key), source_: quoted(source).cast("string"), size_: size})
    if not taken.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        turn = Window.partitionBy(*on)
        taken = taken.withColumn(turn_, F.row_number().over(turn.orderBy(copies_)))
        rows = rows.withColumn(turn_, F.row_number().over(turn.orderBy(F.xxhash64(quoted(text)))))
        on = [*on, turn_]
    # taken has a row for each document, so its size has no bound and it isn't sent to all, whatever its size is just now
    out = join_alike(rows, taken.where(F.col(copies_) > 0).hint("merge"), on)
    return out.withColumn(copies_, F.explode(F.expr(f"sequence(1, cast(`{copies_}` as int))"))).select(*[quoted(c) for c in df.columns])


SQL = r"""
WITH d AS (SELECT doc_id, text, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS level FROM w),
r AS (SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM c),
f AS (SELECT min_by(rest / weights, level) AS fill FROM r WHERE rest / weights < level),
t AS (SELECT source, source_size, CASE WHEN rest / weights < level THEN least(cap, (SELECT fill FROM f) * weight) ELSE cap END AS target FROM r),
k AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || '/' || coalesce(d.text, '')), 1, 3), d.doc_id)::DOUBLE AS place,
  ('0x' || substr(md5('mix-1' || coalesce(d.source, chr(0))), 1, 8))::UBIGINT::DOUBLE / 4294967296.0::DOUBLE AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(least(floor(start + place * rate) - floor(start + (place - 1) * rate), 2) AS BIGINT) * size AS taken FROM k
"""
