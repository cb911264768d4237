"""What filters remove together and alone, in any order of application.

Five conditions fail a document. Their cells, 32 for each part, are counted once; SQL's CUBE over the five flags and the part then sums
them for every subset of filters, and of each grouping set the row whose selected flags are all false holds what survives that subset. A step of an order
is a pair of subsets, before and after, so everything about it is a join of two of those rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LETTERS = "ABCDE"
#: A: fewer words than this. B: fewer distinct words in a hundred. C: more capitals in a hundred code points. D: any of these characters.
FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, "[#$%&*|]"
COUNTS = ("n", "good", "toxic")


def flags(text: Column) -> list[Column]:
    """The four conditions that a text alone decides, as fails_A to fails_D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    return [
        (F.size(words) < FEWEST_WORDS).alias("fails_A"),
        (100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * F.size(words).cast("long")).alias("fails_B"),
        (100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long") > MOST_CAPITALS * F.length(text).cast("long")).alias("fails_C"),
        text.rlike(SYMBOLS).alias("fails_D"),
    ]


def judged(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, fails_A to fails_E, good and toxic of each document.

    E compares texts by SHA-256: the least key of each text is found with partial aggregates, and is joined back by text and key, so rows of a text that
    a third of all documents hold are dealt by their keys, and only the first of them finds its match.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.sha2(whole, 256).alias("_text"), *flags(whole))
    first = docs.select(F.col(key).alias("_key"), F.sha2(whole, 256).alias("_text")).groupBy("_text").agg(F.min("_key").alias("_key")).withColumn("_first", F.lit(True))
    marks = labels.groupBy(F.col("doc_id").alias("_key")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(f"_{c}") for c in ("quality", "toxic")])
    out = rows.join(first, ["_key", "_text"], "left").join(marks, "_key", "left")
    late, no = F.col("_key").isNotNull() & F.col("_first").isNull(), F.lit(False)
    return out.select("part", *[f"fails_{x}" for x in LETTERS[:4]], late.alias("fails_E"), F.coalesce("_quality", no).alias("good"), F.coalesce("_toxic", no).alias("toxic"))


def survivors(rows: DataFrame) -> DataFrame:
    """part, subset (bit i: filter i of LETTERS), and how many documents of the part, good ones and toxic ones pass every filter of the subset; a row
    for each of the 32 subsets and each part, zeros included."""
    names = [f"fails_{x}" for x in LETTERS]
    cells = stored(rows.groupBy("part", *names).agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")))
    cube = cells.cube("part", *names).agg(*[F.sum(c).alias(c) for c in COUNTS], F.grouping("part").alias("_all"), *[F.grouping(x).alias(f"_{x}") for x in names])
    pure = F.col("_all") == 0
    for x in names:
        pure = pure & ((F.col(f"_{x}") == 1) | ~F.col(x))
    subset = sum(((1 - F.col(f"_{x}").cast("int")) * (1 << i) for i, x in enumerate(names)), F.lit(0))
    found = cube.where(pure).select("part", subset.alias("subset"), *COUNTS)
    every = cells.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("subset"))
    return every.join(found, ["part", "subset"], "left").select("part", "subset", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS])


def audit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, filter_order, step, filter, and within the part kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley: a row for each
    step of each of the 120 orders and each part.

    A null text is an empty one, and is identical to empty texts; a null part is the part ''. A null key has no label, and its document
    is no copy, nor is it the first of others. Of rows repeated with one key, none is a copy of another, and each counts. A document
    with several labels is good or toxic if any says so. Texts of any length count whole. A table without documents gives no rows. Other columns are not
    looked at, whatever their names.
    """
    have = survivors(judged(docs, labels, key=key, text=text, part=part))
    bit = {x: 1 << i for i, x in enumerate(LETTERS)}
    at = lambda n, m: F.sum(F.when(F.col("subset") == m, F.col(n)).otherwise(0))
    alone = have.groupBy("part").agg(*[F.struct(F.lit(x).alias("filter"), (at("n", 0) - at("n", bit[x])).alias("fails"), (at("n", 31 ^ bit[x]) - at("n", 31)).alias("unique_fails")).alias(x) for x in LETTERS])
    alone = alone.select("part", F.inline(F.array(*LETTERS)))
    orders = ["".join(p) for p in permutations(LETTERS)]
    steps = docs.sparkSession.createDataFrame(
        [(o, k + 1, x, sum(bit[y] for y in o[:k]), sum(bit[y] for y in o[: k + 1])) for o in orders for k, x in enumerate(o)],
        "filter_order string, step int, filter string, before int, after int",
    )
    # the 600 steps are the same for any input
    was = have.withColumnsRenamed({"subset": "before"} | {c: f"{c}_before" for c in COUNTS}).join(F.broadcast(steps), "before")
    pairs = was.join(have.withColumnRenamed("subset", "after"), ["part", "after"]).join(alone, ["part", "filter"])
    lost = lambda c: F.col(f"{c}_before") - F.col(c)
    out = pairs.select("part", "filter_order", "step", "filter", F.col("n").alias("kept"), lost("n").alias("removed"), (F.col("fails") - lost("n")).alias("redundant"), "unique_fails", lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"))
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


#: Documents and orders one by one: the step at which each order removes each document.
SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT row_number() OVER () AS r, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, MAP {
 'A': len(ws) < 50, 'B': 100 * len(list_distinct(ws)) < 65 * len(ws), 'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
 'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)} AS fails FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a JOIN x b ON b.x <> a.x JOIN x c ON c.x NOT IN (a.x, b.x) JOIN x d ON d.x NOT IN (a.x, b.x, c.x) JOIN x e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
k AS (SELECT r, part, good, toxic, fails, filter_order, coalesce(list_position(list_transform(string_split(filter_order, ''), lambda y: fails[y]), true), 6) AS gone, len(list_filter(map_values(fails), lambda v: v)) AS n_fails FROM f CROSS JOIN o),
s AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS filter, CAST(count_if(gone > step) AS BIGINT) AS kept, CAST(count_if(gone = step) AS BIGINT) AS removed, CAST(count_if(fails[filter_order[step]] AND gone < step) AS BIGINT) AS redundant,
 CAST(count_if(fails[filter_order[step]] AND n_fails = 1) AS BIGINT) AS unique_fails, CAST(count_if(gone = step AND good) AS BIGINT) AS good_lost, CAST(count_if(gone = step AND toxic) AS BIGINT) AS toxic_lost
 FROM k CROSS JOIN (SELECT unnest(range(1, 6)) AS step) GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM s"""
