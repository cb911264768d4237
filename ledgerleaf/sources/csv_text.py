"""CSV in the plainest sense: lines at newlines, cells at commas, no quoting; cells are trimmed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, parts, trimmed
from ..session import stored


def parse(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, column, header, value) of each whole text; rows count from 0.

    White space and byte order marks around the text go; blank lines inside are records of ''. Missing cells are '', extra ones
    are dropped. Of headers that are alike the last one counts. A text of a header alone has no rows.
    """
    rows = _rows(texts, key, text)
    cells = rows.select(key, "row", "_headers", "_cells", F.posexplode("_headers").alias("column", "header"))
    last = F.array_position(F.slice("_headers", F.col("column") + 2, F.size("_headers")), F.col("header")) == 0
    return cells.where(last).select(key, "row", "column", "header", F.coalesce(F.get("_cells", F.col("column")), F.lit("")).alias("value"))


def _rows(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, row, _headers and _cells."""
    lines = texts.select(F.col(key), parts(trimmed(F.coalesce(F.col(text), F.lit(""))), "\n").alias("_lines"))
    lines = lines.select(key, F.transform(parts(F.element_at("_lines", 1), ","), trimmed).alias("_headers"), F.slice("_lines", 2, 2147483647).alias("_rest"))
    rows = lines.select(key, "_headers", F.posexplode("_rest").alias("row", "_line"))
    return rows.select(key, F.col("row").cast("long").alias("row"), "_headers", F.transform(parts(F.col("_line"), ","), trimmed).alias("_cells"))


def _record() -> Column:
    """The map of a row's _headers and _cells."""
    last = F.filter(F.sequence(F.lit(0), F.size("_headers") - 1), lambda i: F.array_position(F.slice("_headers", i + 2, F.size("_headers")), F.get("_headers", i)) == 0)
    # _cells is named twice, so that it isn't split again for each of its elements
    entry = lambda i: F.struct(F.get("_headers", i).alias("key"), F.when(i < F.size("_cells"), F.element_at("_cells", i + 1)).otherwise("").alias("value"))
    return F.map_from_entries(F.transform(last, entry))


def records(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, record): the same, a map for each row; nothing is shuffled."""
    return _rows(texts, key, text).select(key, "row", _record().alias("record"))


def _raw(spark: SparkSession, paths: tuple[str, ...]) -> DataFrame:
    """file, block, id, line: files in Spark's byte ranges, which start and end at newlines; a range is read in order by one task, so ids rise within it."""
    lines = spark.read.option("lineSep", "\n").text(list(paths))
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))


def _blocks(raw: DataFrame) -> DataFrame:
    """A row for each byte range: file, block, shift (what makes an id the line's number in the file), and of the file head (its first line that
    isn't blank), first and last (the numbers of the first and last such line); these are null where all is blank.

    Numbers come from a running sum over the ranges of a file, of which there are as many as the file has blocks. Stored, so that Spark knows how small it is.
    """
    full = ~is_blank(F.col("line"))
    counts = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("from"), F.min(F.when(full, F.struct("id", "line"))).alias("head"), F.max(F.when(full, F.col("id"))).alias("last"))
    counts = stored(counts)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("shift", F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("from"))
    heads = placed.where("head is not null").groupBy("file").agg(F.min(F.struct((F.col("head.id") + F.col("shift")).alias("at"), F.col("head.line").alias("line"))).alias("x"), F.max(F.col("last") + F.col("shift")).alias("last"))
    return stored(placed.select("file", "block", "shift").join(heads.select("file", F.col("x.at").alias("first"), F.col("x.line").alias("head"), "last"), "file", "left"))


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, number, line) of text files of any size, numbers from 0; lines end at newlines only, and an empty one after the last newline isn't there."""
    raw = _raw(spark, paths)
    return raw.join(_blocks(raw).select("file", "block", "shift"), ["file", "block"]).select("file", (F.col("id") + F.col("shift")).alias("number"), "line")


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, row, record) of CSV files of any size, which Spark reads in byte ranges: what records() gives of whole texts. Lines themselves aren't shuffled
    while the table of ranges, a row for each of them, is small enough for Spark to send it to all."""
    raw = _raw(spark, paths)
    lines = raw.join(_blocks(raw), ["file", "block"]).withColumn("number", F.col("id") + F.col("shift")).where("number > first and number <= last")
    cells = lines.select("file", (F.col("number") - F.col("first") - 1).alias("row"), F.transform(parts(F.col("head"), ","), trimmed).alias("_headers"), F.transform(parts(F.col("line"), ","), trimmed).alias("_cells"))
    return cells.select("file", "row", _record().alias("record"))
