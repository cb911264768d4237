"""Reading and extracting fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base_name, or_empty, quoted_cell, utf16_order, yes_no
from ..model import EXTRACT_NAME
from ..session import stored


def current_value() -> Column:
    """A field's value as JSON text: a boolean for a checkbox, an array for a dropdown, otherwise a string; '' if it could not be read."""
    text = F.to_json(F.struct(or_empty(F.col("text_value")).alias("v")))
    return (
        F.when(F.col("read_error").isNotNull(), '""')
        .when(F.col("field_type").isin("text", "radio"), F.regexp_extract(text, r"^\{\"v\":(.*)\}$", 1))
        .when(F.col("field_type") == "checkbox", F.coalesce(F.col("checked"), F.lit(False)).cast("string"))
        .when((F.col("field_type") == "dropdown") & F.col("selected").isNotNull(), F.to_json("selected"))
        .otherwise('""')
    )


def named(fields: DataFrame) -> DataFrame:
    """The fields, without the rows that stand for forms without any."""
    return fields.where(F.col("field_name").isNotNull())


def read_fields(fields: DataFrame) -> DataFrame:
    """name, type, options and current_value of each field, in order within the file. Only dropdowns list options."""
    options = F.when(F.col("field_type") == "dropdown", F.coalesce("options", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    return named(fields).select("file", "field_ordinal", F.col("field_name").alias("name"), F.col("field_type").alias("type"), options.alias("options"), current_value().alias("current_value"))


def field_counts(fields: DataFrame) -> DataFrame:
    """The table of forms: file and n_fields, 0 for a form without fields."""
    return fields.groupBy("file").agg(F.count("field_name").alias("n_fields"))


def batch(paths: DataFrame, fields: DataFrame, *, n: str = "n", path: str = "path") -> DataFrame:
    """form_fields of a list of paths, a form for each time that one is listed. n: its place in the list. Files are called <n>/<base name>, n in
    twenty digits, so that they sort as listed. A path without a form fails the job.

    The forms' own fields are the larger side; a form that is listed very often is a key that Spark may split.
    """
    there = fields.withColumnRenamed("file", "_path").withColumn("_there", F.lit(True))
    out = paths.select(F.concat(F.lpad(F.col(n).cast("string"), 20, "0"), F.lit("/"), base_name(F.col(path))).alias("file"), F.col(path).alias("_path")).join(there, "_path", "left")
    out = out.withColumn("file", F.when(F.col("_there"), F.col("file")).otherwise(F.raise_error(F.concat(F.lit("No such form: "), F.col("_path")))))
    return out.select(*fields.columns)


def counts(fields: DataFrame) -> DataFrame:
    """n_forms (those without fields too) and n_fields (distinct names), as partial aggregates."""
    return fields.agg(F.count_distinct("file").alias("n_forms"), F.count_distinct("field_name").alias("n_fields"))


def cell() -> Column:
    """A field's value in a table: yes or no, the text, the selection joined by commas; '' for other kinds and unread ones."""
    return (
        F.when(F.col("read_error").isNotNull(), "")
        .when(F.col("field_type").isin("text", "radio"), or_empty(F.col("text_value")))
        .when(F.col("field_type") == "checkbox", yes_no(F.coalesce(F.col("checked"), F.lit(False))))
        .when(F.col("field_type") == "dropdown", or_empty(F.array_join("selected", ",")))
        .otherwise("")
    )


def extract_long(fields: DataFrame) -> DataFrame:
    """file, field_name, cell; of fields that share a name within a file the last one counts."""
    return _last(named(fields))


def _last(fields: DataFrame) -> DataFrame:
    return fields.groupBy("file", "field_name").agg(F.max_by(cell(), F.coalesce("field_ordinal", F.lit(0))).alias("cell"))


def header(fields: DataFrame) -> list[str]:
    """The distinct field names in order of UTF-16 code units. They become columns, so they must fit a header, on the driver as well;
    numbered_names() has no such limit."""
    return utf16_order([r[0] for r in named(fields).select("field_name").distinct().collect()])


def numbered_names(fields: DataFrame) -> DataFrame:
    """field_name and position (long, from 0) of the distinct names in order of UTF-16 code units, however many there are.

    Names are ranked within ranges of the order, and counts of the ranges before are added, of which there are as many as partitions. The result is stored.
    """
    names = named(fields).select("field_name").distinct().withColumn("_units", F.encode("field_name", "UTF-16BE"))
    ranged = stored(names.repartitionByRange("_units").withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_units")) - 1
    return stored(ranged.withColumn("_rank", rank).join(sizes, "_part").select("field_name", (F.col("_before") + F.col("_rank")).cast("long").alias("position")))


def sparse_lines(fields: DataFrame, names: DataFrame, n_names: int) -> DataFrame:
    """file and line as extract_lines() has them, for any number of names. names: numbered_names().

    A line is put together from the form's own cells by their positions, and a run of empty cells for each gap, so neither the plan nor a row grows with
    names that the form lacks, only the line itself does.
    """
    found = _last(fields)
    cells = found.join(names, "field_name", "left")
    pair = F.when(F.col("field_name").isNotNull(), F.struct("position", "cell"))
    forms = cells.groupBy("file").agg(F.sort_array(F.collect_list(pair)).alias("_cells"), F.max(F.when(F.col("field_name") == EXTRACT_NAME, F.col("cell"))).alias("_own"))
    name = F.coalesce("_own", base_name(F.col("file")))
    own = names.where(F.col("field_name") == EXTRACT_NAME).first()
    if own:  # then every form has that column, under its own name
        forms = forms.withColumn("_cells", F.sort_array(F.concat(F.filter("_cells", lambda x: x["position"] != own["position"]), F.array(F.struct(F.lit(own["position"]).alias("position"), name.alias("cell"))))))
    gap = lambda n: F.repeat(F.lit(',""'), n.cast("int"))
    at = lambda i: F.when(i >= 0, F.get("_cells", i)["position"]).otherwise(F.lit(-1))
    body = F.array_join(F.transform("_cells", lambda x, i: F.concat(gap(x["position"] - at(i - 1) - 1), F.lit(","), quoted_cell(x["cell"]))), "")
    return forms.select("file", F.concat(quoted_cell(name), body, gap(F.lit(n_names) - at(F.size("_cells") - 1) - 1)).alias("line"))


def field_names(fields: DataFrame) -> DataFrame:
    return numbered_names(fields).select(F.col("position").cast("int").alias("position"), "field_name")


def _by_file(fields: DataFrame) -> DataFrame:
    """A row for each file with the map of its cells. Dealt by file once, which serves both aggregates."""
    pair = F.when(F.col("field_name").isNotNull(), F.struct(F.col("field_name").alias("key"), F.col("cell").alias("value")))
    return _last(fields.repartition("file")).groupBy("file").agg(F.map_from_entries(F.collect_list(pair)).alias("_cells"))


def extract_wide(fields: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row for each file: _filename and a column for each name of any file, '' where a file lacks it.

    A field called _filename overwrites the name, as in the CSV that this becomes. Names that differ only by case are columns of
    their own and need spark.sql.caseSensitive to be told apart afterwards; extract_lines() doesn't.
    """
    names = header(fields) if names is None else names
    name = F.coalesce(F.element_at("_cells", EXTRACT_NAME), F.element_at(F.split("file", "/"), -1))
    columns = [or_empty(F.element_at("_cells", F.lit(n))).alias(n) for n in names if n != EXTRACT_NAME]
    return _by_file(fields).select(name.alias(EXTRACT_NAME), *columns)


def extract_lines(fields: DataFrame, names: list[str] | None = None) -> DataFrame:
    """file and line: the CSV line of each file, every cell between quotes that are not escaped."""
    names = header(fields) if names is None else names
    name = F.coalesce(F.element_at("_cells", EXTRACT_NAME), F.element_at(F.split("file", "/"), -1))
    cells = [quoted_cell(name), *(quoted_cell(name if n == EXTRACT_NAME else or_empty(F.element_at("_cells", F.lit(n)))) for n in names)]
    return _by_file(fields).select("file", F.concat_ws(",", *cells).alias("line"))


def header_line(names: list[str]) -> str:
    """The first line, not quoted."""
    return ",".join([EXTRACT_NAME, *names])


def union_forms(*tables: DataFrame) -> DataFrame:
    """Forms of different shapes as one table; nothing is deduplicated."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
