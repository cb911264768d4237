"""Completeness of forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, is_required

#: Empty fields that a report names.
NAMED = 10


def is_empty() -> Column:
    """Text: nothing but white space. A checkbox never. A radio group: nothing selected. A dropdown: no selection read, whereas an empty
    selection counts as one. Other kinds always."""
    return (
        F.when(F.col("field_type") == "text", is_blank(F.col("text_value")))
        .when(F.col("field_type") == "checkbox", F.lit(False))
        .when(F.col("field_type") == "radio", F.coalesce(F.col("text_value") == "", F.lit(True)))
        .when(F.col("field_type") == "dropdown", F.col("selected").isNull())
        .otherwise(F.lit(True))
    )


def _unread() -> Column:
    return F.col("read_error").isNotNull()


def _lacking() -> Column:
    """Whether a row is an empty field; the row of a form without fields is none."""
    return F.col("field_name").isNotNull() & (_unread() | is_empty())


def _entry(name: Column) -> Column:
    return F.struct(F.coalesce("field_ordinal", F.lit(0)).alias("o"), name.alias("n"))


def _named() -> Column:
    return F.when(_unread(), F.concat("field_name", F.lit(" (error reading)"))).otherwise(F.col("field_name"))


def _counters() -> list[Column]:
    return [F.count("field_name").alias("total"), F.count_if(F.col("field_name").isNotNull() & ~_lacking()).alias("filled"), F.count_if(_lacking()).alias("empty")]


def _listed(c: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(c)), lambda x: x.n)


def _required() -> Column:
    return _listed(F.when(_lacking() & ~_unread() & is_required(F.col("field_name")), _entry(F.col("field_name"))))


def validate(fields: DataFrame) -> DataFrame:
    """file, total, filled, empty, required (empty fields that are required) and empty_fields, both in the form's order.

    A field that could not be read is empty, is named with a remark, and is not looked at as required. A form without fields counts 0. Both lists
    hold all names; summary() is for forms of any length.
    """
    return fields.groupBy("file").agg(*_counters(), _required().alias("required"), _listed(F.when(_lacking(), _entry(_named()))).alias("empty_fields"))


def counters(fields: DataFrame) -> DataFrame:
    """file, total, filled, empty: partial counts, whatever the form's length."""
    return fields.groupBy("file").agg(*_counters())


def summary(fields: DataFrame, named: int = NAMED) -> DataFrame:
    """file, total, filled, empty, first_empty (at most `named` names, a line each) and more (how many empty fields are left out).

    The first names are picked by rank, which Spark limits before it shuffles, and counters are partial counts, so a form of any number of fields sends a few rows from
    each task and no list grows with it.
    """
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.coalesce("field_ordinal", F.lit(0)), "field_name"))
    first = fields.where(_lacking()).select("file", "field_ordinal", "field_name", "read_error").withColumn("_rank", rank).where(F.col("_rank") <= named)
    first = first.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", _named().alias("n")))), lambda x: x.n), "\n").alias("first_empty"))
    out = counters(fields).join(first, "file", "left")
    return out.select("file", "total", "filled", "empty", F.coalesce("first_empty", F.lit("")).alias("first_empty"), F.greatest(F.col("empty") - named, F.lit(0)).alias("more"))


def first_empty(report: DataFrame, named: int = NAMED) -> DataFrame:
    """The same two columns of a report that has all names."""
    return report.select("file", F.array_join(F.slice("empty_fields", 1, named), "\n").alias("first_empty"), F.greatest(F.size("empty_fields") - named, F.lit(0)).cast("long").alias("more"))


def report_text(report: DataFrame, named: int = NAMED) -> DataFrame:
    """file and the report as text."""
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("PDF Validation Report for: "), F.element_at(F.split("file", "/"), -1)),
        F.concat(F.lit("Total fields: "), F.col("total")),
        F.concat(F.lit("Filled: "), F.col("filled")),
        F.concat(F.lit("Empty: "), F.col("empty"), F.lit("\n")),
    )
    required = F.when(F.size("required") > 0, F.concat(F.lit("\n⚠️  Required fields that are empty:\n"), F.array_join("required", "\n"))).otherwise("")
    n = F.size("empty_fields")
    some = (
        F.when(n > named, F.concat(F.lit(f"\n\nFirst {named} empty fields:\n"), F.array_join(F.slice("empty_fields", 1, named), "\n"), F.lit("\n... and "), n - named, F.lit(" more")))
        .when(n > 0, F.concat(F.lit("\n\nEmpty fields:\n"), F.array_join("empty_fields", "\n")))
        .otherwise("")
    )
    return report.select("file", F.concat(lines, required, some).alias("report"))
