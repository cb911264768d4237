"""Filling forms with records, and merging profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WHOLE, as_text, checks, in_key_order, merged


def values(records: DataFrame, key: str, record: str = "record") -> DataFrame:
    """Rows (row, ordinal, field_name, value, value_kind) of maps of strings, in the order in which their keys are taken."""
    entries = in_key_order(F.map_entries(record))
    return records.select(F.col(key).alias("row"), F.posexplode(entries).alias("ordinal", "e")).select("row", "ordinal", F.col("e.key").alias("field_name"), F.col("e.value").alias("value"), F.lit("string").alias("value_kind"))


def json_values(records: DataFrame, key: str, json: str = "field_data") -> DataFrame:
    """The same of JSON objects, whose values keep their kind: string, number, boolean, null, or the JSON of anything else. Keys keep the order
    in which the object has them, but for whole numbers, which come first."""
    kind = "case schema_of_variant(v) when 'STRING' then 'string' when 'BOOLEAN' then 'boolean' when 'VOID' then 'null' else case when schema_of_variant(v) rlike '^(OBJECT|ARRAY)' then 'json' else 'number' end end"
    keys = F.transform(F.array_distinct(F.json_object_keys(json)), lambda k: F.struct(k.alias("key"), k.alias("value")))
    parsed = records.select(F.col(key).alias("row"), F.expr(f"cast(parse_json(`{json}`) as map<string,variant>)").alias("m"), F.transform(in_key_order(keys), lambda e: e.key).alias("keys"))
    rows = parsed.select("row", "m", F.posexplode("keys").alias("ordinal", "field_name")).select("row", "ordinal", "field_name", F.element_at("m", F.col("field_name")).alias("v"))
    return rows.selectExpr("row", "ordinal", "field_name", "case when schema_of_variant(v) rlike '^(OBJECT|ARRAY)' then to_json(v) else cast(v as string) end as value", f"{kind} as value_kind")


def new_value(kind: Column = None) -> Column:
    """What a field holds after filling: the text, 'yes' or 'no' for a checkbox; unchanged (null) for other kinds."""
    text = as_text(F.col("value"), F.col("value_kind"))
    return F.when(F.col("field_type") == "checkbox", F.when(checks(F.col("value"), F.col("value_kind")), "yes").otherwise("no")).when(F.col("field_type").isin("text", "radio", "dropdown"), text)


def fill(data: DataFrame, template: DataFrame) -> DataFrame:
    """data: rows of values(); template: the form_fields of one form. Adds field_type, status, new_value and error to every value.

    Names must match exactly. A name that the form lacks is not_found; a radio option that it lacks is an error; everything else is filled,
    fields of unknown kind too, whose value stays. The template is one form, so Spark broadcasts it when its size allows.
    """
    fields = template.groupBy("field_name").agg(F.min_by("field_type", F.coalesce("field_ordinal", F.lit(0))).alias("field_type"), F.min_by("options", F.coalesce("field_ordinal", F.lit(0))).alias("_options"))
    joined = data.join(fields, "field_name", "left")
    text = as_text(F.col("value"), F.col("value_kind"))
    bad = (F.col("field_type") == "radio") & (F.size("_options") > 0) & ~F.array_contains("_options", text)
    status = F.when(F.col("field_type").isNull(), "not_found").when(F.coalesce(bad, F.lit(False)), "error").otherwise("filled")
    message = F.when(F.col("status") == "not_found", F.concat(F.lit("Field '"), F.col("field_name"), F.lit("' not found in PDF. Check field name or use 'read_pdf_fields' to see available fields."))).when(F.col("status") == "error", F.concat(F.lit("Field '"), F.col("field_name"), F.lit("': no such option: "), text))
    joined = joined.withColumn("status", status)
    return joined.select("row", "ordinal", "field_name", "field_type", "status", F.when(F.col("status") == "filled", new_value()).alias("new_value"), message.alias("error"))


def fill_status(filled: DataFrame) -> DataFrame:
    """row, n_filled, n_errors and errors, in the order of the values."""
    errors = F.transform(F.array_sort(F.collect_list(F.when(F.col("status") != "filled", F.struct("ordinal", "error")))), lambda x: x.error)
    return filled.groupBy("row").agg(F.count_if(F.col("status") == "filled").alias("n_filled"), F.count_if(F.col("status") != "filled").alias("n_errors"), errors.alias("errors"))


def output_name(named: Column | None, row: Column) -> Column:
    """A record's file name: the naming column's value, or its place counted from 1 where that is missing or empty."""
    counted = F.concat(F.lit("filled_"), (row + 1).cast("string"), F.lit(".pdf"))
    return counted if named is None else F.when(F.coalesce(named, F.lit("")) != "", F.concat(named, F.lit(".pdf"))).otherwise(counted)


def last_writes(named: DataFrame) -> DataFrame:
    """named: filename, row. filename, the row whose file stays (the last), and how many were written."""
    return named.groupBy("filename").agg(F.max("row").alias("winning_row"), F.count(F.lit(1)).alias("writes"))


def bulk_fill(records: DataFrame, template: DataFrame, filename_column: str | None = None) -> DataFrame:
    """records: row (from 0), record. row, filename, n_filled and kept (whether a later row doesn't overwrite its file)."""
    from pyspark.sql import Window

    name = output_name(F.element_at("record", filename_column) if filename_column else None, F.col("row"))
    named = records.select("row", name.alias("filename"))
    status = fill_status(fill(values(records, "row"), template)).select("row", "n_filled")
    out = named.join(status, "row", "left").withColumn("n_filled", F.coalesce("n_filled", F.lit(0)).cast("long"))
    return out.withColumn("kept", F.col("row") == F.max("row").over(Window.partitionBy("filename")))


def merged_values(base: DataFrame, over: DataFrame) -> DataFrame:
    """Two tables of values() as one: over's values win, base's names keep their places, over's new ones follow, and names that are whole numbers come first."""
    both = base.withColumn("_over", F.lit(False)).unionByName(over.withColumn("_over", F.lit(True)))
    place = F.struct("_over", "ordinal")
    one = both.groupBy("row", "field_name").agg(F.min(place).alias("_place"), F.max_by(F.struct("value", "value_kind"), place).alias("_last"))
    number = F.when(F.col("field_name").rlike(WHOLE), F.col("field_name").cast("long"))
    entry = F.struct(number.isNull().alias("named"), F.coalesce(number, F.lit(0)).alias("number"), "_place", "field_name", "_last")
    rows = one.groupBy("row").agg(F.array_sort(F.collect_list(entry)).alias("_all")).select("row", F.posexplode("_all").alias("ordinal", "e"))
    return rows.select("row", "ordinal", F.col("e.field_name").alias("field_name"), F.col("e._last.value").alias("value"), F.col("e._last.value_kind").alias("value_kind"))


def merge_profiles(profiles: DataFrame, base: str, over: str, out: str = "field_data") -> DataFrame:
    """Adds the merge of two maps of a row; over wins."""
    return profiles.withColumn(out, merged(F.col(base), F.col(over)))
