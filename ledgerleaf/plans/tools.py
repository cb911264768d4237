"""The twelve tools and two resource handlers as functions; each returns a DataFrame unless it says otherwise.

Where a tool takes a password, it is accepted and not used: encrypted files can't be opened with one either and raise PasswordProtected.
"""

from __future__ import annotations

import inspect
import json
import os
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import content, fields, fill, validate
from ..session import forget, stored
from ..sinks import files as sinks
from ..sources import blobs, csv_text, files, forms, listing, pdf

DEFAULT_DIRECTORY = os.path.join(os.path.expanduser("~"), "Documents")


class UnknownTool(ValueError):
    """No tool has this name."""


def list_pdfs(spark: SparkSession, directory: str | None = None) -> DataFrame:
    """The PDF files of a directory, not of those below it."""
    return listing.list_paths(spark, directory or DEFAULT_DIRECTORY)


def read_pdf_fields(spark: SparkSession, pdf_path: str, password: str | None = None) -> DataFrame:
    """name, type, options and current value of each field of a form."""
    return fields.read_fields(forms.read_forms(spark, files.resolve(pdf_path))).orderBy("field_ordinal")


def _values(spark: SparkSession, field_data: Mapping[str, Any]) -> DataFrame:
    rows = []
    numbered = sorted((k for k in field_data if k.isdigit() and str(int(k)) == k and int(k) < 2**32 - 1), key=int)
    for i, k in enumerate([*numbered, *(k for k in field_data if k not in set(numbered))]):
        v = field_data[k]
        kind = "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "json"
        text = None if v is None else v if isinstance(v, str) else str(int(v)) if isinstance(v, float) and v.is_integer() else json.dumps(v)
        rows.append((0, i, k, text, kind))
    return spark.createDataFrame(rows, "row long, ordinal int, field_name string, value string, value_kind string")


def fill_pdf(spark: SparkSession, pdf_path: str, output_path: str, field_data: Mapping[str, Any], password: str | None = None) -> DataFrame:
    """Writes one filled form; returns row, n_filled, n_errors, errors."""
    path = files.resolve(pdf_path)
    done = fill.fill(_values(spark, field_data), forms.read_forms(spark, path))
    rows = done.collect()  # one form's fields
    sinks.put(files.resolve(output_path), pdf.filled(files.whole(path), {r["field_name"]: r["new_value"] for r in rows if r["status"] == "filled"}))
    return fill.fill_status(done)


def bulk_fill_from_csv(spark: SparkSession, pdf_path: str, csv_path: str, output_directory: str, filename_column: str | None = None, password: str | None = None) -> DataFrame:
    """Writes a form for each record; returns row, filename, n_filled, kept and error."""
    path = files.resolve(pdf_path)
    records = csv_text.read(spark, files.resolve(csv_path)).select("row", "record")
    template = forms.read_forms(spark, path)
    names = fill.bulk_fill(records, template, filename_column)
    written = sinks.write_forms(fill.fill(fill.values(records, "row"), template), names, files.whole(path), files.resolve(output_directory))
    return names.join(written, "filename", "left").orderBy("row")


def save_profile(profile_name: str, field_data: Mapping[str, Any], root: str = files.PROFILES) -> str:
    """Saves field data as a profile, over any other of the name; returns the path written."""
    return sinks.write_profile(profile_name, dict(field_data), root)


def save_profiles(profiles: DataFrame, root: str = files.PROFILES, *, order: str | None = None) -> None:
    """Saves a table of profiles (profile_name, json), a file for each, written by the executors; of rows that share a name the last by `order` counts."""
    sinks.write_profiles(profiles, root, order=order)


def load_profile(spark: SparkSession, profile_name: str, root: str = files.PROFILES) -> DataFrame:
    """A profile's text as it was saved."""
    return files.read_profile(spark, profile_name, root)


def load_profiles(spark: SparkSession, root: str = files.PROFILES) -> DataFrame:
    """profile_name and json of all profiles of a folder."""
    held = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(files.resolve(root))
    name = F.element_at(F.split("path", "/"), -1)
    return held.select(F.substring(name, F.lit(1), F.length(name) - 5).alias("profile_name"), F.decode("content", "UTF-8").alias("json"))


def fill_with_profiles(requests: DataFrame, profiles: DataFrame, template: DataFrame) -> DataFrame:
    """fill_with_profile of a table: requests (row, profile_name, additional_data, the JSON of an object or null), profiles (profile_name, json) and
    the form_fields of one form. row, n_filled, n_errors and errors of each request. Additional data wins; a profile that isn't there fails the job."""
    known = requests.join(profiles.withColumn("_there", F.lit(True)), "profile_name", "left")
    json_text = F.when(F.col("_there"), F.col("json")).otherwise(F.raise_error(F.concat(F.lit("No such profile: "), "profile_name")))
    base = fill.json_values(known.select("row", json_text.alias("field_data")), "row")
    more = fill.json_values(requests.select("row", F.coalesce("additional_data", F.lit("{}")).alias("field_data")), "row")
    done = fill.fill_status(fill.fill(fill.merged_values(base, more), template))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return requests.select("row").join(done, "row", "left").select("row", zero("n_filled"), zero("n_errors"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))


def list_profiles(spark: SparkSession, root: str = files.PROFILES) -> DataFrame:
    """The names of saved profiles."""
    names = listing.list_paths(spark, root, suffix=".json", any_case=False)
    return content.profile_names(names.select(F.element_at(F.split("path", "/"), -1).alias("name")), "name")


def fill_with_profile(spark: SparkSession, pdf_path: str, output_path: str, profile_name: str, additional_data: Mapping[str, Any] | None = None, password: str | None = None, root: str = files.PROFILES) -> DataFrame:
    """Fills a form with a saved profile; additional data wins."""
    profile = json.loads(load_profile(spark, profile_name, root).first()["json"])
    return fill_pdf(spark, pdf_path, output_path, profile | dict(additional_data or {}))


def extract_to_csv(spark: SparkSession, pdf_paths: list[str], output_csv: str) -> DataFrame:
    """Writes one CSV; returns n_forms (paths, repeated ones too) and n_fields. A path given twice is a form of its own each time."""
    base = [files.resolve(p) for p in pdf_paths]
    listed = spark.createDataFrame([(i, p) for i, p in enumerate(base)], "n int, path string")
    rows = stored(fields.batch(listed, forms.read_forms(spark, *dict.fromkeys(base))))  # each file is parsed once, whatever follows
    n_forms, n_fields = sinks.write_csv(rows, files.resolve(output_csv))
    forget(rows)
    return spark.createDataFrame([(n_forms, n_fields)], "n_forms int, n_fields long")


def extract_table_to_csv(paths: DataFrame, fields_: DataFrame, output_csv: str) -> DataFrame:
    """The same of a table of paths (n, path) and the form_fields of the forms that they name."""
    rows = stored(fields.batch(paths, fields_))
    n_forms, n_fields = sinks.write_csv(rows, files.resolve(output_csv))
    forget(rows)
    return paths.sparkSession.createDataFrame([(n_forms, n_fields)], "n_forms long, n_fields long")


def validate_pdf(spark: SparkSession, pdf_path: str, password: str | None = None) -> DataFrame:
    """Counts of a form's fields, and which are empty or required and empty."""
    return validate.validate(forms.read_forms(spark, files.resolve(pdf_path)))


def read_pdf_content(spark: SparkSession, pdf_path: str) -> DataFrame:
    """file, size_kb, pages, text_length, is_blank, scale, text, error. Pages without text are not drawn; see pdf.raster."""
    read = forms.contents(files.read_bytes(spark, files.resolve(pdf_path)))
    return content.content_stats(read, "path", "text", "n_bytes", "pages", "text", "error")


def get_pdf_resource_uri(spark: SparkSession, pdf_path: str) -> DataFrame:
    """The URI under which read_resource gives a file."""
    path = files.resolve(pdf_path)
    fs, at = files.store(path)
    size = fs.get_file_info(at).size
    if size is None:
        raise FileNotFoundError(path)
    return spark.range(1).select(content.resource_uri(F.lit(path)).alias("uri"), F.lit(os.path.basename(path)).alias("file"), content.size_kb(F.lit(size)).alias("size_kb"))


def list_resources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "uri string, name string, mime_type string")


def read_resource(spark: SparkSession, uri: str) -> DataFrame:
    if not uri.startswith(content.SCHEME):
        raise ValueError(f"Unsupported resource URI: {uri}")
    path = files.resolve(uri.replace(content.SCHEME, "", 1))
    return content.resources(files.read_bytes(spark, path), "path", "content").withColumn("uri", F.lit(uri))


def read_resources(uris: DataFrame) -> DataFrame:
    """read_resource of a table of URIs (uri): uri, mime_type, blob and error, large and small files in tasks of like size."""
    return blobs.resource_table(uris)


def get_pdf_resource_uris(paths: DataFrame) -> DataFrame:
    """get_pdf_resource_uri of a table of paths (path): path, uri, file, size_kb and error."""
    return blobs.uri_table(paths)


TOOLS = {f.__name__: f for f in (list_pdfs, read_pdf_fields, fill_pdf, bulk_fill_from_csv, save_profile, load_profile, list_profiles, fill_with_profile, extract_to_csv, validate_pdf, read_pdf_content, get_pdf_resource_uri)}


#: The JSON schema of what a parameter takes, by how it is annotated here.
_SCHEMAS = {"str": {"type": "string"}, "list[str]": {"type": "array", "items": {"type": "string"}}, "Mapping[str, Any]": {"type": "object", "additionalProperties": True}}


def _schema(tool: Any) -> dict:
    """What a tool takes as JSON schema: an object of its parameters, those without a default required."""
    taken = {k: p for k, p in inspect.signature(tool).parameters.items() if k not in ("spark", "root")}
    properties = {k: _SCHEMAS[str(p.annotation).removesuffix(" | None")] | {"description": k.replace("_", " ")} for k, p in taken.items()}
    return {"type": "object", "properties": properties, "required": [k for k, p in taken.items() if p.default is p.empty]}


#: What each tool does and takes, by name.
CATALOGUE = {name: {"name": name, "description": (inspect.getdoc(f) or "").split("\n")[0], "inputSchema": _schema(f)} for name, f in TOOLS.items()}


def call(name: str, *args: Any, **kwargs: Any) -> Any:
    """Runs a tool by name."""
    if name not in TOOLS:
        raise UnknownTool(f"Unknown tool: {name}")
    return TOOLS[name](*args, **kwargs)


def respond(name: str, *args: Any, **kwargs: Any) -> Any:
    """Runs a tool by name; an error becomes the text that a caller is shown."""
    try:
        return call(name, *args, **kwargs)
    except Exception as e:  # whatever went wrong is the answer
        return f"Error: {e}"
