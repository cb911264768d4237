"""Content reports, resources and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base64_line, base_name, has_suffix, is_blank, raster_scale, size_kb, utf16_length, without_first

SCHEME = "pdf://"


def resource_uri(path: Column) -> Column:
    return F.concat(F.lit(SCHEME), path)


def content_stats(files: DataFrame, path: str, text: str, n_bytes: str, pages: str | None = None, *also: str) -> DataFrame:
    """file, size_kb, pages, text_length, is_blank and, for a blank text, the scale at which a picture of it would be taken; then columns of files."""
    kb = size_kb(F.col(n_bytes))
    return files.select(
        base_name(F.col(path)).alias("file"),
        kb.alias("size_kb"),
        (F.col(pages) if pages else F.lit(None)).cast("int").alias("pages"),
        utf16_length(F.coalesce(F.col(text), F.lit(""))).alias("text_length"),
        is_blank(F.col(text)).alias("is_blank"),
        F.when(is_blank(F.col(text)), raster_scale(kb)).alias("scale"),
        *also,
    )


def resources(files: DataFrame, path: str, content: str) -> DataFrame:
    """uri, mime_type and blob of each file."""
    return files.select(resource_uri(F.col(path)).alias("uri"), F.lit("application/pdf").alias("mime_type"), base64_line(F.col(content)).alias("blob"))


def path_of(uri: Column) -> Column:
    """A resource's path; fails for any other scheme."""
    return F.when(uri.startswith(SCHEME), without_first(uri, SCHEME)).otherwise(F.raise_error(F.concat(F.lit("Unsupported resource URI: "), uri)))


def listed(names: DataFrame, column: str, suffix: str = ".pdf", *, any_case: bool = True) -> DataFrame:
    return names.where(has_suffix(F.col(column), suffix, any_case=any_case))


def profile_names(names: DataFrame, column: str) -> DataFrame:
    """Names that end in .json, without their first .json."""
    return names.where(has_suffix(F.col(column), ".json", any_case=False)).select(without_first(F.col(column), ".json").alias("profile_name"))
