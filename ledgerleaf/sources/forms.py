"""Tables of form fields, from PDF files or from the columns of any table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import FORM_FIELDS
from ..session import ship
from . import pdf
from .files import read_bytes

_FIELD = pa.struct([("field_ordinal", pa.int32()), ("field_name", pa.string()), ("field_type", pa.string()), ("options", pa.list_(pa.string())), ("text_value", pa.string()), ("checked", pa.bool_()), ("selected", pa.list_(pa.string())), ("read_error", pa.string())])
_FIELDS = "array<struct<field_ordinal:int,field_name:string,field_type:string,options:array<string>,text_value:string,checked:boolean,selected:array<string>,read_error:string>>"


#: Files whose parsed contents a worker holds at a time, whatever the batches' size.
FEW = 128


def _few(batch: pa.Array) -> Iterator[pa.Array]:
    return (batch.slice(k, FEW) for k in range(0, len(batch), FEW))


def pdf_fields(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """form_fields of files' bytes, a task for each batch of files; a form without fields is one row without a name. A file that can't be read fails
    the job with the reason."""
    ship(files.sparkSession)

    @F.arrow_udf(_FIELDS)
    def parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in _few(batch):
                yield pa.array([pdf.form_rows(x.as_py()) for x in part], pa.list_(_FIELD))

    rows = files.select(F.col(path).alias("file"), F.explode_outer(parsed(content)).alias("f"))
    return rows.select("file", "f.*")


def read_forms(spark: SparkSession, *paths: str) -> DataFrame:
    return pdf_fields(read_bytes(spark, *paths))


def contents(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, n_bytes, pages, text and error of files; what can't be read has an error instead of failing."""
    ship(files.sparkSession)

    @F.arrow_udf("struct<pages:int,text:string,error:string>")
    def parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in (p for batch in batches for p in _few(batch)):
            pages, texts, errors = [], [], []
            for x in part:
                try:
                    found = pdf.page_texts(x.as_py())
                    pages.append(len(found)), texts.append("\n\n".join(found)), errors.append(None)
                except (ValueError, KeyError, TypeError) as e:
                    pages.append(None), texts.append(None), errors.append(str(e) or type(e).__name__)
            yield pa.StructArray.from_arrays([pa.array(pages, pa.int32()), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["pages", "text", "error"])

    rows = files.select(F.col(path).alias("path"), F.octet_length(content).cast("long").alias("n_bytes"), parsed(content).alias("c"))
    return rows.select("path", "n_bytes", "c.*")


def field(name: str, kind: str, value: Column | None = None, options: list[str] | None = None) -> Column:
    """A column as a field of the form that its row stands for. A dropdown's null is an unread selection."""
    null = F.lit(None)
    text = value.cast("string") if value is not None and kind in ("text", "radio") else null
    return F.struct(
        F.lit(name).alias("field_name"),
        F.lit(kind).alias("field_type"),
        (F.array(*map(F.lit, options)) if options else null).cast("array<string>").alias("options"),
        text.cast("string").alias("text_value"),
        (value.cast("boolean") if value is not None and kind == "checkbox" else null).cast("boolean").alias("checked"),
        (F.when(value.isNotNull(), F.array(value.cast("string"))) if value is not None and kind == "dropdown" else null).cast("array<string>").alias("selected"),
        null.cast("string").alias("read_error"),
    )


def from_table(rows: DataFrame, file: Column, fields: list[Column], *, some: bool = False) -> DataFrame:
    """form_fields of a table whose rows stand for forms. some: null fields are ones that the form lacks, and a form that lacks all is one row without a name."""
    long = rows.select(file.cast("string").alias("file"), F.posexplode_outer(F.array_compact(F.array(*fields))).alias("field_ordinal", "f")) if some else rows.select(file.cast("string").alias("file"), F.posexplode(F.array(*fields)).alias("field_ordinal", "f"))
    return long.select("file", "field_ordinal", "f.*")


def layout(spark: SparkSession) -> DataFrame:
    """An empty form_fields."""
    return spark.createDataFrame([], FORM_FIELDS)
