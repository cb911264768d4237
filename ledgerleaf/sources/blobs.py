"""Files that a table names: what they hold, dealt by how large they are."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions.text import base64_line, base_name, size_kb
from ..operators.content import SCHEME, resource_uri
from ..session import ship, stored
from .files import resolved, store

#: Bytes of files that one task is meant to read.
PACK = 64 << 20
#: What opening a file counts for, in bytes, so that a task doesn't get millions of empty ones.
OPENING = 64 << 10


def stats(paths: DataFrame, path: str = "path") -> DataFrame:
    """paths and size, and error where there is no such file."""
    ship(paths.sparkSession)

    @F.arrow_udf("struct<size:long,error:string>")
    def looked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes, errors = [], []
            for p in batch.to_pylist():
                size = error = None
                try:
                    fs, at = store(p or "")
                    info = fs.get_file_info(at)
                    if info.type == pyarrow.fs.FileType.File:
                        size = info.size
                    else:
                        error = f"{'No such file' if info.type == pyarrow.fs.FileType.NotFound else 'Not a file'}: {p}"
                except (OSError, ValueError) as e:
                    error = str(e) or type(e).__name__
                sizes.append(size), errors.append(error)
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(errors, pa.string())], ["size", "error"])

    return paths.withColumn("_stat", looked(path)).select(*paths.columns, "_stat.size", "_stat.error")


def packed(files: DataFrame, target: int = PACK) -> DataFrame:
    """files (with size) in tasks of about `target` bytes each; a larger file has a task for itself. Which task a file goes to is read off a running sum of sizes,
    taken within ranges of a hash of the path and then over the ranges, of which there are as many as partitions."""
    cost = F.coalesce("size", F.lit(0)) + OPENING
    ranged = stored(files.withColumn("_hash", F.xxhash64("path")).repartitionByRange("_hash").withColumn("_part", F.spark_partition_id()).withColumn("_cost", cost))
    sums = ranged.groupBy("_part").agg(F.sum("_cost").alias("cost"))
    total = sums.agg(F.sum("cost")).first()[0] or 0
    packs = max(1, -(-total // target))
    before = F.coalesce(F.sum("cost").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("_cost").over(Window.partitionBy("_part").orderBy("_hash", "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = ranged.withColumn("_within", within).join(sums.select("_part", before.alias("_before")), "_part")
    middle = F.col("_before") + F.col("_within") + F.col("_cost") / 2
    out = out.withColumn("_pack", F.least(F.floor(middle / target), F.lit(packs - 1)).cast("int"))
    return out.repartitionById(packs, "_pack").select(*files.columns)


def contents(files: DataFrame) -> DataFrame:
    """files (path, size, error and others), and content: one file at a time, so a task holds no more than one. What can't be read has an error."""
    schema = StructType([*files.schema.fields, StructField("content", BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            error = batch.schema.get_field_index("error")
            for i, (path, failed) in enumerate(zip(batch.column("path").to_pylist(), batch.column("error").to_pylist(), strict=True)):
                data = None
                if failed is None:
                    try:
                        fs, at = store(path)
                        with fs.open_input_stream(at, compression=None) as f:
                            data = f.read()
                    except OSError as e:
                        failed = str(e) or type(e).__name__
                columns = batch.slice(i, 1).columns
                columns[error] = pa.array([failed], pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array([data], pa.binary())], [*batch.schema.names, "content"])

    return files.mapInArrow(read, schema)


def resource_table(uris: DataFrame, uri: str = "uri", *, target: int = PACK) -> DataFrame:
    """uri, mime_type, blob and error of each row of a table of URIs, repeated ones too. A URI of another scheme, or of a file that isn't there or can't be read, is a row with
    an error instead of a blob; each file is read once."""
    here = F.col(uri)
    asked = uris.select(here.alias("uri")).withColumn("path", F.when(F.startswith(F.col("uri"), F.lit(SCHEME)), resolved(F.substring(F.col("uri"), F.lit(len(SCHEME) + 1), F.length("uri")))))
    known = stats(asked.where("path is not null").select("path").distinct())
    read = contents(packed(known, target)).select("path", "error", base64_line(F.col("content")).alias("blob"))
    out = asked.join(read, "path", "left")
    error = F.when(F.col("path").isNull(), F.concat(F.lit("Unsupported resource URI: "), F.coalesce("uri", F.lit("null")))).otherwise(F.col("error"))
    return out.select("uri", F.when(error.isNull(), "application/pdf").alias("mime_type"), "blob", error.alias("error"))


def uri_table(paths: DataFrame, path: str = "path") -> DataFrame:
    """path, uri, file, size_kb and error of each row of a table of paths."""
    known = stats(paths.select(F.col(path).alias("path")).withColumn("full", resolved(F.col("path"))), "full")
    there = F.col("error").isNull()
    return known.select("path", F.when(there, resource_uri(F.col("full"))).alias("uri"), F.when(there, base_name(F.col("full"))).alias("file"), F.when(there, size_kb(F.col("size"))).alias("size_kb"), "error")
