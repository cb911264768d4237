"""Writers. Each file is written whole and then moved into place, so a task that runs twice leaves one file."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import EXTRACT_NAME
from ..operators.fields import numbered_names, sparse_lines
from ..session import forget, ship
from ..sources import pdf
from ..sources.files import PROFILES, inside, profile_path, store
from .committed import write_files
from .ordered import write_ordered


@contextmanager
def opened(path: str):
    """A stream to a new file, which takes its place once it is whole, in any store that Arrow writes."""
    fs, at = store(path)
    folder = posixpath.dirname(at)
    fs.create_dir(folder, recursive=True)
    part = f"{folder}/.{uuid.uuid4().hex}"
    try:
        with fs.open_output_stream(part, compression=None) as f:
            yield f
        fs.move(part, at)
    except BaseException:
        if fs.get_file_info(part).is_file:
            fs.delete_file(part)
        raise


def put(path: str, data: bytes) -> None:
    with opened(path) as f:
        f.write(data)


def _header(names: DataFrame) -> DataFrame:
    """position and text: the first line in pieces, not quoted."""
    start = names.sparkSession.createDataFrame([(-1, EXTRACT_NAME)], "position long, text string")
    return start.unionByName(names.select("position", F.concat(F.lit(","), "field_name").alias("text")))


def write_csv(fields: DataFrame, path: str) -> tuple[int, int]:
    """Writes the extracted table as one file, header first, forms in order of their names; returns how many forms and how many distinct names.

    Both the header and the lines are written by as many tasks as there are ranges of them, which also count them, so there is no limit to either and no job
    for the counts.
    """
    names = numbered_names(fields)
    n_names = names.count()
    head = _header(names)
    lines = sparse_lines(fields, names, n_names).select("file", F.concat(F.lit("\n"), "line").alias("text"))
    _, n_forms = write_ordered(path, (head, [F.col("position")]), (lines, [F.col("file")]))
    forget(names)
    return n_forms, n_names


def write_csv_parts(fields: DataFrame, directory: str) -> None:
    """The same lines as a directory of text files, written by the executors, in no order; the header alone is in one of its own."""
    names = numbered_names(fields)
    sparse_lines(fields, names, names.count()).select("line").write.mode("overwrite").text(f"{directory.rstrip('/')}/lines")
    write_ordered(f"{directory.rstrip('/')}/header.csv", (_header(names), [F.col("position")]))
    forget(names)


def write_profiles(profiles: DataFrame, root: str = PROFILES, *, name: str = "profile_name", json_text: str = "json", order: str | None = None) -> None:
    """Saves the profiles of a table, a file for each, over others of their names: written by tasks, in place once all are written. json_text is what a
    file holds. Of rows that share a name the last by `order` counts."""
    write_files(profiles.select(F.concat(F.col(name), F.lit(".json")).alias("name"), F.encode(F.col(json_text), "UTF-8").alias("content"), *([F.col(order).alias("_order")] if order else [])), root, order="_order" if order else None)


def write_profile(name: str, field_data: dict, root: str = PROFILES) -> str:
    path = profile_path(name, root)
    put(path, json.dumps(field_data, indent=2, ensure_ascii=False).encode())
    return path


def write_forms(filled: DataFrame, names: DataFrame, template: bytes, directory: str) -> DataFrame:
    """filled: operators.fill.fill(); names: row, filename, kept. Writes the template, filled, for each row that no later one overwrites,
    into a directory that all executors share. Returns filename and error, null where the file was written."""
    pairs = F.collect_list(F.when((F.col("status") == "filled") & F.col("new_value").isNotNull(), F.struct("field_name", "new_value")))
    rows = names.where("kept").join(filled.groupBy("row").agg(pairs.alias("values")), "row", "left").select("filename", "values")
    ship(filled.sparkSession)
    sent = filled.sparkSession.sparkContext.broadcast(template)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, errors = [], []
            for row in batch.to_pylist():
                try:
                    put(inside(directory, row["filename"]), pdf.filled(sent.value, {v["field_name"]: v["new_value"] for v in row["values"] or []}))
                    errors.append(None)
                except (ValueError, OSError) as e:
                    errors.append(str(e) or type(e).__name__)
                done.append(row["filename"])
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()), pa.array(errors, pa.string())], ["filename", "error"])

    return rows.mapInArrow(write, "filename string, error string")
