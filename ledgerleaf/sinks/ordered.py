"""One file in a fixed order, written by as many tasks as there are ranges of it.

Every range becomes a part of its own, and its bytes are counted as it is written. Sums of these counts say where each part belongs in the file: on a file
system with random writes tasks copy the parts to their places, a store that can join files joins them itself, and on any other one task, on an
executor, sends them after each other. The file takes its name once it is whole. The driver sees a row for each part, none of the text.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from ..sources.files import store

PART = "table int, part long, name string, size long, rows long"
#: Bytes copied at a time.
PIECE = 8 << 20


def _data(texts: pa.Array) -> memoryview:
    """The bytes of all strings of an array, one after another."""
    _, offsets, data = texts.cast(pa.binary()).buffers()
    if data is None:
        return memoryview(b"")
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return memoryview(data)[int(ends[0]) : int(ends[-1])]


def _parts(df: DataFrame, order: list, text: str, folder: str, table: int) -> DataFrame:
    """Writes df's texts, without anything between them, in parts by ranges of `order`; a row of PART for each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = store(folder)
        part, size, rows, f = TaskContext.get().partitionId(), 0, 0, None
        name = f"{table:03d}-{part:09d}-{uuid.uuid4().hex}"  # an attempt of its own, so one that fails leaves nothing that counts
        for batch in batches:
            if batch.num_rows:
                f = f or fs.open_output_stream(f"{at}/{name}", compression=None)
                data = _data(batch.column(0))
                f.write(data)
                size, rows = size + len(data), rows + batch.num_rows
        if f:
            f.close()
            yield pa.RecordBatch.from_pydict({"table": pa.array([table], pa.int32()), "part": [part], "name": [name], "size": [size], "rows": [rows]})

    return df.repartitionByRange(*order).sortWithinPartitions(*order).select(text).mapInArrow(write, PART)


def _placed(spark: SparkSession, folder: str, parts: list, target: str) -> None:
    """Copies each part to its place in a file of the right size, in tasks; one that runs twice writes the same bytes to the same place."""
    at, rows = 0, []
    for p in parts:
        rows.append((f"{folder}/{p['name']}", at, p["size"]))
        at += p["size"]
    with open(target, "wb") as f:
        f.truncate(at)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = os.open(target, os.O_WRONLY)
                try:
                    with open(row["name"], "rb") as part:
                        place = row["place"]
                        while data := part.read(PIECE):
                            view = memoryview(data)
                            while view:
                                n = os.pwrite(out, view, place)
                                view, place = view[n:], place + n
                    os.fsync(out)
                finally:
                    os.close(out)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    if rows:
        spark.createDataFrame(rows, "name string, place long, size long").repartition(min(len(rows), 4 * spark.sparkContext.defaultParallelism)).mapInArrow(copy, "n long").collect()


def _sent(spark: SparkSession, folder: str, parts: list, target: str) -> None:
    """The parts as one file of a store without random writes: joined by the store, or, if it can't, sent by one task."""
    names = [f"{folder}/{p['name']}" for p in parts]
    jvm = spark._jvm.org.apache.hadoop.fs
    where = jvm.Path(target)
    hadoop = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if hadoop.getScheme() in ("hdfs", "viewfs") and names:
        hadoop.create(where, True).close()
        paths = spark.sparkContext._gateway.new_array(jvm.Path, len(names))
        for i, n in enumerate(names):
            paths[i] = jvm.Path(n)
        hadoop.concat(where, paths)
        return

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fs, at = store(target)
            with fs.open_output_stream(at, compression=None) as out:
                for n in names:
                    part_fs, part = store(n)
                    with part_fs.open_input_stream(part, compression=None) as f:
                        while data := f.read(PIECE):
                            out.write(data)
            yield batch

    spark.range(0, 1, 1, 1).mapInArrow(send, "id long").collect()


def write_ordered(path: str, *tables: tuple[DataFrame, list], text: str = "text") -> list[int]:
    """Writes `text` of the rows of each table (and the columns that it is ordered by), one table after another, as one file; returns how many rows of each.

    Nothing is put between texts. Null and empty texts add nothing. The folder must be shared by all machines. A file that was there is replaced.
    """
    spark = tables[0][0].sparkSession
    ship(spark)
    fs, at = store(path)
    folder, name = os.path.dirname(at), os.path.basename(at)
    own = f".{name}-{uuid.uuid4().hex}"
    scheme = path.partition("://")[0] + "://" if "://" in path else ""
    base = f"{scheme}{folder}" if scheme else folder
    local = isinstance(fs, pyarrow.fs.LocalFileSystem)
    fs.create_dir(f"{folder}/{own}", recursive=True)
    try:
        rows = [r for k, (df, order) in enumerate(tables) for r in _parts(df, order, text, f"{base}/{own}", k).collect()]
        rows.sort(key=lambda r: (r["table"], r["part"]))
        (_placed if local else _sent)(spark, f"{folder}/{own}" if local else f"{base}/{own}", rows, f"{folder if local else base}/{own}.whole")
        fs.move(f"{folder}/{own}.whole", at)
    finally:
        fs.delete_dir(f"{folder}/{own}")
        if fs.get_file_info(f"{folder}/{own}.whole").is_file:
            fs.delete_file(f"{folder}/{own}.whole")
    return [sum(r["rows"] for r in rows if r["table"] == k) for k in range(len(tables))]
