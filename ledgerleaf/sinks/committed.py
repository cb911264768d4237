"""A file for each row of a table, all of them or none: tasks write attempts, and the commit moves these into place."""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..session import ship
from ..sources.files import inside, store

FORMAT = "ledgerleaf_files"
#: Files that a commit moves at a time.
MOVERS = 32
#: How often a job's folder is tried to be deleted again.
CLEARS = 20


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: its folder, and the names in it by their numbers."""

    folder: str
    names: list[str]


class FilesWriter(DataSourceArrowWriter):
    """Attempts go to a folder of the job's own beside the files; commit() moves the files of tasks that succeeded, abort() deletes the folder. A task that fails or runs
    twice leaves nothing behind, and no file is seen before all are written."""

    def __init__(self, root: str, overwrite: bool):
        """On the driver, where the job's folder is made."""
        self.root, self.overwrite, self.job = root, overwrite, f".job-{uuid.uuid4().hex}"
        fs, at = store(root)
        fs.create_dir(f"{at}/{self.job}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = store(self.root)
        folder, names = f"{root}/{self.job}/{uuid.uuid4().hex}", []
        fs.create_dir(folder, recursive=False)  # fails once the job's folder is gone: tasks may outlive an aborted job
        for batch in iterator:
            for name, data in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                inside(self.root, name)
                with fs.open_output_stream(f"{folder}/{len(names)}", compression=None) as f:
                    f.write(data.as_buffer() if data.is_valid else b"")
                names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = store(self.root)
        moves = [(f"{m.folder}/{k}", f"{root}/{n}") for m in messages if m for k, n in enumerate(m.names)]
        if self.overwrite:  # what was there before and isn't written again goes
            kept = {n for _, n in moves}
            there = [x.path for x in fs.get_file_info(pyarrow.fs.FileSelector(root)) if x.is_file]
            for path in there:
                if path not in kept:
                    fs.delete_file(path)
        for folder in {posixpath.dirname(to) for _, to in moves} - {root}:
            fs.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda m: fs.move(*m), moves))
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, root = store(self.root)
        for left in range(CLEARS, -1, -1):
            try:
                if fs.get_file_info(f"{root}/{self.job}").type != pyarrow.fs.FileType.NotFound:
                    fs.delete_dir(f"{root}/{self.job}")
                return
            except OSError:  # a task that outlives the job has put a file there meanwhile
                if not left:
                    raise
                time.sleep(0.2)


class Files(DataSource):
    """name (below the folder) and content of files; option path: the folder."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], overwrite)


def write_files(rows: DataFrame, folder: str, *, name: str = "name", content: str = "content", order: str | None = None, overwrite: bool = False) -> None:
    """Writes a file for each row into a folder that all machines share, over those of the same name. Of rows that share a name the last one by `order` counts,
    found before anything is written; without an order names must be distinct. A null content is an empty file; a name outside the folder fails the job.
    overwrite deletes the folder's other files."""
    spark = rows.sparkSession
    register(spark)
    picked = rows.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content"), *([F.col(order).alias("_order")] if order else []))
    if order:
        picked = picked.groupBy("name").agg(F.max_by("content", "_order").alias("content"))
    fs, root = store(folder)
    fs.create_dir(root, recursive=True)
    picked.write.format(FORMAT).mode("overwrite" if overwrite else "append").option("path", folder).save()


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(Files)
