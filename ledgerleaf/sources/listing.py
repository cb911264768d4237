"""Directories as tables: each is listed by a task, entry by entry, and suffixes are told to it by Spark's own filters."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition, IsNotNull, StringEndsWith
from pyspark.sql.types import StructType

from ..session import ship
from .files import resolve, store

FORMAT = "ledgerleaf_listing"
SCHEMA = "directory string, name string, lower_name string, is_directory boolean, size long"
COLUMNS = pa.schema([("directory", pa.string()), ("name", pa.string()), ("lower_name", pa.string()), ("is_directory", pa.bool_()), ("size", pa.int64())])
#: Entries that a task holds at a time.
ENTRIES = 8192


@dataclass
class Directory(InputPartition):
    path: str


PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Entries(DataSourceReader):
    """A task for each directory. Local ones are read as an iterator, whatever their number of entries; hidden names and directories are there."""

    def __init__(self, directories: list[str]):
        self.directories = directories
        #: Suffixes that names, as they are or in small letters, must end in.
        self.suffixes: dict[str, list[str]] = {"name": [], "lower_name": []}

    def partitions(self) -> list[Directory]:
        return [Directory(d) for d in self.directories]

    def fits(self, name: str) -> bool:
        return all(name.endswith(s) for s in self.suffixes["name"]) and all(name.lower().endswith(s) for s in self.suffixes["lower_name"])

    def entries(self, directory: str) -> Iterator[tuple[str, bool, int]]:
        """Name, whether a directory, and size; nothing is asked about entries that don't fit."""
        fs, at = store(directory)
        if isinstance(fs, pyarrow.fs.LocalFileSystem):
            with os.scandir(at) as there:
                for e in there:
                    if self.fits(e.name):
                        yield e.name, e.is_dir(), 0 if e.is_dir() else e.stat().st_size
        else:
            for e in fs.get_file_info(pyarrow.fs.FileSelector(at)):
                if self.fits(e.base_name):
                    yield e.base_name, e.type == pyarrow.fs.FileType.Directory, e.size or 0

    def read(self, partition: Directory) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, bool, int]] = []

        def batch() -> pa.RecordBatch:
            names, folders, sizes = map(list, zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * len(held)), pa.array(names), pa.array([n.lower() for n in names]), pa.array(folders), pa.array(sizes, pa.int64())], schema=COLUMNS)

        for entry in self.entries(partition.path):
            held.append(entry)
            if len(held) == ENTRIES:
                yield batch()
                held.clear()
        if held:
            yield batch()


class FilteredEntries(Entries):
    """The same where sessions push filters down, and only there may a reader take them."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, StringEndsWith) and f.attribute[0] in self.suffixes:
                self.suffixes[f.attribute[0]].append(f.value)
            elif not isinstance(f, IsNotNull):  # nothing is null here
                yield f


class Listing(DataSource):
    """Options paths: directories, a line each; pushed: whether the session pushes filters down."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Entries:
        return (FilteredEntries if self.options["pushed"] == "true" else Entries)(self.options["paths"].split("\n"))


def entries(spark: SparkSession, *directories: str) -> DataFrame:
    """directory, name, lower_name, is_directory and size of what directories hold, not of what is below. Filters on the ends of name or lower_name are
    answered by the tasks that list, where spark.sql.python.filterPushdown.enabled is set, as session() does."""
    ship(spark)
    spark.dataSource.register(Listing)
    return spark.read.format(FORMAT).option("pushed", spark.conf.get(PUSHDOWN, "false")).option("paths", "\n".join(resolve(d) or "." for d in directories)).load()


def list_paths(spark: SparkSession, *directories: str, suffix: str = ".pdf", any_case: bool = True) -> DataFrame:
    """path of each entry, hidden ones and directories included, by suffix: files.list_directory() for directories of any size."""
    found = entries(spark, *directories).where(F.col("lower_name").endswith(suffix.lower()) if any_case else F.col("name").endswith(suffix))
    return found.select(F.concat(F.rtrim(F.col("directory"), F.lit("/")), F.lit("/"), "name").alias("path"))
