"""Directories, profiles and paths."""

from __future__ import annotations

import os

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import has_suffix

PROFILES = os.path.join(os.path.expanduser("~"), ".form-profiles")


class OutsideRoot(ValueError):
    """A name that would leave the directory it belongs to."""


def resolve(path: str | None) -> str | None:
    """~ is the home directory, whatever follows it; relative paths start from the working directory. URIs of other stores stay."""
    if not path or "://" in path:
        return path
    if path.startswith("~"):
        return os.path.normpath(os.path.expanduser("~") + "/" + path[1:])
    return path if os.path.isabs(path) else os.path.abspath(path)


def resolved(path: Column, home: str | None = None, here: str | None = None) -> Column:
    """resolve() of a column. home, here: the home and the working directory, by default the driver's."""
    parts = lambda c: F.filter(F.split(c, "/"), lambda x: ~x.isin("", "."))
    up = lambda done: F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
    walk = lambda c: F.aggregate(parts(c), F.array().cast("array<string>"), lambda done, x: F.when(x == "..", up(done)).otherwise(F.concat(done, F.array(x))))
    full = lambda c: F.concat(F.lit("/"), F.array_join(walk(c), "/"))
    at_home = full(F.concat(F.lit((home or os.path.expanduser("~")) + "/"), F.substring(path, F.lit(2), F.length(path))))
    return F.when((path == "") | path.contains("://") | path.startswith("/"), path).when(path.startswith("~"), at_home).otherwise(full(F.concat(F.lit((here or os.getcwd()) + "/"), path)))


def store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), os.path.abspath(path))


def whole(path: str) -> bytes:
    """A file's bytes, on the driver."""
    fs, at = store(path)
    with fs.open_input_stream(at, compression=None) as f:
        return f.read()


def inside(root: str, name: str) -> str:
    """root/name, or OutsideRoot."""
    if "://" in root:
        scheme, _, rest = root.partition("://")
        return f"{scheme}://{inside('/' + rest.lstrip('/'), name)[0 if rest.startswith('/') else 1 :]}"
    full = os.path.normpath(os.path.join(root, name))
    if os.path.commonpath([os.path.abspath(root), os.path.abspath(full)]) != os.path.abspath(root):
        raise OutsideRoot(name)
    return full


def list_directory(spark: SparkSession, directory: str, suffix: str = ".pdf", *, any_case: bool = True) -> DataFrame:
    """path of each entry, hidden ones and directories included, by suffix, in any store that Spark reads. Reads only the driver's listing."""
    root = resolve(directory)
    if "://" in root:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        found = [x.getPath().getName() for x in path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path)]
    else:
        found = os.listdir(root)
    names = spark.createDataFrame([(n,) for n in found], "name string")
    return names.where(has_suffix(F.col("name"), suffix, any_case=any_case)).select(F.concat(F.lit(root.rstrip("/") + "/"), "name").alias("path"))


def read_bytes(spark: SparkSession, *paths: str) -> DataFrame:
    """path, length, content of files, in any store that Spark reads."""
    return spark.read.format("binaryFile").load(list(paths)).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length", "content")


def profile_path(name: str, root: str = PROFILES) -> str:
    return inside(root, f"{name}.json")


def read_profile(spark: SparkSession, name: str, root: str = PROFILES) -> DataFrame:
    """profile_name, json: the profile's text as it is."""
    return spark.read.text(profile_path(name, root), wholetext=True).select(F.lit(name).alias("profile_name"), F.col("value").alias("json"))
