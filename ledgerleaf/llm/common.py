"""Helpers that the training-data operators share."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere in this subpackage: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator is about to add; names compare without case, so an input's clashing column gives way."""
    drop = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in drop])


def unused(df: DataFrame, *names: str) -> list[str]:
    """names that df has no columns of, each with as many underscores behind it as that takes, for an operator's own columns."""
    there, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in there:
            n += "_"
        there.add(n.lower())
        out.append(n)
    return out


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


#: Rows and bytes that go to a Python worker at a time, at most; a session's lower limits stay.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors by way of the shared folder, once for a Spark context, so that they need no copy of their own."""
    context = spark.sparkContext
    if getattr(context, "_ledgerleaf_sent", False):
        return
    root, held = Path(__file__).resolve().parent.parent, io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    path = f"{shared_dir(spark).rstrip('/')}/ledgerleaf-{uuid.uuid4().hex}.zip"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(where, True)
    out.write(held.getvalue())
    out.close()
    context.addPyFile(path)
    context._ledgerleaf_sent = True


def small_batches(spark: SparkSession) -> None:
    """Bounds what Python workers hold, whatever the texts' lengths; sees to it that they find this package."""
    ship(spark)
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    for name, most in ((rows, BATCH_ROWS), (size, BATCH_BYTES)):
        now = re.fullmatch(r"(-?\d+)([kmg]?)b?", spark.conf.get(name).lower())
        if not now or not 0 < int(now[1]) * {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[now[2]] <= most:
            spark.conf.set(name, str(most))


#: The folder made up for a session without one, by application. The setting itself can't be changed in a running session.
_made_up: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share. Only where all of Spark is this one process, as in tests, is one made up."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if folder:
        return folder
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _made_up:
        _made_up[app] = f"file://{tempfile.mkdtemp(prefix='ledgerleaf-')}"
    return _made_up[app]


#: Folders that stored() wrote and nothing has deleted yet, in order, by application.
_written: dict[str, list[str]] = {}


def stored(df: DataFrame, *, compression: str = "zstd") -> DataFrame:
    """Cuts df's lineage: written as Parquet in the shared folder and read again, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/ledgerleaf-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes what stored() wrote, for tables that nothing reads any more."""
    for df in tables:
        forget_paths(df.sparkSession, list({f.rpartition("/")[0] for f in df.inputFiles() if "/ledgerleaf-" in f}))


def forget_paths(spark: SparkSession, paths: list[str]) -> None:
    held, names = _written.get(spark.sparkContext.applicationId, []), {p.rpartition("/")[2] for p in paths}
    held[:] = [p for p in held if p.rpartition("/")[2] not in names]
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def written(spark: SparkSession) -> list[str]:
    """What stored() wrote in this application and nothing has deleted, in order. Operators' results read some of it, so it can go once they are
    written: forget_paths(spark, written(spark)[n:]) for all since there were n."""
    return list(_written.get(spark.sparkContext.applicationId, []))


def by_bytes(texts: list, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of a list of str, bytes or None whose lengths add up to about limit; a longer element stands alone."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def join_alike(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which nulls are alike; the key columns come from the left side."""
    there = right.withColumnsRenamed({n: f"_right_{n}" for n in names})
    on = [left[n].eqNullSafe(there[f"_right_{n}"]) for n in names]
    return left.join(there, on, how).drop(*[f"_right_{n}" for n in names])
