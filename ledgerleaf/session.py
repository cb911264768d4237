"""A session with the settings that the queries are written for, and the folder that its machines share."""

from __future__ import annotations

import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def session(master: str | None = None, app: str = "ledgerleaf", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()})
    return (builder.master(master) if master else builder).getOrCreate()


#: Folders made up for sessions of one process that have no checkpoint folder, by application.
_made_up: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share, as a URI. Only where all of Spark is this one process is one made up."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not folder and current.isDefined():
        folder = current.get()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        folder = _made_up[app] = _made_up.get(app) or tempfile.mkdtemp(prefix="ledgerleaf-")
    return (folder if "://" in folder else f"file://{folder}").rstrip("/")


#: The folder of each application in the shared one, deleted when its driver ends.
_roots: dict[str, str] = {}


def new_folder(spark: SparkSession, kind: str = "forms") -> str:
    """The URI of a folder in the shared one that nothing else uses and that isn't there yet; it goes when the driver ends, if nothing deletes it before."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = f"{shared_folder(spark)}/ledgerleaf-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(_roots[app])
        fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{_roots[app]}/{kind}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors by way of the shared folder, once for a Spark context, so that they need no copy of their own."""
    context = spark.sparkContext
    if getattr(context, "_ledgerleaf_sent", False):
        return
    root, held = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{new_folder(spark, 'package')}.zip")
    out = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(where, True)
    out.write(held.getvalue())
    out.close()
    context.addPyFile(where.toString())
    context._ledgerleaf_sent = True


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: its lineage is cut, its rows don't change between uses, and Spark knows its size."""
    path = new_folder(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def forget(*tables: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if folder.rpartition("/")[2].startswith("table-"):
                delete_folder(df.sparkSession, folder)
