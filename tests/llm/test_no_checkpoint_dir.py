"""Every operator in a session that was started without a checkpoint folder."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

RUN = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__
from ledgerleaf.plans.queries import QUERIES
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
assert not spark.conf.get("spark.checkpoint.dir", "")
data, folder, names = sys.argv[1:4]
if folder:
    spark.sparkContext.setCheckpointDir(folder)
for name, query in __spark_entry__.queries().items():
    if name not in QUERIES and names in ("all", name):
        n = query(spark, data).count()
        assert n, name
        print("ran", name)
assert not spark.conf.get("spark.checkpoint.dir", "")
"""


@pytest.mark.parametrize("folder, names", [(False, "all"), (True, "op7_source_mixing")])
def test_without_the_setting(data, tmp_path, folder, names):
    (tmp_path / "conf").mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "TMPDIR": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", RUN, data, str(tmp_path / "shared") if folder else "", names], cwd=Path(__file__).parents[2], env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-3000:]
    assert out.stdout.count("ran ") == (14 if names == "all" else 1)
    if folder:
        assert any((tmp_path / "shared").rglob("*.parquet"))
