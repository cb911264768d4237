"""Listings by tasks, files by size, paths of a column."""

from __future__ import annotations

import base64
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerleaf.sources import blobs, files, listing, pdf


@pytest.fixture(params=["true", "false"])
def pushed(request, spark):
    before = spark.conf.get(listing.PUSHDOWN, "false")
    spark.conf.set(listing.PUSHDOWN, request.param)
    yield request.param == "true"
    spark.conf.set(listing.PUSHDOWN, before)


def test_listing(spark, tmp_path, pushed, monkeypatch):
    for n in ("a.pdf", "B.PDF", ".h.pdf", "_u.pdf", "n.txt", "x.jsonb.json", "y.JSON"):
        (tmp_path / n).write_text("12345")
    (tmp_path / "dir.pdf").mkdir()
    (tmp_path / "dir.pdf" / "d.pdf").write_text("")
    names = lambda df: sorted(r["path"].rpartition("/")[2] for r in df.collect())
    for root in (str(tmp_path), f"file://{tmp_path}", f"{tmp_path}/"):
        assert names(listing.list_paths(spark, root)) == [".h.pdf", "B.PDF", "_u.pdf", "a.pdf", "dir.pdf"]
    assert names(listing.list_paths(spark, str(tmp_path), suffix=".json", any_case=False)) == ["x.jsonb.json"]
    both = listing.entries(spark, str(tmp_path), str(tmp_path / "dir.pdf"))
    assert both.count() == 9 and both.rdd.getNumPartitions() == 2
    assert {(r["name"], r["is_directory"], r["size"]) for r in both.where("name = 'a.pdf' or is_directory").collect()} == {("a.pdf", False, 5), ("dir.pdf", True, 0)}
    plan = listing.list_paths(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert ("EndsWith(" not in plan and " Filter " not in plan) == pushed  # nothing is left for Spark to filter where the source does


def test_entries_come_in_batches(tmp_path):
    for k in range(50):
        (tmp_path / f"{k}.pdf").write_text("")
    reader = listing.FilteredEntries([str(tmp_path)])
    reader.suffixes["name"].append("7.pdf")
    listing_size, listing.ENTRIES = listing.ENTRIES, 2
    try:
        batches = list(reader.read(reader.partitions()[0]))
    finally:
        listing.ENTRIES = listing_size
    assert [b.num_rows for b in batches] == [2, 2, 1] and {n for b in batches for n in b.column("name").to_pylist()} == {"7.pdf", "17.pdf", "27.pdf", "37.pdf", "47.pdf"}


def test_resources_by_table(spark, tmp_path):
    rng = random.Random(1)
    data = {f"f{k}": rng.randbytes(rng.choice([0, 10, 100, 5000, 40_000])) for k in range(60)}
    for n, b in data.items():
        (tmp_path / n).write_bytes(b)
    (tmp_path / "dir").mkdir()
    names = [*data, "gone", "dir", "f1", "f1"]
    uris = [f"pdf://{tmp_path}/{n}" for n in names] + ["http://x", None, "pdf://"]
    got = blobs.resource_table(spark.createDataFrame([(u,) for u in uris], "uri string").repartition(3), target=100_000).collect()
    assert sorted(str(r["uri"]) for r in got) == sorted(map(str, uris))
    for r in got:
        name = (r["uri"] or "").rpartition("/")[2]
        if name in data and r["uri"].startswith("pdf"):
            assert base64.b64decode(r["blob"]) == data[name] and (r["mime_type"], r["error"]) == ("application/pdf", None)
        else:
            assert r["blob"] is None and r["mime_type"] is None and r["error"].startswith({"gone": "No such file", "dir": "Not a file", "x": "Unsupported resource URI"}.get(name, ""))


def test_files_are_packed_by_size(spark):
    rng = random.Random(2)
    sizes = [rng.choice([1, 1000, 100_000, 2_000_000]) for _ in range(500)] + [50_000_000]
    df = spark.createDataFrame([(f"p{k}", s) for k, s in enumerate(sizes)], "path string, size long")
    target = 4_000_000
    out = blobs.packed(df, target).withColumn("task", F.spark_partition_id())
    loads = {r["task"]: r["load"] for r in out.groupBy("task").agg((F.sum("size") + blobs.OPENING * F.count("*")).alias("load")).collect()}
    assert out.count() == 501 and max(v for v in loads.values() if v < 50_000_000) <= target + 2_100_000 and len(loads) > sum(sizes[:-1]) // target
    assert blobs.packed(df.limit(0), target).count() == 0


def test_uris_of_paths(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x" * 1152)
    rows = blobs.uri_table(spark.createDataFrame([(f"{tmp_path}/a.pdf",), (f"{tmp_path}/b.pdf",), (None,)], "path string")).collect()
    got = {r["path"]: (r["uri"], r["file"], r["size_kb"], r["error"]) for r in rows}
    assert got[f"{tmp_path}/a.pdf"] == (f"pdf://{tmp_path}/a.pdf", "a.pdf", "1.13", None)
    assert got[f"{tmp_path}/b.pdf"][3] == f"No such file: {tmp_path}/b.pdf" and got[None][3]


def test_paths_of_a_column(spark):
    rng = random.Random(3)
    paths = ["", "~", "~/", "~bob/x", "/", "/a/../b", "a", "./a", "../../a//b/./c/", "s3://b/../k", "a/../../../../../../../../x"] + ["".join(rng.choice(["/", ".", "..", "~", "a", "b"]) for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", files.resolved(F.col("p")).alias("r")).collect()
    slash = lambda p: "/" + p.lstrip("/") if p and p.startswith("//") else p
    for r in rows:
        want = files.resolve(r["p"])
        assert (slash(r["r"]) if "://" not in r["p"] else r["r"]) == (slash(want) if "://" not in r["p"] else want), r["p"]
    assert spark.createDataFrame([(None,)], "p string").select(files.resolved(F.col("p"))).first()[0] is None and os.path.isabs(rows[5]["r"])


def test_workers_hold_few_parsed_forms(spark):
    """What a worker yields at a time doesn't grow with its batch, so its memory is bounded by a few files' contents."""
    import pyarrow as pa

    from ledgerleaf.sources import forms

    data = pdf.made([{"name": "a", "type": "text", "value": "x"}])
    assert [len(p) for p in forms._few(pa.array([data] * 300))] == [128, 128, 44]
    files = spark.createDataFrame([(f"/f{k}.pdf", data) for k in range(300)], "path string, content binary").coalesce(1)
    assert forms.pdf_fields(files).where("field_name = 'a' and text_value = 'x'").select("file").distinct().count() == 300
    assert forms.contents(files).where("pages = 1").count() == 300


def test_parsing_takes_a_match_for_each_token():
    """One pattern finds each token, so a form costs a few times its number of tokens in calls, not its number of bytes."""
    import sys

    data = pdf.made([{"name": f"field number {k}", "type": "dropdown", "options": ["first of all", "second of all"], "value": "second of all"} for k in range(50)])
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found = pdf.form_rows(data)
    finally:
        sys.setprofile(None)
    assert len(found) == 50 and calls < 18_000
