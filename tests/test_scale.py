"""What is split over tasks gives what one task gave: CSV in byte ranges, one file by many writers, files that are committed, headers without a list."""

from __future__ import annotations

import os
import random

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_csv import CASES

from ledgerleaf.model import FORM_FIELDS
from ledgerleaf.operators import fields, fill, validate
from ledgerleaf.plans import tools
from ledgerleaf.sinks import committed, ordered
from ledgerleaf.sinks import files as sinks
from ledgerleaf.sources import csv_text, forms, pdf


@pytest.fixture
def ranges(spark):
    """Sets the size of the byte ranges in which Spark reads files."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def set_(size: int) -> None:
        for n in names:
            spark.conf.set(n, str(size))

    yield set_
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def records(spark, *paths):
    out: dict[str, list] = {}
    for r in csv_text.read(spark, *paths).orderBy("file", "row").collect():
        held = out.setdefault(r["file"].rpartition("/")[2], [])
        assert r["row"] == len(held)
        held.append(r["record"])
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 1 << 20])
def test_csv_cases_in_byte_ranges(spark, tmp_path, ranges, size):
    paths = []
    for k, (text, _) in CASES.items():
        if text is not None:
            paths.append(str(tmp_path / f"{k}.csv"))
            (tmp_path / f"{k}.csv").write_bytes(text.encode())
    ranges(size)
    got = records(spark, *paths)
    assert {k: got.get(f"{k}.csv", []) for k, (text, _) in CASES.items() if text is not None} == {k: want for k, (text, want) in CASES.items() if text is not None}


@pytest.mark.parametrize("size", [7, 64, 999])
def test_random_csv_in_byte_ranges(spark, tmp_path, ranges, size):
    rng = random.Random(size)
    for k in range(4):
        cell = lambda: "".join(rng.choice("ab,é \t") for _ in range(rng.randrange(6)))
        lines = [rng.choice(["", " ", "﻿"]) for _ in range(rng.randrange(3))] + ["h1, h2 ,h1"] + [rng.choice([cell(), "", ",".join(cell() for _ in range(4))]) + rng.choice(["", "\r"]) for _ in range(40)]
        (tmp_path / f"{k}.csv").write_bytes(("\n".join(lines) + "\n" * rng.randrange(4)).encode())
    texts = [(f"{k}.csv", (tmp_path / f"{k}.csv").read_bytes().decode()) for k in range(4)]
    want: dict[str, list] = {}
    for r in csv_text.records(spark.createDataFrame(texts, "f string, t string"), "f", "t").orderBy("f", "row").collect():
        want.setdefault(r["f"], []).append(r["record"])
    ranges(size)
    assert records(spark, str(tmp_path)) == want
    lines = csv_text.numbered_lines(spark, str(tmp_path)).orderBy("file", "number").collect()
    strip = lambda t: t.encode().removeprefix("﻿".encode()).decode()  # noqa: E731  the reader's own
    for name, text in texts:
        mine = [r for r in lines if r["file"].endswith(f"/{name}")]
        assert [r["number"] for r in mine] == list(range(len(mine)))
        assert [strip(r["line"]) for r in mine] == [strip(x) for x in (text[:-1] if text.endswith("\n") else text).split("\n")]


def test_lines_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2")
    df = csv_text.read(spark, str(tmp_path / "a.csv"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("far", [False, True])
def test_one_file_by_many_writers(spark, tmp_path, monkeypatch, far):
    rng = random.Random(5)
    rows = [(k, rng.choice(["", None, "é", "x" * rng.randrange(500)])) for k in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, text string").repartition(7)
    if far:  # a store without random writes
        monkeypatch.setattr(ordered, "_placed", ordered._sent)
    out = tmp_path / "d" / "o.txt"
    for _ in range(2):
        n = ordered.write_ordered(f"file://{out}", (spark.createDataFrame([(1, "head|")], "p int, text string"), [F.col("p")]), (df, [F.col("k")]))
        assert n == [1, 400] and out.read_text(encoding="utf-8") == "head|" + "".join(t or "" for _, t in sorted(rows))
    assert os.listdir(tmp_path / "d") == ["o.txt"]
    assert ordered.write_ordered(str(tmp_path / "none"), (df.where("false"), [F.col("k")])) == [0] and (tmp_path / "none").read_bytes() == b""


def test_a_failed_writer_leaves_what_was_there(spark, tmp_path):
    (tmp_path / "o").write_text("before")
    df = spark.range(50).select("id", F.when(F.col("id") == 30, F.raise_error(F.lit("no"))).otherwise("x").alias("text"))
    with pytest.raises(PySparkException):
        ordered.write_ordered(str(tmp_path / "o"), (df, [F.col("id")]))
    assert os.listdir(tmp_path) == ["o"] and (tmp_path / "o").read_text() == "before"


def text_forms(spark, rows):
    return spark.createDataFrame([(f, k, n, "text" if n is not None else None, None, v, None, None, None) for f, k, n, v in rows], FORM_FIELDS)


def test_csv_by_many_writers(spark, tmp_path):
    rng = random.Random(8)
    names = ["a", "A", "z,y", 'q"', "_filename", "￿", "\U0001f600", "é", ""]
    rows = [(f"d/f{k:03d}", i, n, rng.choice([None, "", "v", 'w"w', "日本"])) for k in range(60) for i, n in enumerate(rng.choices(names, k=rng.randrange(1, 9)))] + [("d/none", None, None, None)]
    df = text_forms(spark, rows).repartition(5)
    n = sinks.write_csv(df, str(tmp_path / "o.csv"))
    used = fields.header(df)
    assert n == (61, len(used)) and used.index("\U0001f600") < used.index("￿")
    want = [fields.header_line(used), *[r["line"] for r in fields.extract_lines(df, used).orderBy("file").collect()]]
    assert (tmp_path / "o.csv").read_text(encoding="utf-8").split("\n") == want
    without = df.where("field_name <> '_filename' or field_name is null")
    sinks.write_csv(without, str(tmp_path / "p.csv"))
    assert (tmp_path / "p.csv").read_text(encoding="utf-8").split("\n")[-1] == '"none"' + ',""' * (len(used) - 1)


def test_a_million_names(spark, tmp_path):
    """Neither the header nor the names of a form pass the driver, and the plan has no expression for each."""
    n = 1_000_000
    null = F.lit(None)
    rows = spark.range(n).select((F.col("id") % 3).cast("string").alias("file"), F.col("id").cast("int").alias("field_ordinal"), F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("field_name"), F.lit("text").alias("field_type"), null.cast("array<string>").alias("options"), F.lit("v").alias("text_value"), null.cast("boolean").alias("checked"), null.cast("array<string>").alias("selected"), null.cast("string").alias("read_error"))
    assert sinks.write_csv(rows, str(tmp_path / "o.csv")) == (3, n)
    head, *lines = (tmp_path / "o.csv").read_text().split("\n")
    assert head == "_filename," + ",".join(f"n{i:07d}" for i in range(n))
    for k, line in enumerate(lines):
        assert line == f'"{k}"' + "".join(',"v"' if i % 3 == k else ',""' for i in range(n))
    assert len(fields.sparse_lines(rows, fields.numbered_names(rows), n)._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def profiles(spark, n=20):
    return spark.createDataFrame([(i, f"p{i % 7}", f'{{"i": {i}}}') for i in range(n)], "i int, profile_name string, json string").repartition(4)


def test_committed_files(spark, tmp_path):
    root = str(tmp_path / "p")
    tools.save_profile("p3", {"old": 1}, root), tools.save_profile("kept", {}, root)
    tools.save_profiles(profiles(spark), f"file://{root}", order="i")
    assert {p.name: p.read_text() for p in (tmp_path / "p").iterdir()} == {f"p{k}.json": f'{{"i": {max(i for i in range(20) if i % 7 == k)}}}' for k in range(7)} | {"kept.json": "{}"}
    committed.write_files(spark.createDataFrame([("a/b", b"1"), ("c", None)], "name string, content binary"), root, overwrite=True)
    assert sorted(p.name for p in (tmp_path / "p").iterdir()) == ["a", "c"] and (tmp_path / "p" / "a" / "b").read_bytes() == b"1" and (tmp_path / "p" / "c").read_bytes() == b""


@pytest.mark.parametrize("bad", ["../out", "fail"])
def test_a_failed_task_leaves_nothing(spark, tmp_path, bad):
    rows = spark.range(40).select(F.when(F.col("id") == 33, F.lit("../out") if bad == "../out" else F.raise_error(F.lit("no")).cast("string")).otherwise(F.col("id").cast("string")).alias("name"), F.lit(b"x").alias("content")).repartition(8)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1").write_text("before")
    with pytest.raises(PySparkException):
        committed.write_files(rows, str(tmp_path / "d"))
    assert os.listdir(tmp_path / "d") == ["1"] and (tmp_path / "d" / "1").read_text() == "before" and os.listdir(tmp_path) == ["d"]


def test_attempts_that_are_not_committed_go(tmp_path):
    """A task that ran twice, and an executor that was lost while it wrote."""
    writer = committed.FilesWriter(str(tmp_path), False)
    batch = lambda v: pa.RecordBatch.from_pydict({"name": ["a", "b"], "content": [v, v]})
    first, _ = writer.write(iter([batch(b"1")])), writer.write(iter([batch(b"2")]))
    os.makedirs(f"{tmp_path}/{writer.job}/lost")
    assert sorted(os.listdir(tmp_path)) == [writer.job]
    writer.commit([first, None])
    assert sorted(os.listdir(tmp_path)) == ["a", "b"] and (tmp_path / "a").read_bytes() == b"1"
    other = committed.FilesWriter(str(tmp_path), False)
    other.abort([other.write(iter([batch(b"3")])), None])
    assert sorted(os.listdir(tmp_path)) == ["a", "b"] and (tmp_path / "a").read_bytes() == b"1"


def test_forms_without_fields(spark, tmp_path):
    a, b = tmp_path / "a.pdf", tmp_path / "b.pdf"
    a.write_bytes(pdf.made([{"name": "n", "type": "text", "value": "v"}]))
    b.write_bytes(pdf.made([], ["no form"]))
    out = tmp_path / "o.csv"
    said = tools.extract_to_csv(spark, [str(p) for p in (b, a, b)], str(out)).first()
    assert (said["n_forms"], said["n_fields"]) == (3, 1) and out.read_text() == '_filename,n\n"b.pdf",""\n"a.pdf","v"\n"b.pdf",""'
    r = tools.validate_pdf(spark, str(b)).first()
    assert (r["total"], r["filled"], r["empty"], r["required"], r["empty_fields"]) == (0, 0, 0, [], [])
    assert validate.report_text(tools.validate_pdf(spark, str(b))).first()["report"] == "PDF Validation Report for: b.pdf\nTotal fields: 0\nFilled: 0\nEmpty: 0\n"
    assert tools.read_pdf_fields(spark, str(b)).count() == 0
    assert [tuple(r) for r in fields.field_counts(forms.read_forms(spark, str(a), str(b))).orderBy("file").collect()] == [(str(a), 1), (str(b), 0)]
    only = tools.extract_to_csv(spark, [str(b)], str(out)).first()
    assert (only["n_forms"], only["n_fields"]) == (1, 0) and out.read_text() == '_filename\n"b.pdf"'
    rows = tools.fill_pdf(spark, str(b), str(tmp_path / "f.pdf"), {"x": "1"}).first()
    assert (rows["n_filled"], rows["n_errors"]) == (0, 1)


def test_a_batch_fails_for_a_path_without_a_form(spark):
    rows = text_forms(spark, [("d/a", 0, "n", "1"), ("d/b", None, None, None)])
    paths = spark.createDataFrame([(0, "d/b"), (1, "d/a"), (2, "d/a")], "n int, path string")
    assert [r["line"] for r in fields.extract_lines(fields.batch(paths, rows)).orderBy("file").collect()] == ['"b",""', '"a","1"', '"a","1"']
    with pytest.raises(PySparkException, match="No such form: d/c"):
        fields.batch(paths.union(spark.createDataFrame([(3, "d/c")], paths.schema)), rows).collect()


def test_summary_limits_names_before_it_shuffles(spark):
    rng = random.Random(6)
    rows = [(f"f{k}", i, rng.choice(["n", "m*"]) + str(i), rng.choice(["", " ", "x", None])) for k in range(5) for i in range(rng.choice([0, 9, 10, 11, 60]))] + [("none", None, None, None)]
    df = text_forms(spark, rows).repartition(3)
    got = {r["file"]: tuple(r)[1:] for r in validate.summary(df).collect()}
    report = validate.validate(df)
    first = {r["file"]: (r["first_empty"], r["more"]) for r in validate.first_empty(report).collect()}
    assert got == {r["file"]: (r["total"], r["filled"], r["empty"], *first[r["file"]]) for r in report.collect()}
    plan = validate.summary(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit") and "Partial" in plan  # once in each task, once after


def test_a_form_of_many_empty_fields(spark):
    null = F.lit(None)
    rows = spark.range(3_000_000).select(F.lit("big").alias("file"), F.col("id").cast("int").alias("field_ordinal"), F.concat(F.lit("n"), "id").alias("field_name"), F.lit("text").alias("field_type"), null.cast("array<string>").alias("options"), null.cast("string").alias("text_value"), null.cast("boolean").alias("checked"), null.cast("array<string>").alias("selected"), null.cast("string").alias("read_error"))
    r = validate.summary(rows).first()
    assert (r["total"], r["empty"], r["more"]) == (3_000_000, 3_000_000, 2_999_990) and r["first_empty"] == "\n".join(f"n{i}" for i in range(10))



def test_a_table_filled_with_profiles(spark):
    template = forms.from_table(spark.createDataFrame([("f",)], "f string"), F.col("f"), [forms.field("a", "text"), forms.field("b", "checkbox"), forms.field("10", "text")])
    profiles = spark.createDataFrame([("p", '{"a": "x", "b": 1, "10": "t"}'), ("none", "{}")], "profile_name string, json string")
    requests = spark.createDataFrame([(0, "p", '{"z": 1, "2": null, "b": true}'), (1, "p", None), (2, "none", None), (3, "none", '{"a": null}')], "row long, profile_name string, additional_data string")
    got = {r["row"]: (r["n_filled"], r["n_errors"], [e.split("'")[1] for e in r["errors"]]) for r in tools.fill_with_profiles(requests, profiles, template).collect()}
    assert got == {0: (3, 2, ["2", "z"]), 1: (3, 0, []), 2: (0, 0, []), 3: (1, 0, [])}
    values = fill.merged_values(*(fill.json_values(df, "row", "field_data") for df in (profiles.where("profile_name = 'p'").select(F.lit(0).cast("long").alias("row"), F.col("json").alias("field_data")), requests.where("row = 0").select("row", F.col("additional_data").alias("field_data")))))
    assert [(r["field_name"], r["value"], r["value_kind"]) for r in values.orderBy("ordinal").collect()] == [("2", None, "null"), ("10", "t", "string"), ("a", "x", "string"), ("b", "true", "boolean"), ("z", "1", "number")]
    with pytest.raises(PySparkException, match="No such profile: q"):
        tools.fill_with_profiles(spark.createDataFrame([(0, "q", None)], requests.schema), profiles, template).collect()
