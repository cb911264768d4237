from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerleaf.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "want"), [("\t\n a  ﻿", "a"), ("　 ", ""), ("a\n", "a"), (" a b ", "a b"), ("​", "​"), ("", "")])
def test_trim(spark, given, want):
    assert one(spark, T.trimmed(F.lit(given))) == want


@pytest.mark.parametrize(("given", "want"), [("a.json", "a"), ("x.jsonb.json", "xb.json"), ("none", "none")])
def test_first_occurrence(spark, given, want):
    assert one(spark, T.without_first(F.lit(given), ".json")) == want


@pytest.mark.parametrize(("n", "want"), [(128, "0.13"), (1152, "1.13"), (0, "0.00"), (1024, "1.00")])
def test_size(spark, n, want):
    assert one(spark, T.size_kb(F.lit(n))) == want


@pytest.mark.parametrize(("kb", "want"), [("0.00", 1.5), ("375.00", 1.0), ("1500.00", 0.5)])
def test_scale(spark, kb, want):
    assert one(spark, T.raster_scale(F.lit(kb))) == pytest.approx(want)


def test_length_in_units(spark):
    assert one(spark, T.utf16_length(F.lit("\U0001f600a"))) == 3


def test_base64_is_one_line(spark):
    assert "\n" not in one(spark, T.base64_line(F.lit(b"x" * 100))) and len(one(spark, T.base64_line(F.lit(b"x" * 100)))) == 136


@pytest.mark.parametrize(("value", "kind", "want"), [("true", "boolean", True), ("false", "boolean", False), ("true", "string", True), ("yes", "string", True), ("1", "string", True), ("1", "number", False), ("TRUE", "string", False), ("on", "string", False), ("", "string", False), (None, "null", False)])
def test_checks(spark, value, kind, want):
    assert one(spark, T.checks(F.lit(value).cast("string"), F.lit(kind))) is want


@pytest.mark.parametrize(("name", "want"), [("RequiredName", True), ("f*", True), ("mustard", True), ("name", False)])
def test_required(spark, name, want):
    assert one(spark, T.is_required(F.lit(name))) is want


def test_merge_keeps_places(spark):
    a, b = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("9"), F.lit("c"), F.lit("3"))
    assert list(one(spark, T.merged(a, b)).items()) == [("a", "1"), ("b", "9"), ("c", "3")]
    assert one(spark, T.merged(T.merged(a, b), b)) == one(spark, T.merged(a, b))


def test_key_order(spark):
    m = F.map_entries(F.create_map(*[F.lit(x) for k in ("b", "10", "2", "01", "a") for x in (k, "v")]))
    assert [e["key"] for e in one(spark, T.in_key_order(m))] == ["2", "10", "b", "01", "a"]


def test_utf16_order():
    assert T.utf16_order(["￿", "\U0001f600", "b", "Z", "_x"]) == ["Z", "_x", "b", "\U0001f600", "￿"]
