from __future__ import annotations

import random

import pytest

from ledgerleaf.sources import csv_text

CASES = {
    "C1": ("a,b\n1,2\n", [{"a": "1", "b": "2"}]),
    "C2": ("a,b\r\n1,2\r\n", [{"a": "1", "b": "2"}]),
    "C3": ("﻿\n\na,b\n1,2", [{"a": "1", "b": "2"}]),
    "C4": ("a,b\n1,2\n\n3,4", [{"a": "1", "b": "2"}, {"a": "", "b": ""}, {"a": "3", "b": "4"}]),
    "C5": ('a,b\n"x,y",2', [{"a": '"x', "b": 'y"'}]),
    "C6": ("a,b\n1", [{"a": "1", "b": ""}]),
    "C7": ("a,b\n1,2,3", [{"a": "1", "b": "2"}]),
    "C8": ("a,a\n1,2", [{"a": "2"}]),
    "C9": ("a,b", []),
    "C10": ("", []),
    "C11": (" a , b \n 1  ,\t2", [{"a": "1", "b": "2"}]),
    "C12": ("a,b\n0,", [{"a": "0", "b": ""}]),
    "C13": ("a,b\r1,2", []),
    "null": (None, []),
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = csv_text.records(spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()], "k string, t string"), "k", "t").collect()
    return {k: [r["record"] for r in sorted((r for r in rows if r["k"] == k), key=lambda r: r["row"])] for k in CASES}


@pytest.mark.parametrize("case", CASES)
def test_parse(parsed, case):
    assert parsed[case] == CASES[case][1]


def test_rendered_cells_keep_their_quotes(spark):
    rng = random.Random(1)
    values = ["".join(rng.choice("abcß日 é")) + "x" for _ in range(20)]
    text = "h\n" + "\n".join(f'"{v}"' for v in values)
    got = csv_text.parse(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").orderBy("row").collect()
    assert [r["value"] for r in got] == [f'"{v}"' for v in values]


def test_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,m\n1,2\n3,4", encoding="utf-8")
    assert [r["record"] for r in csv_text.read(spark, str(tmp_path / "a.csv")).orderBy("row").collect()] == [{"n": "1", "m": "2"}, {"n": "3", "m": "4"}]
