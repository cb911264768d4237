"""Entities of a whole table: crowded formats, and one person in several documents."""

from __future__ import annotations

import itertools
import re
from string import ascii_lowercase

import pyarrow as pa
import pyarrow.parquet as pq

from ledgerleaf.llm import pii
from ledgerleaf.llm.queries import QUERIES

FORMS = "kind string, form string"


def settled(spark, known):
    again = pii.redrawn(spark.createDataFrame(known, FORMS).repartition(4), b"k")
    return {(r["kind"], r["form"]): r["attempt"] for r in again.collect()} if again else {}


def test_crowded_addresses_get_longer(spark):
    known = [("email", f"{a}@{b}.de") for a, b in itertools.product(ascii_lowercase, repeat=2)]
    again = settled(spark, known)
    drawn = [pii.surrogate(k, f, again.get((k, f), 0), b"k") for k, f in known]
    assert len(set(drawn)) == 676 and not set(drawn) & {f for _, f in known} and all(re.fullmatch(r"[a-z]+@[a-z]\.de", d) for d in drawn)
    assert max(again.values()) < 20


def test_crowded_numbers_are_a_permutation(spark, monkeypatch):
    monkeypatch.setattr(pii, "CROWDED", 1e-4)
    known = [("phone", f"{k:07d}") for k in range(3000)] + [("phone", f"{k:08d}") for k in range(50)]
    again = settled(spark, known)
    drawn = [pii.surrogate(k, f, again.get((k, f), 0), b"k") for k, f in known]
    assert len(set(drawn)) == len(known) and all(len(f) > 7 for _, f in again) and {len(d) for d in drawn} == {7, 8}
    assert not {d for d in drawn if len(d) == 8} & {f for _, f in known}


def test_short_secrets_and_hexadecimal_ones_end(spark):
    known = list(dict.fromkeys([("secret", f"{k:08d}") for k in range(40)] + [("secret", f"{k:08x}") for k in range(40, 90)]))
    again = settled(spark, known)
    drawn = [pii.surrogate(k, f, again.get((k, f), 0), b"k") for k, f in known]
    assert len(set(drawn)) == len(known) and not set(drawn) & {f for _, f in known}


def run(spark, tmp_path, texts):
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    return [r["text"] for r in QUERIES["op1_pii_surrogates"](spark, str(tmp_path)).orderBy("doc_id").collect()]


def test_gender_is_settled_over_the_table(spark, tmp_path):
    """Joan is a woman to two documents, a man or neither to others; all of them get one name, a woman's."""
    got = run(spark, tmp_path, ["Dr Joan Baker came.", "Mrs Joan Baker came.", "Ms Joan Baker came.", "Mr Joan Cook came.", "Prof Joan Baker came.", "Mr Toby Cook came.", "Dr Toby Cook came."])
    names = [re.search(r"(?:Dr|Mrs|Ms|Mr|Prof) (\w+) (\w+) came", t).groups() for t in got]
    assert len({n[0] for n in names[:5]}) == 1 and names[0][0] in pii.GIVEN["latin", "f"]
    assert names[5] == names[6] and names[5][0] in pii.GIVEN["latin", "m"]
    assert {n[1] for n in names[:3]} == {names[4][1]} and names[3][1] == names[5][1] != names[0][1]


def test_slavic_surnames_are_one_in_both_genders(spark, tmp_path):
    got = run(spark, tmp_path, ["Г-н Иванов и Г-жа Иванова.", "Пришла Г-жа Иванова. Иванов ушёл.", "Г-н Гончар и Г-жа Гончар."])
    first, second = re.fullmatch(r"Г-н (\w+) и Г-жа (\w+)\.", got[0]).groups()
    assert second == first + "а" and first.lower().endswith(pii.SLAVIC) and "Иванов" not in got[0]
    assert re.fullmatch(r"Пришла Г-жа (\w+)\. (\w+) ушёл\.", got[1]).groups() == (second, first)
    a, b = re.fullmatch(r"Г-н (\w+) и Г-жа (\w+)\.", got[2]).groups()
    assert a == b and a != first


def test_registered_query_keeps_entities_apart_and_together(spark, data):
    """On the whole table: what one form becomes is the same in all documents, and no two forms become one."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    became: dict[tuple, set] = {}
    rows = QUERIES["op1_pii_surrogates"](spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = pii.detect(docs[r["doc_id"]])
        assert r["n_replaced"] == len(spans)
        text = docs[r["doc_id"]] or ""
        parts, at = [], 0
        for start, end, *_ in spans:
            parts.append(text[at:start])
            at = end
        found = re.fullmatch("(.+?)".join(map(re.escape, [*parts, text[at:]])), r["text"] or "", re.S)
        assert found
        for (_, _, kind, form), new in zip(spans, found.groups(), strict=True):
            became.setdefault((kind.partition("_")[0], form), set()).add(pii.normal(kind, new))
    assert len(became) > 10 and all(len(v) == 1 for v in became.values())
    for family in {k for k, _ in became}:
        new = [next(iter(v)) for (k, _), v in became.items() if k == family]
        assert len(set(new)) == len(new) and not set(new) & {f for k, f in became if k == family}
