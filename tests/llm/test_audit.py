"""The audit of filters against documents and orders taken one by one."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

from ledgerleaf.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs: list[tuple], labels: list[tuple]) -> dict[tuple, tuple]:
    """(part, order, step) -> kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley, of rows (doc_id, text, source)."""
    first: dict[str, int] = {}
    for k, t, _ in docs:
        if k is not None:
            first[t or ""] = min(first.get(t or "", k), k)
    good, toxic = ({k for k, *v in labels if v[i] == 1} for i in (0, 1))
    rows = []
    for k, text, source in docs:
        t = text or ""
        ws = WORD.findall(t)
        fails = "".join(x for x, bad in zip("ABCDE", (len(ws) < 50, 100 * len(set(ws)) < 65 * len(ws), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search("[#$%&*|]", t), k is not None and k > first[t]), strict=True) if bad)
        rows.append((source or "", fails, k is not None and k in good, k is not None and k in toxic))
    out, total = {}, Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for p in permutations("ABCDE"):
            left = mine
            for i, x in enumerate(p):
                gone, kept = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                failing = [r for r in mine if x in r[1]]
                out[part, "".join(p), i + 1] = (len(kept), len(gone), len(failing) - len(gone), sum(r[1] == x for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone))
                total[part, x] += len(gone)
                left = kept
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "B", "c#", "é", f"w{rng.randrange(90)}"]) if rng.random() < share else f"w{i}" for i in range(rng.choice([3, 49, 50, 51, 120]))) for share in (0, 0.1, 0.3, 0.5, 0.9) for _ in range(12)]
    texts += [None, "", "", " \n", "ABC", "é" * 19 + "A", "é" * 20 + "A", "x y " * 50]
    docs = [(rng.choice([i, i, i, 7, None]), t, rng.choice(["web", "", None, "Web", "\U0001f600"])) for i, t in enumerate([*texts, *rng.choices(texts, k=60)])]
    docs += [docs[0], docs[0]]
    labels = [(rng.randrange(140), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)] + [(None, 1, 1)]
    df = spark.createDataFrame([(*d, True, "x") for d in docs], "doc_id long, text string, source string, fails_A boolean, _text string")
    got = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in got} == brute(docs, labels)
    assert len(got) == 600 * len({d[2] or "" for d in docs}) and all(r["filter"] == r["filter_order"][r["step"] - 1] for r in got)


def test_tables_without_rows(spark):
    docs, labels = "doc_id long, text string, source string", "doc_id long, quality int, toxic int"
    assert not filter_audit.audit(spark.createDataFrame([], docs), spark.createDataFrame([], labels)).count()
    one = filter_audit.audit(spark.createDataFrame([(1, "x", None)], docs), spark.createDataFrame([], labels))
    assert one.count() == 600 and one.where("removed = 1").count() == 120 and one.where("part = ''").count() == 600
