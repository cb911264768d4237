"""Relative Lempel-Ziv parsing against every window looked up by itself."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ledgerleaf.llm import relative_lz


def brute(rows: list[tuple], length: int) -> list[tuple]:
    """n_words, n_removed, kept, spans of each (key, text)."""
    words = [(t or "").encode().split() for _, t in rows]
    least: dict[tuple, int] = {}
    for (key, _), ws in zip(rows, words, strict=True):
        if key is not None:
            for i in range(len(ws) - length + 1):
                w = tuple(ws[i : i + length])
                least[w] = min(least.get(w, key), key)
    out = []
    for (key, _), ws in zip(rows, words, strict=True):
        gone = [False] * len(ws)
        for i in range(len(ws) - length + 1):
            if key is not None and least[tuple(ws[i : i + length])] < key:
                gone[i : i + length] = [True] * length
        spans = [(i, next((j for j in range(i, len(ws)) if not gone[j]), len(ws))) for i in range(len(ws)) if gone[i] and (not i or not gone[i - 1])]
        out.append((len(ws), sum(gone), b" ".join(w for w, g in zip(ws, gone, strict=True) if not g).decode(), spans))
    return out


def made(rng: random.Random, n: int) -> list[tuple]:
    """Texts of few words, with copies, near copies, passages of others, runs of one word, and odd rows."""
    word = lambda: rng.choice("a b c dd é 日本 E".split() + [str(rng.randrange(30))])
    texts = [[word() for _ in range(rng.randrange(60))] for _ in range(n)]
    for _ in range(n):
        a, b = rng.choice(texts), rng.choice(texts)
        at, to = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        b[to:to] = a[at : at + rng.randrange(40)]
    texts += [rng.choice(texts)[:] for _ in range(n // 3)]
    for t in texts[-n // 6 :]:
        if t:
            t[rng.randrange(len(t))] = word()
    texts += [["x"] * 70, ["x"] * 30, ["x", "y"] * 40, []]
    rows = [(rng.randrange(n), " ".join(t).replace("E ", "E\t\r\n ").replace("c ", "c ")) for t in texts]
    return [*rows, (None, rows[0][1]), (5, None), (6, ""), (7, " \n"), rows[0], rows[0], (10**9, rows[1][1]), (-3, rows[2][1])]


@pytest.mark.parametrize("hot, batch, piece", [(1 << 14, 4096, 1 << 17), (1, 3, 7), (3, 10, 20)])
def test_passages(spark, hot, batch, piece):
    rows = made(random.Random(hot + piece), 60)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, doc_id long, text string")
    got = relative_lz.cut_passages(df, length=8, gram=3, hot=hot, batch=batch, piece=piece).orderBy("n").collect()
    want = brute(rows, 8)
    assert [(r["n_words"], r["n_removed"], r["kept"], [tuple(s) for s in r["spans"]]) for r in got] == want
    assert sum(w[1] for w in want) > 500 and sum(len(w[3]) > 1 for w in want) > 3


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id int, text string, Kept int, h string, k int, words string, _uid string, _x string, z string")
    out = relative_lz.cut_passages(empty)
    assert out.columns == ["doc_id", "h", "k", "words", "_uid", "_x", "z", "n_words", "n_removed", "kept", "spans"] and not out.count()
    clash = spark.createDataFrame([(i, "a b c d " * 20, i, "h", i, "w", "u", "x", "z") for i in range(3)], empty.schema)
    assert sorted((r["doc_id"], r["n_removed"], r["_uid"], r["h"]) for r in relative_lz.cut_passages(clash).collect()) == [(0, 0, "u", "h"), (1, 80, "u", "h"), (2, 80, "u", "h")]


def test_parse_of_blocks_is_greedy():
    """Factors start at the first window that an earlier block holds, go as far as it does, and are looked up across their ends."""
    blocks = [list("abcdefgh"), list("cdefghijkl"), list("zabcdefghijkly")]
    number = {c: i for i, c in enumerate("abcdefghijklyz")}
    words = np.array([number[c] for b in blocks for c in b], np.uint64)
    block, at, n = relative_lz.factors(words, np.array([len(b) for b in blocks]), np.array([1, 2, 3]), 4)
    assert sorted(zip(block.tolist(), at.tolist(), n.tolist(), strict=True)) == [(1, 0, 6), (2, 1, 8), (2, 6, 7)]
    assert not len(relative_lz.factors(words, np.array([len(b) for b in blocks]), np.array([1, 1, 1]), 4)[0])


def test_stored_tables_go(spark):
    from ledgerleaf.llm.common import forget_paths, written

    before = len(written(spark))
    df = spark.createDataFrame([(i, "a b c d e f g h i " * 9 + str(i)) for i in range(9)], "doc_id long, text string")
    out = relative_lz.cut_passages(df)
    assert out.count() == 9 and len(written(spark)) == before + 2  # the documents and what was found in them
    forget_paths(spark, written(spark)[before:])


def test_tables_without_a_bound_are_not_sent_to_all(spark):
    """Small inputs shuffle what large ones do: no join broadcasts a table with a row for each document or block."""
    rows = [(k, " ".join(f"w{(k // 2) * 7 + j}" for j in range(120))) for k in range(40)]
    out = relative_lz.cut_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
