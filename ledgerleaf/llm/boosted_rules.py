"""Quality rules: boosted trees over a document's statistics, flattened into arrays of nodes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import quoted, small_batches, unused, without

#: Labelled documents of each class that a model is fitted on, at most.
PER_CLASS = 4000
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The trees' features, and the direction in which each may move the score: -1 only down, 0 either way.
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "exclaims_per_word": -1,
    "distinct_share": 0,
    "words_per_line": 0,
    "end_share": 0,
    "letter_share": 0,
}
WINDOW = 5
#: Odd numbers that mix the words of a window.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def repeated(words: list[bytes]) -> int:
    """Words in windows of five that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.uint64)
    if len(seen) == len(words):
        return 0
    key = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        part = (ids[k : k + n] + np.uint64(1)) * ODD[k]
        key = (key ^ (part ^ (part >> np.uint64(29)))) * ODD[(k + 1) % WINDOW]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[:-1][same]] = True
    twice[order[1:][same]] = True
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the trees' features of a whole text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(text) - sum(map(data.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    symbols = sum(data.count(bytes([c])) for c in SYMBOLS)
    earlier: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(" \t\n\v\f\r"):
            lines += 1
            dup += line in earlier
            earlier.add(line)
    again = repeated(words)
    codes = np.frombuffer(data, np.uint8)
    kinds = np.bincount(codes, minlength=256) if n else np.zeros(256, np.int64)
    upper, digits = int(kinds[65:91].sum()), int(kinds[48:58].sum())
    lower = int(kinds[97:123].sum())
    wide = int(kinds[0xC0:].sum())
    ends = int(kinds[[0x2E, 0x3F]].sum())
    many, of = max(1, n), max(1, chars)
    return [n, chars, symbols, dup, again], [
        float(np.log1p(n)), chars / many, symbols / many, dup / max(1, lines), again / many, upper / of, digits / of,
        int(kinds[0x21]) / many, len(set(words)) / many, n / max(1, lines), ends / many, (upper + lower + wide) / of,
    ]


@dataclass(frozen=True)
class Trees:
    """All trees' nodes in one set of arrays; a leaf is its own child. roots: each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chances for rows of features, every tree and row at once."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-np.clip(self.base + self.value[at].sum(axis=1), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, shrink: float = 1.0, bins: int = 64, signs: tuple[int, ...] = tuple(FEATURES.values())) -> Trees:
    """Boosts logistic loss by histograms. A split on a feature with a sign is taken only if its sides' values keep the order, and
    bounds pass on to what lies below, so the whole model is monotonic in that feature."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    total = np.zeros(len(y))

    def node() -> int:
        k = len(feature)
        feature.append(0), threshold.append(0.0), left.append(k), right.append(k), value.append(0.0)
        return k

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = weight * (p - y), weight * p * (1 - p)
        roots.append(root := node())
        todo = [(root, np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            k, at, level, low, high = todo.pop()
            best = None
            sg, sh = g[at].sum(), h[at].sum()
            if level < depth and len(at) >= 20:
                for f, sign in enumerate(signs):
                    if not len(cuts[f]):
                        continue
                    gl = np.cumsum(np.bincount(binned[at, f], g[at], len(cuts[f]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[at, f], h[at], len(cuts[f]) + 1))[:-1]
                    nl = np.cumsum(np.bincount(binned[at, f], minlength=len(cuts[f]) + 1))[:-1]
                    vl = np.clip(-gl / (hl + shrink), low, high)
                    vr = np.clip(-(sg - gl) / (sh - hl + shrink), low, high)
                    gain = gl**2 / (hl + shrink) + (sg - gl) ** 2 / (sh - hl + shrink) - sg**2 / (sh + shrink)
                    ok = (nl >= 10) & (len(at) - nl >= 10) & (sign * (vr - vl) >= 0)
                    if ok.any() and (top := np.where(ok, gain, -1.0)).max() > (best[0] if best else 1e-6):
                        i = int(top.argmax())
                        best = (top[i], f, i, vl[i], vr[i])
            if best is None:
                value[k] = rate * float(np.clip(-sg / (sh + shrink), low, high))
                total[at] += value[k]
                continue
            _, f, i, vl, vr = best
            middle = (vl + vr) / 2
            feature[k], threshold[k], left[k], right[k] = f, float(cuts[f][i]), node(), node()
            goes = binned[at, f] <= i
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[signs[f]]
            todo += [(left[k], at[goes], level + 1, *bounds[0]), (right[k], at[~goes], level + 1, *bounds[1])]
    return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), depth, 0.0)


def measured(df: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """Adds a struct of the base counts and the features. Null texts count as empty."""
    small_batches(df.sparkSession)

    @F.arrow_udf("struct<" + ",".join(f"{c}:long" for c in BASE) + ",features:array<double>>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch]
            counts = [pa.array([r[0][k] for r in rows], pa.int64()) for k in range(len(BASE))]
            yield pa.StructArray.from_arrays([*counts, pa.array([r[1] for r in rows], pa.list_(pa.float64()))], [*BASE, "features"])

    return without(df, out).withColumn(out, counted(quoted(text).cast("string")))


def trained(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, folds: int = 3, held_out: int = 1) -> Trees | None:
    """Fitted on the driver on the features of at most 2 * per_class labelled documents outside the held-out fold; None without both classes."""
    rows = measured(labelled.sample(docs, labels, per_class=per_class, folds=folds, held_out=held_out)).select("doc_id", "label", "stats.features").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["features"]))
    y = np.array([r["label"] for r in rows])
    if {*y.tolist()} != {0, 1}:
        return None
    return grow(np.array([r["features"] for r in rows]), y)


def judge(df: DataFrame, trees: Trees | None, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Adds the base counts, base_failed, score and kept; columns of these names give way.

    base_failed: under 10 words, or over a fifth of the words in repeated windows. kept: not failed, and a score of threshold or more;
    without a model every document that hasn't failed is kept, and a score of exactly the threshold is enough. Null and empty texts fail. Texts alike are
    judged alike, so rows repeated are. Very long texts are measured whole. An empty table gives an empty one; other columns stay.
    """
    sent = df.sparkSession.sparkContext.broadcast(trees)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        for batch in batches:
            x = batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.array(model.score(x) if model is not None else np.ones(len(x)), pa.float64())

    df = without(df, *BASE, "base_failed", "score", "kept")
    stats, = unused(df, "_stats")
    df = measured(df, text, stats)
    df = df.withColumn("score", scored(F.col(stats)["features"]))
    df = df.withColumns({c: F.col(stats)[c] for c in BASE}).drop(stats)
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
