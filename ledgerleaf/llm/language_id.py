"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text's UTF-8 bytes are read in spans of SPAN positions, forwards and backwards, and every position gets a distribution over the
languages; a document's probabilities are their mean over all its positions. Training is backpropagation through time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, quoted, small_batches, unused, without
from .labelled import fold, pieces

SPAN = 64
HIDDEN = 8
#: Spans that go through the network together.
TOGETHER = 2048
#: Documents that a model is fitted on, whole, at most; and languages that it learns, the most frequent ones, at most.
SAMPLE, LANGUAGES = 800, 512
PAD = 256
#: What may hold a letter; numerals such as fractions count as word characters too, so str.isalpha() decides.
WORD_CHARACTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m[0].isalpha() for m in WORD_CHARACTER.finditer(text))


@dataclass
class Net:
    """w: input rows by byte, for the update gate, the reset gate and the candidate; u: recurrent weights; both by direction. v, c: output."""

    labels: list[str]
    w: list[np.ndarray]
    u: list[np.ndarray]
    b: list[np.ndarray]
    v: np.ndarray
    c: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [*self.w, *self.u, *self.b, self.v, self.c]


def fresh(labels: list[str], hidden: int = HIDDEN, seed: int = 4) -> Net:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    n = len(labels)
    return Net(labels, [draw(257, 3 * hidden, scale=0.3) for _ in range(2)], [draw(hidden, 3 * hidden, scale=0.4) for _ in range(2)], [np.zeros(hidden, np.float32) for _ in range(2)], draw(2 * hidden, n, scale=0.3), np.zeros(n, np.float32))


def gates(net: Net, way: int, ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step: gates, candidate, its recurrent part and the next state."""
    k = h.shape[1]
    a = net.w[way].take(ids, axis=0)
    u = h @ net.u[way]
    g = a[:, : 2 * k]
    g += u[:, : 2 * k]
    g *= 0.25
    g += 0.5
    np.clip(g, 0, 1, out=g)  # straight-line sigmoids
    inner = u[:, 2 * k :] + net.b[way]
    cand = np.tanh(a[:, 2 * k :] + g[:, k:] * inner)
    return g, cand, inner, cand + g[:, :k] * (h - cand)


def states(net: Net, way: int, ids: np.ndarray) -> np.ndarray:
    """ids: SPAN x spans. The states at every position: SPAN x spans x hidden."""
    hidden = net.u[way].shape[0]
    out = np.empty((*ids.shape, hidden), np.float32)
    h = np.zeros((ids.shape[1], hidden), np.float32)
    for t in range(len(ids)) if way == 0 else range(len(ids) - 1, -1, -1):
        *_, h = gates(net, way, ids[t], h)
        out[t] = h
    return out


def probabilities(net: Net, ids: np.ndarray) -> np.ndarray:
    """The distribution at every position: SPAN x spans x labels."""
    k = net.v.shape[0] // 2
    x = states(net, 0, ids) @ net.v[:k] + states(net, 1, ids) @ net.v[k:] + net.c
    x -= x.max(axis=2, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=2, keepdims=True)
    return x


def spans_of(data: np.ndarray) -> np.ndarray:
    """Bytes as rows of SPAN ids, the last one padded."""
    n = -(-len(data) // SPAN)
    out = np.full(n * SPAN, PAD, np.int16)
    out[: len(data)] = data
    return out.reshape(n, SPAN)


def predict(net: Net, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Each text's language and its probability; without a letter: und, 0."""
    labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if has_letter(t)]
    for start, stop in by_bytes([texts[i] for i in known]):
        at = known[start:stop]
        rows = [spans_of(np.frombuffer(texts[i].encode("utf-8", "surrogatepass"), np.uint8)) for i in at]
        owner = np.repeat(np.arange(len(at)), [len(r) for r in rows])
        ids = np.concatenate(rows)
        sums = np.zeros((len(at), len(net.labels)))
        for k in range(0, len(ids), TOGETHER):
            part = np.ascontiguousarray(ids[k : k + TOGETHER].T)
            p = probabilities(net, part)
            p *= (part != PAD)[:, :, None]
            np.add.at(sums, owner[k : k + TOGETHER], p.sum(axis=0, dtype=np.float64))
        sums /= sums.sum(axis=1, keepdims=True)
        best = sums.argmax(axis=1)
        for j, i in enumerate(at):
            labels[i], scores[i] = net.labels[best[j]], float(min(1.0, max(0.0, sums[j, best[j]])))
    return labels, scores


def gradient(net: Net, ids: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over all positions of spans (SPAN x n) labelled y, and its gradient for parts()."""
    steps, n = ids.shape
    hidden = net.v.shape[0] // 2
    kept = []
    for way in (0, 1):
        h, trail = np.zeros((n, hidden), np.float32), []
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            g, cand, inner, after = gates(net, way, ids[t], h)
            trail.append((t, h, g, cand, inner))
            h = after
            trail[-1] += (after,)
        kept.append(trail)
    both = np.empty((steps, n, 2 * hidden), np.float32)
    for way in (0, 1):
        for t, *_, after in kept[way]:
            both[t, :, way * hidden : (way + 1) * hidden] = after
    x = both @ net.v + net.c
    x -= x.max(axis=2, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=2, keepdims=True)
    real = ids != PAD
    weight = real / max(1, real.sum())
    loss = -(np.log(x[:, np.arange(n), y] + 1e-12) * weight).sum()
    x[:, np.arange(n), y] -= 1
    x *= weight[:, :, None].astype(np.float32)
    dv = np.tensordot(both, x, ([0, 1], [0, 1]))
    dc = x.sum(axis=(0, 1))
    down = x @ net.v.T
    dw, du, db = [], [], []
    for way in (0, 1):
        k = hidden
        wsum, usum, bsum = np.zeros_like(net.w[way]), np.zeros_like(net.u[way]), np.zeros_like(net.b[way])
        dh = np.zeros((n, k), np.float32)
        seen, rows = [], []
        for t, h, g, cand, inner, _ in reversed(kept[way]):
            dh = dh + down[t, :, way * k : (way + 1) * k]
            z, r = g[:, :k], g[:, k:]
            pre = dh * (1 - z) * (1 - cand**2)
            dg = np.concatenate([dh * (h - cand), pre * inner], axis=1) * (0.25 * ((g > 0) & (g < 1)))
            rec = np.concatenate([dg, pre * r], axis=1)
            usum += h.T @ rec
            bsum += rec[:, 2 * k :].sum(axis=0)
            seen.append(ids[t])
            rows.append(np.concatenate([dg, pre], axis=1))
            dh = dh * z + rec @ net.u[way].T
        seen, rows = np.concatenate(seen), np.concatenate(rows)
        for j in range(3 * k):
            wsum[:, j] = np.bincount(seen, rows[:, j], 257)
        dw.append(wsum), du.append(usum), db.append(bsum)
    return float(loss), [*dw, *du, *db, dv, dc]


def fit(rows: list[tuple[list[bytes], str]], *, epochs: int = 6, batch: int = 512, rate: float = 0.02, seed: int = 4) -> Net | None:
    """rows: (spans of a text, language). Adam, with the rate falling to nothing; None without a row."""
    rows = [(spans, y) for spans, y in rows if spans]
    if not rows:
        return None
    labels = sorted({y for _, y in rows})
    net = fresh(labels, seed=seed)
    ids, y = [], []
    for spans, lang in rows:
        part = np.concatenate([spans_of(np.frombuffer(x, np.uint8)) for x in spans])
        ids.append(part), y.append(np.full(len(part), labels.index(lang)))
    ids, y = np.concatenate(ids), np.concatenate(y)
    rng = np.random.default_rng(seed)
    parts = net.parts()
    m, s, step = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts], 0
    total = epochs * -(-len(ids) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for k in range(0, len(ids), batch):
            at = order[k : k + batch]
            _, grads = gradient(net, np.ascontiguousarray(ids[at].T), y[at])
            step += 1
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads))
            now = rate * (1 - step / (total + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, g, a, b in zip(parts, grads, m, s, strict=True):
                g = g / max(1.0, norm)
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= (now * a / (np.sqrt(b) + 1e-8)).astype(np.float32)
    return net


def shares(counts: dict[str, int], sample: int) -> dict[str, int]:
    """How many documents of each language to take: as even as the counts allow, one at least, of about `sample` in all."""
    out, left = {}, sample
    for k, lang in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        out[lang] = max(1, min(counts[lang], left // (len(counts) - k)))
        left = max(0, left - out[lang])
    return out


def trained(docs: DataFrame, *, sample: int = SAMPLE, languages: int = LANGUAGES, folds: int = 5, held_out: int = 0) -> Net | None:
    """Fitted on the driver on the whole texts of at most `sample` documents with a language and a letter, outside the held-out fold, chosen by key.

    Each language has an even share, or all that it has. Of more than `languages` languages the most frequent are learned, which bounds what is
    counted, sent to all and collected, whatever the table's labels; with more than `sample` languages each has one document.
    """
    small_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).where(fold("doc_id", folds) != held_out)
    known = known.withColumn("lang", F.col("lang").cast("string"))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not counts:
        return None
    # only keys with the least hashes are ranked: four times the share and some, so that few documents are enough
    bounds = [(lang, n, min(1.0, (4 * n + 32) / counts[lang]) * float(1 << 32)) for lang, n in shares(counts, sample).items()]
    bounds = docs.sparkSession.createDataFrame(bounds, "lang string, _share long, _bound double")
    rows = known.select(F.md5(F.col("doc_id").cast("string").cast("binary")).alias("h"), "lang", "doc_id", "text")
    rows = rows.join(F.broadcast(bounds), "lang").where(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") <= F.col("_bound"))
    # the texts stay out of the sort
    rows = pieces(rows, SPAN, "lang", "h", "_share")
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "pieces"))).where("_rank <= _share")
    return fit([([bytes(x) for x in r["pieces"]], r["lang"]) for r in rows.orderBy("h", "doc_id", "pieces", "lang").select("pieces", "lang").collect()])


def identify(df: DataFrame, net: Net | None, text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds each whole text's language and probability. Null texts, texts without a letter and any text without a model: und, 0.

    Of languages that are equally probable the first by code point counts. Texts alike get the same, so rows repeated do. Very long texts are read
    span by span, whole, in bounded memory. An empty table gives an empty one. Columns called like the two new ones give
    way; other columns, lang among them, are not looked at.
    """
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("struct<label:string,score:double>")
    def named(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        for batch in batches:
            labels, scores = predict(model, batch.to_pylist()) if model else ([UNKNOWN] * len(batch), [0.0] * len(batch))
            yield pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["label", "score"])

    df = without(df, label, score)
    both, = unused(df, "_named")
    df = df.withColumn(both, named(quoted(text).cast("string")))
    return df.withColumns({label: F.col(both)["label"], score: F.col(both)["score"]}).drop(both)
