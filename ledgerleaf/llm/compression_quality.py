"""Quality by compression: a zstandard dictionary of good text and one of bad text, and which of them helps more."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import forget, quoted, small_batches, stored, without

#: Labelled documents of each class that a model is fitted on, at most.
PER_CLASS = 2000
#: Bytes of each dictionary.
DICTIONARY = 65536
LEVEL = 3
#: Bytes of a text that are compressed at a time, so that a long text's own words don't outweigh the dictionary.
PIECE = 512
#: The share of all weight in the calibration that stands for texts without evidence, of which neither dictionary knows anything; they are no good ones.
NO_EVIDENCE = 0.05


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    #: The calibrated curve: differences, ascending, and the chance that each stands for; straight lines between.
    at: tuple[float, ...] = ()
    chances: tuple[float, ...] = ()


@lru_cache(maxsize=8)
def compressors(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    out = []
    for data in (good, bad):
        words = zstandard.ZstdCompressionDict(data)
        words.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def difference(text: str | None, good: bytes, bad: bytes) -> float:
    """How many bytes the good dictionary saves over the bad one, for each byte of a whole text; 0 without any.

    It is normalised by the text's own length, so a text that repeats itself, short under either dictionary, says as little as an empty one.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    a, b = compressors(good, bad)
    saved = 0
    for k in range(0, len(data), PIECE):
        piece = data[k : k + PIECE]
        saved += len(b.compress(piece)) - len(a.compress(piece))
    return saved / max(1, len(data))


def chance(model: Model, text: str | None) -> float:
    """0 to 1, as the calibrated curve has it; a half for any text if the model had nothing to learn from."""
    if not model.good:
        return 0.5
    return float(np.interp(difference(text, model.good, model.bad), model.at, model.chances))


def calibrate(d: np.ndarray, y: np.ndarray, prior: float, none: float = 0.0) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The chance that a text is good, never falling with the difference: isotonic regression by pooling neighbours, the classes weighing
    as often as they occur. Each pool counts one more text, of the prior. none: the weight, beside that of all texts, of the pool at 0 that texts
    without evidence stand for, bad ones."""
    weight = {1: prior / max(1, int((y == 1).sum())), 0: (1 - prior) / max(1, int((y == 0).sum()))}
    one = 1 / len(y)
    seen = [(float(d[k]), int(y[k]), weight[int(y[k])]) for k in np.argsort(d, kind="stable").tolist()]
    if none:
        seen = [x for x in seen if x[0] <= 0] + [(0.0, 0, none)] + [x for x in seen if x[0] > 0]
    pools: list[list[float]] = []  # good weight, weight, sum of differences, texts
    for at, good, w in seen:
        pools.append([w * good, w, at, 1.0])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    chances = np.maximum.accumulate([(g + one * prior) / (w + one) for g, w, *_ in pools])
    return tuple(s / n for *_, s, n in pools), tuple(chances.tolist())


def dictionary(pieces: list[bytes]) -> bytes:
    """A dictionary trained on pieces; pieces too few or too much alike to train on are one themselves, each distinct one once."""
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(pieces))


def fit(good: list[bytes], bad: list[bytes], measured: Callable[[bytes, bytes], list[tuple[float, int]]], prior: float = 0.5) -> Model:
    """Dictionaries from pieces of good and bad text, and a curve from measured(good, bad): differences of other labelled texts.

    prior: the share of good documents. Without pieces or measured texts of a class the model says 0.5.
    """
    if not good or not bad:
        return Model(b"", b"")
    built = dictionary(good), dictionary(bad)
    found = measured(*built)
    y = np.array([label for _, label in found])
    if {*y.tolist()} != {0, 1}:
        return Model(b"", b"")
    return Model(*built, *calibrate(np.array([d for d, _ in found]), y, prior, NO_EVIDENCE))


def trained(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS, folds: int = 3, held_out: int = 1) -> Model:
    """Fitted on at most 2 * per_class labelled documents outside the held-out fold, whole, of any length.

    Two thirds of them build the dictionaries, on the driver, from all their pieces; the rest is measured whole on the executors, and only
    differences and labels come back.
    """
    small_batches(docs.sparkSession)
    rows = stored(labelled.sample(docs, labels, per_class=per_class, folds=folds, held_out=held_out))
    turn = F.crc32(F.concat(F.lit("fit-"), F.col("doc_id").cast("string")).cast("binary")) % 3
    held: dict[int, list[bytes]] = {}
    for label in (0, 1):
        got = labelled.pieces(rows.where((turn != 2) & (F.col("label") == label)), PIECE).collect()
        held[label] = [bytes(x) for r in sorted(got, key=lambda r: str(r["doc_id"])) for x in r["pieces"]]

    def measured(good: bytes, bad: bytes) -> list[tuple[float, int]]:
        out = rows.where(turn == 2).select("doc_id", "label", differing(good, bad)("text").alias("d")).collect()
        return [(r["d"], r["label"]) for r in sorted(out, key=lambda r: (str(r["doc_id"]), r["label"]))]

    counts = dict(rows.groupBy("label").count().collect())
    of = dict(labels.where(labelled.fold("doc_id", folds) != held_out).groupBy("quality").count().where("quality in (0, 1)").collect()) if counts else {}
    model = fit(held[1], held[0], measured, of.get(1, 1) / max(1, sum(of.values())))
    forget(rows)
    return model


def differing(good: bytes, bad: bytes):
    @F.arrow_udf("double")
    def differences(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([difference(t.as_py(), good, bad) for t in batch], pa.float64())

    return differences


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the calibrated chance, 0 to 1, that a whole text is good.

    Null and empty texts, and others that neither dictionary tells anything about, score the same, below a half; a model without both classes
    gives every text a half. Texts alike score alike, so rows repeated do; very long texts are compressed piece by piece, whole. An empty table
    gives an empty one. A column called like the new one gives way, other columns stay.
    """
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([chance(sent.value, t.as_py()) for t in batch], pa.float64())

    return without(df, out).withColumn(out, scored(quoted(text).cast("string")))
