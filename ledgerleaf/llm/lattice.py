"""Near-duplicate embeddings by lattice hashing on E8.

In each table a vector goes through a random projection to BLOCKS times eight dimensions, and every eight are decoded to the nearest point of
the E8 lattice: the points are its cell. It also probes the neighbouring cell that is nearest in each block. Vectors of one
label that meet in a cell, at least one of them at home there, are compared by cosine in double precision. A pair that meets
more than once counts at its first meeting only, so links are counted where they are found and never listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, quoted, small_batches, stored, unused, without
from .components import components
from .simhash import Forest

TABLES, BLOCKS = 10, 3
#: Unit vectors are stretched so much before they are decoded; the lattice's shortest vectors have length sqrt(2).
STRETCH = 1.6
#: Members of a cell that one task compares at a time; larger cells are dealt as pairs of blocks.
CELL_BLOCK = 4096


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i + 1, 8):
            for a in (1.0, -1.0):
                for b in (1.0, -1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        if bits.bit_count() % 2 == 0:
            out.append(np.array([-0.5 if bits >> k & 1 else 0.5 for k in range(8)]))
    return np.array(out)


ROOTS = roots()


def decode_even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum (D8): where rounding gives an odd sum, the worst coordinate goes the other way."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(axis=1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is D8 and D8 moved by a half in every coordinate."""
    a, b = decode_even(x), decode_even(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def projections(dim: int, tables: int, blocks: int, seed: int = 8) -> np.ndarray:
    """tables x dim x 8 * blocks; orthonormal columns where dim allows, scaled to keep lengths on average."""
    rng = np.random.default_rng([seed, dim])
    wide = 8 * blocks
    out = []
    for _ in range(tables):
        m = rng.standard_normal((dim, wide))
        q = np.linalg.qr(m)[0] if dim >= wide else m / np.sqrt(wide)
        out.append(q * np.sqrt(dim / wide) if dim >= wide else q)
    return np.array(out) * np.sqrt(blocks)


def cells(unit: np.ndarray, *, tables: int = TABLES, blocks: int = BLOCKS, stretch: float = STRETCH) -> np.ndarray:
    """rows x tables x (1 + blocks) hashes: each row's own cell first, then the nearest neighbouring one in each block."""
    rng = np.random.default_rng(88)
    odd = rng.integers(0, 1 << 63, (tables, 8 * blocks), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(unit), tables, 1 + blocks), np.uint64)
    for t, p in enumerate(projections(unit.shape[1], tables, blocks)):
        x = unit @ p * stretch
        points = np.empty_like(x)
        nearby = []
        for b in range(blocks):
            part = x[:, 8 * b : 8 * b + 8]
            points[:, 8 * b : 8 * b + 8] = home = decode(part)
            nearby.append(home + ROOTS[((part - home) @ ROOTS.T).argmax(axis=1)])
        for k in range(1 + blocks):
            y = points
            if k:
                y = points.copy()
                y[:, 8 * (k - 1) : 8 * k] = nearby[k - 1]
            h = ((2 * y).astype(np.int64).view(np.uint64) * odd[t]).sum(axis=1, dtype=np.uint64)
            h ^= h >> np.uint64(31)
            h *= np.uint64(0x9E3779B97F4A7C15)
            out[:, t, k] = h ^ (h >> np.uint64(29))
    return out


def first_meeting(a: np.ndarray, b: np.ndarray, table: int, cell: np.uint64, a_first: np.ndarray) -> np.ndarray:
    """Whether pairs (rows of a and b: tables x cells) meet in this table's cell and nowhere before.

    In one table a pair may meet at either one's home; the home of the one that comes first (a_first) goes before.
    """
    ok = np.ones(len(a), bool)
    for t in range(table):
        ok &= ~((a[:, t, :1] == b[:, t, :]).any(axis=1) | (b[:, t, :1] == a[:, t, :]).any(axis=1))
    at_a = (a[:, table, :1] == b[:, table, :]).any(axis=1)  # b is seen at a's home
    at_b = (b[:, table, :1] == a[:, table, :]).any(axis=1)
    home_a, home_b = a[:, table, 0], b[:, table, 0]
    where = np.where(a_first, np.where(at_a, home_a, home_b), np.where(at_b, home_b, home_a))
    return ok & (at_a | at_b) & (where == cell)


def compared(ids: np.ndarray, unit: np.ndarray, keys: np.ndarray, weight: np.ndarray, side: np.ndarray, table: int, cell: np.uint64, least: float, step: int = 512) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links that a group's vectors have here first, weighted, and pairs that connect what they connect.

    side: -1 for a group of one block; else only pairs of different sides are looked at.
    """
    counts, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
    for i in range(0, len(ids), step):
        cos = unit[i : i + step] @ unit[i:].T
        r, c = np.nonzero(cos >= least)
        later = c > r
        r, c = r[later] + i, c[later] + i
        if side[0] >= 0:
            other = side[r] != side[c]
            r, c = r[other], c[other]
        for k in range(0, len(r), 1 << 16):
            a, b = r[k : k + (1 << 16)], c[k : k + (1 << 16)]
            ok = first_meeting(keys[a], keys[b], table, cell, ids[a] < ids[b])
            a, b = a[ok], b[ok]
            np.add.at(counts, a, weight[b])
            np.add.at(counts, b, weight[a])
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                forest.join(x, y)
    return counts, forest.links


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", *, least: float = 0.98, tables: int = TABLES, blocks: int = BLOCKS, stretch: float = STRETCH, block: int = CELL_BLOCK) -> DataFrame:
    """Adds n_links, component_id and kept to every row.

    n_links: other rows of the same label and dimension found at a cosine of `least` or more; component_id: the least key that links reach,
    the row's own included; kept: the row's key is that one. Rows whose label is null, and vectors that are null, empty, zero or hold a
    null or non-finite number, have no links. Rows alike in label and vector are linked with one another, and are one
    node; of rows with one key all are kept or none. key may be of any type that sorts. Columns called like the new ones give way, others stay; an
    empty table gives an empty one. Vectors of any length go through the same number of tables.
    """
    spark = df.sparkSession
    small_batches(spark)
    base = without(df, "n_links", "component_id", "kept")
    v_, v2_, label_, links_, component_ = unused(base, "_v", "_v2", "_label", "_links", "_component")
    v = quoted(vector).cast("array<double>")
    usable = quoted(label).isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = base.withColumn(v_, F.when(usable, v))
    nodes = rows.where(F.col(v_).isNotNull()).groupBy(quoted(label).alias("_label"), F.col(v_).alias("_v")).agg(F.min(quoted(key)).alias("_least"), F.count(F.lit(1)).alias("_w"))
    nodes = stored(nodes.withColumn("_uid", F.monotonically_increasing_id()))

    @F.arrow_udf("struct<unit:binary,cells:binary>")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            units, keys = [None] * len(batch), [None] * len(batch)
            lists = [np.array(x.as_py()) for x in batch]
            for dim in {len(x) for x in lists}:
                at = [i for i, x in enumerate(lists) if len(x) == dim]
                x = np.array([lists[i] for i in at])
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                for i, k, u in zip(at, cells(x, tables=tables, blocks=blocks, stretch=stretch), x, strict=True):
                    units[i], keys[i] = u.tobytes(), k.tobytes()
            yield pa.StructArray.from_arrays([pa.array(units, pa.binary()), pa.array(keys, pa.binary())], ["unit", "cells"])

    @F.arrow_udf("array<long>")
    def listed(keys: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(k.as_py(), np.int64) for k in keys], pa.list_(pa.int64()))

    coded = stored(nodes.select("_uid", "_label", F.size("_v").alias("_dim"), "_w", hashed("_v").alias("_h")).select("_uid", "_label", "_dim", "_w", "_h.unit", "_h.cells"))
    spots = coded.select("_uid", "_label", "_dim", F.posexplode(listed("cells")).alias("_place", "_cell")).withColumn("_table", (F.col("_place") / (1 + blocks)).cast("int"))
    spots = stored(spots.drop("_place"))
    where = ["_label", "_dim", "_table", "_cell"]
    full = spots.groupBy(where).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    met = spots.join(full, where).withColumn("_k", F.ceil(F.col("_n") / block).cast("int")).withColumn("_side", F.pmod(F.xxhash64("_uid"), F.col("_k")).cast("int"))
    met = met.withColumn("_other", F.explode(F.expr("sequence(0, _k - 1)"))).select("_uid", *where, F.least("_side", "_other").alias("_i"), F.greatest("_side", "_other").alias("_j"), "_side")
    group = [*where, "_i", "_j"]
    met = met.join(coded.select("_uid", "_w", "unit", "cells"), "_uid")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    met = met.repartition(parts, *group).sortWithinPartitions(*group)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(key: tuple, held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
            rows = pa.Table.from_batches(held)
            if rows.num_rows < 2:
                return None
            ids = rows["_uid"].to_numpy()
            unit = np.array([np.frombuffer(x.as_py()) for x in rows["unit"]])
            keys = np.array([np.frombuffer(x.as_py(), np.uint64) for x in rows["cells"]]).reshape(len(ids), tables, 1 + blocks)
            side = rows["_side"].to_numpy() if key[-2] != key[-1] else np.full(len(ids), -1)
            counts, pairs = compared(ids, unit, keys, rows["_w"].to_numpy(), side, key[2], np.int64(key[3]).view(np.uint64), least)
            some = np.flatnonzero(counts)
            a, b = ([p[0] for p in pairs], [p[1] for p in pairs]) if pairs else ([], [])
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids[some], ids[a]])), pa.array(np.concatenate([counts[some], np.zeros(len(a), np.int64)])), pa.array([None] * len(some) + ids[b].tolist(), pa.int64())],
                ["_uid", "_links", "_to"],
            ) if len(some) or pairs else None

        held, at = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_pylist() for c in group]
            keys = list(zip(*columns, strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if keys[a] != at and held:
                    if (out := one(at, held)) is not None:
                        yield out
                    held = []
                at = keys[a]
                held.append(batch.slice(a, b - a))
        if held and (out := one(at, held)) is not None:
            yield out

    found = stored(met.mapInArrow(linked, "_uid long, _links long, _to long"))
    forget(coded, spots)
    roots_ = components(found.where("_to is not null").select(F.col("_uid").alias("a"), F.col("_to").alias("b"))).withColumnsRenamed({"node": "_uid", "root": "_root"})
    counts = found.groupBy("_uid").agg(F.sum("_links").alias("_links"))
    nodes = nodes.join(counts, "_uid", "left").join(roots_, "_uid", "left").withColumn("_root", F.coalesce("_root", "_uid"))
    least_ = nodes.groupBy("_root").agg(F.min("_least").alias(component_))
    nodes = nodes.join(least_, "_root").select(F.col("_label").alias(label_), F.col("_v").alias(v2_), (F.coalesce("_links", F.lit(0)) + F.col("_w") - 1).alias(links_), component_)
    out = rows.join(nodes, (quoted(label) == F.col(label_)) & (F.col(v_) == F.col(v2_)), "left")
    out = out.withColumns({"n_links": F.coalesce(F.col(links_), F.lit(0)).cast("long"), "component_id": F.coalesce(F.col(component_), quoted(key))})
    return out.withColumn("kept", F.coalesce(quoted(key) == F.col("component_id"), F.lit(False))).drop(v_, v2_, label_, links_, component_)


#: Every pair of a label by brute force; the operator's cells miss few links at this similarity, and none on the tables this is held against.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM u UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, CAST(coalesce(c.c, e.vec_id) AS BIGINT) AS component_id, coalesce(c.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
