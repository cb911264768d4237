"""Removing repeated passages with a logarithmic family of suffix arrays.

A passage is any string of `length` bytes that starts at two places or more. Every such window holds one anchor: the place in
it where a hash of the next GRAM bytes is least, which depends on the window's own bytes only. The windows
of one anchor follow each other, so a text is a row of segments, about length / 2 windows each, and equal windows have equal anchors at equal
offsets. Segments that a text holds twice are settled in it, so a run of one byte is one segment and one range. Segments whose anchor's bytes stand
nowhere else are settled too; equal segments are counted together. What is left, one of each kind, goes to the family that holds its
anchor's hash: arrays of the suffixes and of the reversed prefixes at the anchors. A batch gets arrays of its own, is scanned merged with each
level, and levels of one size merge into the next. In a merged order, suffixes with d bytes in common are neighbours, so a window
occurs twice where two segments agree on o bytes before the anchor and length - o after it.

An anchor with many kinds of segment is dealt to several families: its offsets are halved, and segments meet in a half if they agree on the bytes
that all windows of that half have, and so on.

RepeatIndex keeps levels in the shared folder, so that later batches of documents meet them; cut_repeats() deals its documents to a few batches and takes
them through such an index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, quoted, small_batches, stored, unused, without

LENGTH, GRAM = 400, 64
#: Window starts of a text that are anchored together.
PIECE = 1 << 19
#: Segments that get suffix arrays together: the family's smallest level.
BATCH = 8192
#: Segments that one task's family is meant to hold.
FAMILY = 1 << 15
#: Kinds of segment on one anchor beyond which its offsets are halved.
HOT = 1024
#: Batches that a table goes through the index in: the second is scanned with the first's level and merges with it.
BATCHES = 2
BASE = 0x9E3779B97F4A7C15 | 1
ODD = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64."""
    out = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= ODD[0]
    x ^= x >> np.uint64(29)
    x *= ODD[1]
    x ^= x >> np.uint64(32)
    return x


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(x)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    rows = full.reshape(-1, width)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - width + 1], head[width - 1 : n])


def settled(x: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """x: segments with i (whose text they are) and n (how often they stand there). Those alike in i and c as one, the first, with their n added up;
    and the windows (i, a, b) of those that stand twice or more, as maximal ranges."""
    order = np.lexsort((x["p"], x["c"], x["i"]))
    i, c = x["i"][order], x["c"][order]
    first = np.ones(len(order), bool)
    first[1:] = (i[1:] != i[:-1]) | (c[1:] != c[:-1])
    group = np.cumsum(first) - 1
    n = np.bincount(group, x["n"][order], int(first.sum())).astype(np.int64)
    kept = order[first]
    out = {k: v[kept] for k, v in x.items()} | {"n": n}
    twice = np.sort(order[n[group] > 1])
    return out, ranges(*(x[k][twice] for k in "iab"))


def ranges(i: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
    """Ranges a to b of texts i, joined where they touch or overlap."""
    order = np.lexsort((a, i))
    i, a, b = i[order], a[order], b[order]
    if not len(i):
        return {"i": i, "a": a, "b": b}
    wide = int(b.max()) + 2
    reach = np.maximum.accumulate(i * wide + b)
    start = np.ones(len(i), bool)
    start[1:] = i[1:] * wide + a[1:] > reach[:-1] + 1
    start[1:] |= i[1:] != i[:-1]
    at = np.flatnonzero(start)
    return {"i": i[at], "a": a[at], "b": reach[np.append(at[1:], len(i)) - 1] - i[at] * wide}


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, piece: int = PIECE, distinct: bool = True) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The texts' segments: i (which text), h (hash of the anchor's bytes), c (hash of the segment), n (how often it stands in that text), p (the
    anchor's place), a and b (its first and last window); and the ranges (i, a, b) of windows that occur twice within a text. Unless
    distinct, every segment is there, and no ranges are."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in "ihcpabn"}
    twice: dict[str, list[np.ndarray]] = {k: [] for k in "iab"}
    entries: list[tuple[int, int, bytes]] = []
    held = 0

    def run() -> None:
        nonlocal held
        if not entries:
            return
        data = np.frombuffer(b"".join(e[2] for e in entries), np.uint8)
        sizes = np.array([len(e[2]) for e in entries])
        starts = np.cumsum(sizes) - sizes
        n = len(data)
        up, down = powers(1 << max(16, (n + 1).bit_length()))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        grams = mixed((total[gram:] - total[:-gram]) * down[: n - gram + 1])
        bits = np.uint64(n.bit_length())
        ranked = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)  # ties go to the first
        place = (sliding_least(ranked, length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        inside = np.zeros(len(place) + 1, np.int8)
        inside[starts] += 1
        np.subtract.at(inside, starts + sizes - length + 1, 1)
        inside = np.cumsum(inside[:-1]).astype(bool)
        first = inside.copy()
        first[1:] &= ~inside[:-1] | (place[1:] != place[:-1])
        first[starts] = True
        last = inside.copy()
        last[:-1] &= ~inside[1:] | (place[1:] != place[:-1])
        last[(starts + sizes - length)] = True
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        p = place[a]
        owner = np.searchsorted(starts, a, side="right") - 1
        moved = np.array([e[1] for e in entries])[owner] - starts[owner]
        whole = (total[b + length] - total[a]) * down[a]
        x = {"i": np.array([e[0] for e in entries])[owner], "h": grams[p], "c": mixed(whole ^ mixed((p - a).astype(np.uint64) * ODD[2] + (b - a).astype(np.uint64) * ODD[1]))}
        x |= {"p": p + moved, "a": a + moved, "b": b + moved, "n": np.ones(len(a), np.int64)}
        if distinct:
            x, more = settled(x)
            for k, v in more.items():
                twice[k].append(v)
        for k, v in x.items():
            out[k].append(v)
        entries.clear()
        held = 0

    for i, t in enumerate(texts):
        for q in range(0, max(0, len(t) - length + 1), piece):
            part = t[q : q + piece + length - 1]
            if held + len(part) > piece + length:
                run()
            entries.append((i, q, part))
            held += len(part)
    run()
    kinds = {"h": np.uint64, "c": np.uint64}
    x = {k: np.concatenate(v) if v else np.zeros(0, kinds.get(k, np.int64)) for k, v in out.items()}
    found = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in twice.items()}
    if distinct:
        x, more = settled(x)
        found = ranges(*(np.concatenate([found[k], more[k]]) for k in "iab"))
        order = np.lexsort((x["p"], x["i"]))
        x = {k: v[order] for k, v in x.items()}
    return x, found


# ---- the family


def neighbours(sorted_strings: list[bytes], width: int) -> np.ndarray:
    """Bytes in common of each string with the one before it (the first: 0)."""
    n = len(sorted_strings)
    out = np.zeros(n, np.int32)
    size = np.array([len(s) for s in sorted_strings], np.int32)
    for k in range(1, n, 8192):
        part = sorted_strings[k - 1 : k + 8192]
        rows = np.frombuffer(b"".join([s.ljust(width, b"\0") for s in part]), np.uint8).reshape(-1, width)
        differ = rows[1:] != rows[:-1]
        at = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        out[k : k + len(at)] = np.minimum(at, np.minimum(size[k - 1 : k + len(at) - 1], size[k : k + len(at)]))
    return out


class Level:
    """Segments by number, in the order of their suffixes at the anchor and in that of their reversed prefixes."""

    def __init__(self, forward: list[int], backward: list[int], rank: int):
        self.forward, self.backward, self.rank = forward, backward, rank


class Family:
    """before and after hold every segment's bytes before its anchor, reversed, and from it on."""

    def __init__(self, length: int = LENGTH, batch: int = BATCH):
        self.length, self.batch = length, batch
        self.before: list[bytes] = []
        self.after: list[bytes] = []
        self.hash: list[int] = []
        self.levels: list[Level] = []
        self.hits: list[np.ndarray] = []  # rows of offsets, in blocks
        self.kept: list[Level] = []  # levels from before, which don't merge here

    def load(self, segments: list[tuple[int, bytes, bytes]]) -> None:
        """Takes over a level that was made before, whose own windows have been compared: segments as for add(), in order of their suffixes."""
        lo = len(self.hash)
        self.hash += [s[0] for s in segments]
        self.before += [s[1][::-1] for s in segments]
        self.after += [s[2] for s in segments]
        for k in range(0, len(segments), self.batch):
            self.hits.append(np.zeros((min(self.batch, len(segments) - k), self.length + 1), bool))
        own = range(lo, len(self.hash))
        self.kept.append(Level(sorted(own, key=self.after.__getitem__), sorted(own, key=self.before.__getitem__), -1))

    def add(self, segments: list[tuple[int, bytes, bytes]]) -> None:
        """segments: (anchor's hash, bytes before it, bytes from it on)."""
        for k in range(0, len(segments), self.batch):
            part = segments[k : k + self.batch]
            lo = len(self.hash)
            self.hash += [s[0] for s in part]
            self.before += [s[1][::-1] for s in part]
            self.after += [s[2] for s in part]
            self.hits.append(np.zeros((len(part), self.length + 1), bool))
            own = range(lo, len(self.hash))
            new = Level(sorted(own, key=self.after.__getitem__), sorted(own, key=self.before.__getitem__), 0)
            self.scan(new.forward, new.backward)
            here = {self.hash[i] for i in own}
            for level in (*self.kept, *self.levels):
                there = {i for i in level.forward if self.hash[i] in here}
                if there:
                    also = {self.hash[i] for i in there}
                    both = [[i for i in mine if self.hash[i] in also] + [i for i in theirs if i in there] for mine, theirs in ((new.forward, level.forward), (new.backward, level.backward))]
                    # sorting two sorted runs is merging them
                    self.scan(sorted(both[0], key=self.after.__getitem__), sorted(both[1], key=self.before.__getitem__))
            while self.levels and self.levels[-1].rank == new.rank:
                old = self.levels.pop()
                new = Level(sorted(old.forward + new.forward, key=self.after.__getitem__), sorted(old.backward + new.backward, key=self.before.__getitem__), new.rank + 1)
            self.levels.append(new)

    def scan(self, forward: list[int], backward: list[int]) -> None:
        """Marks the windows that occur twice among the segments of two merged orders."""
        n = len(forward)
        if n < 2:
            return
        ids = np.sort(np.array(forward))
        right, left = np.searchsorted(ids, forward), np.searchsorted(ids, backward)
        r = np.array([len(self.after[i]) for i in ids])
        l = np.array([len(self.before[i]) for i in ids])  # noqa: E741
        common_r = neighbours([self.after[i] for i in forward], self.length)
        common_l = neighbours([self.before[i] for i in backward], self.length)
        # segments without a neighbour that has the anchor's own bytes too have no window in common with any
        class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
        hit = np.zeros((n, self.length + 1), bool)
        for o in range(int(l.max()) + 1):
            d = self.length - o
            sel = np.flatnonzero((l >= o) & (r >= d))
            if len(sel) < 2:
                continue
            class_r[right] = np.cumsum(common_r < d)
            class_l[left] = np.cumsum(common_l < o)
            key = class_l[sel] << 32 | class_r[sel]
            order = np.argsort(key, kind="stable")
            same = np.diff(key[order]) == 0
            if same.any():
                hit[sel[order[:-1][same]], o] = True
                hit[sel[order[1:][same]], o] = True
        begin = 0
        for block in self.hits:
            lo, hi = np.searchsorted(ids, [begin, begin + len(block)])
            if hi > lo:
                block[ids[lo:hi] - begin] |= hit[lo:hi]
            begin += len(block)


# ---- the operator

RANGES = "array<struct<a:int,b:int>>"
ANCHORS = "array<struct<h:long,c:long,n:long,p:int,a:int,b:int>>"


def lists(x: dict[str, np.ndarray], n: int, kinds: dict[str, pa.DataType]) -> pa.Array:
    """Structs as a list for each of n texts; x is in order of i."""
    flat = pa.StructArray.from_arrays([pa.array(x[k].view(np.int64) if x[k].dtype == np.uint64 else x[k], t) for k, t in kinds.items()], list(kinds))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(x["i"], np.arange(n + 1)).astype(np.int32)), flat)


def anchored_udf(length: int, gram: int):
    @F.arrow_udf(f"struct<n:long,z:binary,anchors:{ANCHORS},twice:{RANGES}>")
    def anchored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pack = zstandard.ZstdCompressor(level=1)
        small = {k: pa.int32() for k in "pab"}
        for batch in batches:
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in batch]
            x, twice = anchors(texts, length, gram)
            parts = [lists(x, len(texts), {k: pa.int64() for k in "hcn"} | small), lists(twice, len(texts), {k: small[k] for k in "ab"})]
            yield pa.StructArray.from_arrays([pa.array([len(t) for t in texts], pa.int64()), pa.array([pack.compress(t) for t in texts], pa.binary()), *parts], ["n", "z", "anchors", "twice"])

    return anchored


def segments_of(joined: DataFrame, length: int) -> DataFrame:
    """joined: z, and needs (h, c, p, a, b). Returns h, c, left, right: a segment's bytes before and from its anchor."""

    @F.arrow_udf("array<struct<h:long,c:long,left:binary,right:binary>>")
    def cut(z: pa.Array, needs: pa.Array) -> pa.Array:
        unpack = zstandard.ZstdDecompressor()
        flat, counts = needs.flatten(), needs.value_lengths().to_numpy(zero_copy_only=False)
        places = zip(*(flat.field(k).to_pylist() for k in ("p", "a", "b")), strict=True)
        left, right = [], []
        for packed, count in zip(z, counts.tolist(), strict=True):
            data = unpack.decompress(packed.as_py())
            for _ in range(count):
                p, a, b = next(places)
                left.append(data[a:p])
                right.append(data[p : b + length])
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        parts = [flat.field("h"), flat.field("c"), pa.array(left, pa.binary()), pa.array(right, pa.binary())]
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(parts, ["h", "c", "left", "right"]))

    return joined.select(F.explode(cut("z", "needs")).alias("s")).select("s.*")


def dealt(segments: DataFrame, length: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """segments: h, c, level, left, right. The same with g and split: rows with one g are to meet, at most `hot` of them. And h, c, bits of windows
    that several segments hold, found on the way.

    A group that is too large goes to two, one for either half of its offsets: segments meet there if they agree on all bytes that the windows
    at those offsets share. Of those that agree on all bytes of all windows there one goes on, and the others are done. Down to one offset that
    is the window itself. Each round only takes on what was too large in the one before.
    """
    rows = segments.select("*", F.col("h").alias("g"), F.lit(0).alias("lo"), F.lit(length).alias("hi"))
    done, same, split = [], None, False
    while True:
        sizes = stored(rows.groupBy("g", "lo", "hi").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
        big = sizes.where(F.col("size") > hot)
        last = big.isEmpty()
        keep = sizes if last else sizes.where(F.col("size") <= hot)
        done.append(rows.join(keep.select("g", "lo", "hi"), ["g", "lo", "hi"], "left_semi").withColumn("split", F.lit(split)))
        if last:
            break
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi").alias("hi")))
        rows = rows.join(big.select("g", "lo", "hi"), ["g", "lo", "hi"], "left_semi").where("lo < hi")
        rows = rows.withColumn("half", F.explode(halves)).drop("lo", "hi").select("*", "half.lo", "half.hi").drop("half")
        rows = rows.where((F.octet_length("left") >= F.col("lo")) & (F.octet_length("right") >= length - F.col("hi")))
        bytes_ = lambda l, r: (F.expr(f"substring(left, greatest(octet_length(left) - {l} + 1, 1), least(octet_length(left), {l}))"), F.expr(f"substring(right, 1, {length} - {r})"))
        core, region = bytes_("lo", "hi"), bytes_("hi", "lo")
        rows = rows.withColumn("g", F.xxhash64("g", "lo", *core))
        rows = stored(rows.withColumn("r", F.xxhash64("g", *region, F.octet_length(region[0]), F.octet_length(region[1]))))
        alike = rows.groupBy("g", "lo", "hi", "r").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("level", "h", "c")).alias("one")).where("k > 1")
        both = stored(rows.select("g", "lo", "hi", "r", "level", "h", "c", F.octet_length("left").alias("l"), F.octet_length("right").alias("n")).join(alike, ["g", "lo", "hi", "r"]))
        hit = both.select("h", "c", bits_between(length)(F.greatest("lo", length - F.col("n")), F.least("hi", "l")).alias("bits"))
        same = hit if same is None else same.unionByName(hit)
        others = both.where("level <> one.level or h <> one.h or c <> one.c").select("g", "lo", "hi", "level", "h", "c")
        rows = rows.join(others, ["g", "lo", "hi", "level", "h", "c"], "left_anti").drop("r")
        split = True
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out, same


def bits_between(length: int):
    @F.arrow_udf("binary")
    def bits(first: pa.Array, last: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(first.to_pylist(), last.to_pylist(), strict=True):
            row = np.zeros(length + 1, bool)
            row[a : b + 1] = True
            out.append(np.packbits(row).tobytes())
        return pa.array(out, pa.binary())

    return bits


def scanned(segments: DataFrame, length: int, batch: int, hot: int, parts: int) -> DataFrame:
    """segments: h, c, level (-1: new), left, right. h, c and bits, the offsets before the anchor of windows that occur in another segment, one
    of the two new. A family for each partition, and one for each part of an anchor that was split."""
    rows, same = dealt(segments, length, hot)
    rows = rows.select("split", "g", "level", "h", "c", "left", "right").repartition(parts, "g").sortWithinPartitions("split", "g", F.desc("level"), "right")

    def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scan(held: list[tuple]) -> pa.RecordBatch:
            """held: level, g, h, c, left, right; levels from before come first, in order."""
            family = Family(length, batch)
            old: dict[int, list[tuple]] = {}
            for x in held:
                old.setdefault(x[0], []).append(x)
            new = old.pop(-1, [])
            keys = []
            for part in old.values():
                family.load([(x[1], x[4], x[5]) for x in part])
                keys += part
            family.add([(x[1], x[4], x[5]) for x in new])
            keys += new
            out, at = [], 0
            for block in family.hits:
                bits = np.packbits(block, axis=1)
                out += [(keys[at + i][2], keys[at + i][3], bits[i].tobytes()) for i in np.flatnonzero(block.any(axis=1)).tolist()]
                at += len(block)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["h", "c", "bits"])

        held, at = [], None
        for part in batches:
            for split, *x in zip(*(part.column(k).to_pylist() for k in ("split", "level", "g", "h", "c", "left", "right")), strict=True):
                key = x[1] if split else None
                if key != at and held:
                    yield scan(held)
                    held = []
                at = key
                held.append(x)
        if held:
            yield scan(held)

    found = rows.mapInArrow(families, "h long, c long, bits binary")
    return found if same is None else found.unionByName(same)


def removal(n: int, twice: np.ndarray, hits: pa.StructArray, length: int) -> np.ndarray:
    """Which of n bytes are covered by windows that occur again. twice: rows a, b; hits: p, a, b and bits, null for all windows."""
    edge = np.zeros(n + 2, np.int32)
    if len(twice):
        np.add.at(edge, twice[:, 0], 1)
        np.subtract.at(edge, twice[:, 1] + length, 1)
    if len(hits):
        p, a, b = (hits.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in "pab")
        bits = hits.field("bits")
        all_ = bits.is_null().to_numpy(zero_copy_only=False)
        np.add.at(edge, a[all_], 1)
        np.subtract.at(edge, b[all_] + length, 1)
        some = np.flatnonzero(~all_)
        for k in range(0, len(some), 4096):
            at = some[k : k + 4096]
            found = np.unpackbits(np.frombuffer(b"".join(bits.take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1), axis=1)
            row, o = np.nonzero(found)
            start = p[at][row] - o
            np.add.at(edge, start, 1)
            np.subtract.at(edge, start + length, 1)
    return np.cumsum(edge[:n], dtype=np.int32) > 0


def finished_udf(length: int):
    @F.arrow_udf("struct<removed:long,kept:binary,spans:array<struct<start:long,end:long>>>")
    def finished(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        unpack = zstandard.ZstdDecompressor()
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for z, twice, hits in batches:
            removed, kept, ends, starts, stops = [], [], [0], [], []
            for packed, again, found in zip(z, twice, hits, strict=True):
                data = unpack.decompress(packed.as_py())
                again, found = again.values, found.values if found.is_valid else pa.array([])
                if not len(again) and not len(found):
                    removed.append(0), kept.append(data), ends.append(ends[-1])
                    continue
                own = np.stack([again.field(k).to_numpy(zero_copy_only=False) for k in "ab"], axis=1).astype(np.int64) if len(again) else np.zeros((0, 2), np.int64)
                gone = removal(len(data), own, found, length)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                removed.append(int(gone.sum()))
                kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
                starts.append(edge[::2]), stops.append(edge[1::2]), ends.append(ends[-1] + len(edge) // 2)
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (starts, stops)], fields=list(span))
            yield pa.StructArray.from_arrays([pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["removed", "kept", "spans"])

    return finished


NEW = ("n_bytes", "n_removed", "n_spans", "kept", "spans")


class RepeatIndex:
    """Documents that come in batches, and what repeats among all of them.

    add() takes a batch: segments on anchors that stand twice by now get arrays of their own, the batch's level, and are scanned merged with the
    levels there are; levels of like size merge into the next, so there are no more than a logarithm of them. repeats() gives every
    document of every batch without what repeats anywhere. All tables are in the shared folder, levels as runs in order of suffixes, an anchor's
    segments dealt over all of them.
    """

    def __init__(self, *, length: int = LENGTH, gram: int = GRAM, batch: int = BATCH, hot: int = HOT, keep: bool = True):
        self.length, self.gram, self.batch, self.hot, self.keep = length, gram, batch, hot, keep
        self.docs: list[DataFrame] = []
        #: The documents' own columns, and the names of uid, z, anchors and twice beside them, batch by batch.
        self.names: list[tuple[list[str], list[str]]] = []
        #: (rank, segments), the largest first.
        self.levels: list[tuple[int, DataFrame]] = []
        #: Of each batch: segments on anchors that it met, whoever's they are, and what repeats among them.
        self.live: list[DataFrame] = []
        self.found: list[DataFrame] = []
        #: How many levels each batch met, and how many were merged.
        self.met: list[int] = []
        self.merged = 0

    def add(self, df: DataFrame, text: str = "text") -> None:
        """Takes another batch of documents. Texts may be null; keys are not looked at."""
        spark = df.sparkSession
        small_batches(spark)
        base = without(df, *NEW)
        uid, at, z, anchors_, twice = own = unused(base, "_uid", "_at", "_z", "_anchors", "_twice")
        rest = [c for c in base.columns if c.lower() != text.lower()]
        got = base.withColumn(at, anchored_udf(self.length, self.gram)(quoted(text).cast("string")))
        got = got.select(F.monotonically_increasing_id().alias(uid), *map(quoted, rest), F.col(at)["n"].alias("n_bytes"), F.col(at)["z"].alias(z), F.col(at)["anchors"].alias(anchors_), F.col(at)["twice"].alias(twice))
        self.docs.append(stored(got))
        self.names.append((rest, [uid, z, anchors_, twice]))
        now = len(self.docs) - 1
        placed = self._placed(now)
        if now:
            touched = stored(placed.select("h").distinct())
            for b in range(now):
                placed = placed.unionByName(self._placed(b).join(touched, "h", "left_semi"))
        heads = placed.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("low"), F.max("c").alias("high")).where("k > 1")
        # stored, so that the join's own exchange deals both sides and can split an anchor that stands everywhere
        heads = stored(heads.select("h", (F.col("low") != F.col("high")).alias("mixed")))
        live = stored(placed.join(heads, "h"))
        kinds = live.where("mixed").groupBy("h", "c").agg(F.sum("n").alias("n"), F.min(F.struct("b_", "uid", "p", "a", "b")).alias("x"))
        kinds = stored(kinds.select("h", "c", "n", "x.*"))
        fresh, old = kinds, None
        self.met.append(len(self.levels))
        for rank, (_, level) in enumerate(self.levels):
            fresh = fresh.join(level.select("h", "c"), ["h", "c"], "left_anti")
            near = level.join(heads.where("mixed").select("h"), "h", "left_semi").withColumn("level", F.lit(rank))
            old = near if old is None else old.unionByName(near)
        segments = None
        for b in range(now + 1):
            uid, z, *_ = self.names[b][1]
            needs = fresh.where(F.col("b_") == b).groupBy(F.col("uid").alias(uid)).agg(F.collect_list(F.struct("h", "c", "p", "a", "b")).alias("needs"))
            part = segments_of(self.docs[b].select(uid, F.col(z).alias("z")).join(needs, uid), self.length)
            segments = part if segments is None else segments.unionByName(part)
        segments = stored(segments)
        n = segments.count()
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // FAMILY), 1)
        mine = segments.withColumn("level", F.lit(-1))
        found = scanned(mine if old is None else mine.unionByName(old), self.length, self.batch, self.hot, parts)
        found = stored(found.unionByName(kinds.where("n > 1").select("h", "c", F.lit(None).cast("binary").alias("bits"))))
        self.live.append(live)
        self.found.append(found)
        if self.keep and n:
            self._grow(segments, n, parts)
        forget(heads, kinds, segments)

    def _placed(self, b: int) -> DataFrame:
        uid, _, anchors_, _ = self.names[b][1]
        return self.docs[b].select(F.lit(b).alias("b_"), F.col(uid).alias("uid"), F.explode(anchors_).alias("x")).select("b_", "uid", "x.*")

    def _grow(self, segments: DataFrame, n: int, parts: int) -> None:
        """The new level, merged with those that are not larger by a power of two."""
        merged, gone = segments, []
        rank = lambda n: int(math.log2(max(1.0, n / self.batch)))
        while self.levels and self.levels[-1][0] <= rank(n):
            _, level = self.levels.pop()
            gone.append(level)
            self.merged += 1
            merged, n = merged.unionByName(level), n + level.count()
        self.levels.append((rank(n), stored(merged.repartition(max(parts, -(-n // FAMILY)), "h", "c").sortWithinPartitions("right"))))
        forget(*gone)

    def close(self) -> None:
        """Deletes the levels, once no batch is to come; what repeats() reads stays."""
        forget(*[level for _, level in self.levels])
        self.levels.clear()

    def repeats(self, b: int) -> DataFrame:
        """Batch b's documents, without their texts, and n_bytes, n_removed, n_spans, kept (the remaining bytes) and spans (start, end of each removed run)."""
        rest, (uid, z, _, twice) = self.names[b]
        hits = None
        for live, found in zip(self.live[b:], self.found[b:], strict=True):
            mine = live.where(F.col("b_") == b)
            part = mine.where("not mixed").select("uid", "p", "a", "b", F.lit(None).cast("binary").alias("bits"))
            part = part.unionByName(mine.where("mixed").join(found, ["h", "c"]).select("uid", "p", "a", "b", "bits"))
            hits = part if hits is None else hits.unionByName(part)
        hits_, done = unused(self.docs[b], "_hits", "_done")
        hits = hits.groupBy(F.col("uid").alias(uid)).agg(F.collect_list(F.struct("p", "a", "b", "bits")).alias(hits_))
        out = self.docs[b].select(uid, *map(quoted, rest), "n_bytes", z, twice).join(hits, uid, "left").withColumn(done, finished_udf(self.length)(z, twice, hits_))
        got = F.col(done)
        return out.select(*map(quoted, rest), "n_bytes", got["removed"].alias("n_removed"), F.size(got["spans"]).cast("long").alias("n_spans"), got["kept"].alias("kept"), got["spans"].alias("spans"))


def cut_repeats(df: DataFrame, text: str = "text", *, length: int = LENGTH, gram: int = GRAM, batch: int = BATCH, hot: int = HOT, batches: int = BATCHES, index: RepeatIndex | None = None) -> DataFrame:
    """df without `text`, and n_bytes, n_removed, n_spans, kept (the remaining bytes) and spans (start, end of each removed run).

    Bytes covered by a string of `length` bytes that also starts anywhere else in the table, the same text included, are removed, every copy of
    them. Null texts count as empty; shorter texts stay whole; rows repeated lose all passages of full length. Very long texts are read whole, in pieces.
    An empty table gives an empty one. Columns called like the new ones give way; others stay. Exact but for collisions of 64-bit hashes.
    Documents go through an index in `batches` batches, by a hash of their text; index: one of the caller's, with other settings or to look at afterwards.
    """
    index = index or RepeatIndex(length=length, gram=gram, batch=batch, hot=hot)
    for b in range(batches):
        index.add(df.where(F.pmod(F.xxhash64(quoted(text).cast("string")), F.lit(batches)) == b), text)
    index.close()
    out = index.repeats(0)
    for b in range(1, batches):
        out = out.unionByName(index.repeats(b))
    return out


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, i, md5(substr(x, 2 * i - 1, 800)) AS m FROM (SELECT r, x, unnest(range(1, len(x) // 2 - 398)) AS i FROM d)),
k AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
g AS (SELECT r, i, sum(CASE WHEN i - before <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM k),
s AS (SELECT r, min(i) AS a, max(i) + 399 AS b FROM g GROUP BY r, g),
t AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM s),
u AS (SELECT r, count(*) AS n_spans, sum(b - a + 1) AS n_removed, string_agg(substr(x, 2 * z + 1, 2 * (a - 1 - z)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept FROM t JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE kept END)) AS kept_sha256 FROM d LEFT JOIN u USING (r)
"""
