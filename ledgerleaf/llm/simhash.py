"""SimHash fingerprints, linked by pivot distance tables.

Equal fingerprints are one node, so copies cost nothing further. Two fingerprints within `bits` differ in none of at least one
of bits + 1 blocks, and, of the rest, in none of at least one of bits + 1 smaller blocks: each node is dealt once for each
such pair of blocks, and nodes that may link meet in some group, whatever the data. In a group the distances of
every fingerprint to the reference fingerprints are tabled; pairs whose coordinates differ by more than `bits` anywhere are
discarded, and the rest are verified. A group larger than LEAF is split again by the bits not yet used, so no group's
cost is quadratic, and only the links of a spanning forest leave it.

similar_groups() is for similarities at which too many bits differ for blocks: there texts meet where they share a shingle of their prefixes, the
part of each set in which two sets alike enough must meet, and what sizes and histograms don't rule out is decided by the shingles themselves.
Both are looked for in groups of any size, see in_groups().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, quoted, small_batches, stored, unused, without
from .components import components

#: Fingerprints in a group that are compared at once.
LEAF = 1024
#: Reference fingerprints.
PIVOTS = 16


def shingles(text: str | None, words: int) -> np.ndarray:
    """XXH64 of a text's shingles in order, repeats included, A-Z as a-z. No word: none; fewer than `words`: one shingle."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()][:n]
    stops = ends[min(words, len(parts)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def simhash(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero without any."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        part = hashes[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's shingles."""
    return simhash(shingles(text, words))


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", words: int = 3) -> DataFrame:
    """Adds the fingerprint as a signed long. Null texts count as empty."""
    small_batches(df.sparkSession)

    @F.arrow_udf("long")
    def printed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.array([fingerprint(t.as_py(), words) for t in batch], np.uint64).view(np.int64))

    return without(df, out).withColumn(out, printed(quoted(text).cast("string")))


def masks(total: int, parts: int) -> list[int]:
    """Masks of `parts` runs of the set bits of total, as even as can be."""
    places = [i for i in range(64) if total >> i & 1]
    return [sum(1 << i for i in places[k * len(places) // parts : (k + 1) * len(places) // parts]) for k in range(parts)]


ALL = (1 << 64) - 1


class Forest:
    """Union-find over positions in a group; keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((i, j))


def compare(points: np.ndarray, at: np.ndarray, table: np.ndarray, bits: int, forest: Forest) -> None:
    """Links those of points[at] within bits of each other; at is sorted by the first coordinate of the pivots' table."""
    first = table[at, 0]
    stop = np.searchsorted(first, first + bits, side="right")
    for i in range(len(at) - 1):
        if stop[i] <= i + 1:
            continue
        near = at[i + 1 : stop[i]]
        near = near[(np.abs(table[near] - table[at[i]]) <= bits).all(axis=1)]
        for j in near[np.bitwise_count(points[near] ^ points[at[i]]) <= bits].tolist():
            forest.join(int(at[i]), j)


def pivot_distances(points: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """The Hamming distances of fingerprints to the reference fingerprints, a row for each."""
    refs = np.random.default_rng(64).integers(0, 1 << 64, pivots, dtype=np.uint64)
    return np.bitwise_count(points[:, None] ^ refs[None, :])


def forest_of(points: np.ndarray, table: np.ndarray, bits: int, used: int, leaf: int = LEAF) -> list[tuple[int, int]]:
    """Links that connect all of a group's points (distinct, alike in the used bits) that paths of steps of at most `bits` connect.

    table: their pivot distances.
    """
    table = table.astype(np.int16)
    forest = Forest(len(points))
    todo = [(np.arange(len(points)), used)]
    while todo:
        at, used = todo.pop()
        free = ALL & ~used
        if len(at) <= leaf or free.bit_count() <= bits:
            if free.bit_count() <= bits:  # all of them are within bits of one another
                for i in at[1:].tolist():
                    forest.join(int(at[0]), i)
            else:
                compare(points, at[np.argsort(table[at, 0], kind="stable")], table, bits, forest)
            continue
        for mask in masks(free, bits + 1):
            part = points[at] & np.uint64(mask)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order])) + 1
            todo += [(x, used | mask) for x in np.split(at[order], cuts) if len(x) > 1]
    return forest.links


def links(nodes: DataFrame, bits: int = 3, leaf: int = LEAF, pivots: int = PIVOTS) -> DataFrame:
    """nodes: distinct fingerprints in column fp. Returns links (a, b) that connect what fingerprints within `bits` connect."""
    keys = [(m, s) for m in masks(ALL, bits + 1) for s in masks(ALL & ~m, bits + 1)]
    used = [m | s for m, s in keys]
    signed = [int(np.uint64(u).view(np.int64)) for u in used]

    @F.arrow_udf("binary")
    def distances(fps: pa.Array) -> pa.Array:
        rows = pivot_distances(fps.to_numpy(zero_copy_only=False).view(np.uint64), pivots)
        return pa.array([r.tobytes() for r in rows], pa.binary())

    tabled = nodes.select("fp", distances("fp").alias("far"))
    dealt = tabled.select("fp", "far", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(u)) for u in signed])).alias("k", "part"))
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = dealt.repartition(parts, "k", "part").sortWithinPartitions("k", "part")

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(k: int, held: list[tuple[np.ndarray, np.ndarray]], out: list) -> None:
            x = np.concatenate([p for p, _ in held])
            if len(x) > 1:
                pairs = forest_of(x, np.concatenate([t for _, t in held]), bits, used[k], leaf)
                if pairs:
                    i = np.array(pairs)
                    out.append((x[i[:, 0]], x[i[:, 1]]))

        held, at = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list = []
            fp = batch.column("fp").to_numpy().view(np.uint64)
            far = np.frombuffer(b"".join(batch.column("far").to_pylist()), np.uint8).reshape(len(fp), pivots)
            k, part = batch.column("k").to_numpy(), batch.column("part").to_numpy()
            cuts = np.flatnonzero((np.diff(k) != 0) | (np.diff(part) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)], strict=True):
                key = (int(k[a]), int(part[a]))
                if key != at:
                    if held:
                        linked(at[0], held, out)
                    held, at = [], key
                held.append((fp[a:b], far[a:b]))
            yield from packed(out)
        out = []
        if held:
            linked(at[0], held, out)
        yield from packed(out)

    def packed(out: list) -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out]).view(np.int64)) for i in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(grouped, "a long, b long").distinct()


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = 3, bits: int = 3, leaf: int = LEAF) -> DataFrame:
    """Adds fp (signed long) and component_id: the least non-null key that links of at most `bits` differing bits reach.

    Every row comes back, repeated rows and rows with a null key too; component_id is null only where a whole
    component has no key. Null and empty texts have fingerprint zero and link like any other. Very long texts are hashed whole, in parts.
    An empty table gives an empty one. Columns called fp or component_id give way.
    """
    prints = stored(fingerprints(without(df, "fp", "component_id"), text, "fp", words))
    nodes = stored(prints.groupBy("fp").agg(F.min(quoted(key)).alias("least")))
    found = components(links(nodes.select("fp"), bits, leaf))
    named = nodes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(named.join(least, "root").select("fp", "component_id"))
    forget(nodes, found)
    return prints.join(named, "fp")


def first_of_groups(df: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = 3, bits: int = 3, leaf: int = LEAF) -> DataFrame:
    """One row of each of near_groups()' groups: one with the least key, or any where the whole group has none. All columns stay.

    Of rows repeated one stays, of null and empty texts too. What is grouped and linked is keys and fingerprints; texts are only stored, once, and
    dealt once more to be met by the rows that stay. An empty table gives an empty one.
    """
    uid, = unused(df, "_uid")
    rows = stored(df.withColumn(uid, F.monotonically_increasing_id()))
    some = rows.select(F.col(uid).alias("uid"), quoted(key).alias("key"), quoted(text).cast("string").alias("text"))
    prints = stored(fingerprints(some, "text", "fp", words).select("uid", "key", "fp"))
    first = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("uid").alias("uid"))
    nodes = stored(prints.groupBy("fp").agg(F.min(first).alias("first")))
    found = components(links(nodes.select("fp"), bits, leaf))
    named = nodes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left")
    best = stored(named.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.uid").alias(uid)))
    forget(prints, nodes, found)
    # best has a row for each group, so its size has no bound and it isn't sent to all, whatever its size is just now
    return rows.join(best.hint("merge"), uid, "left_semi").drop(uid)


# ---- lower similarities

#: Rows that share a shingle, and shingles of texts that are to be verified together, beyond which a group is dealt in blocks.
ROWS, SHINGLES = 1000, 1 << 20
#: Rows of such a group that all its blocks have, on average.
LEADERS = 16
#: Shingles put last in prefixes, at most; counters in a histogram.
HOT, COUNTERS = 100_000, 128
#: What orders shingles differently.
ORDERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def prefix_length(n: int, similarity: float) -> int:
    """How many of n shingles, the first in an order that holds for all texts, any set alike by `similarity` has one of among its own first."""
    return n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0


def prefix(known: np.ndarray, similarity: float, hot: np.ndarray) -> np.ndarray:
    """The prefix of distinct sorted shingles; the order is by hash, but those in hot (distinct, sorted) come last."""
    n = prefix_length(len(known), similarity)
    if not len(hot) or not n:
        return known[:n]
    late = hot[np.minimum(np.searchsorted(hot, known), len(hot) - 1)] == known
    return np.concatenate([known[~late], known[late]])[:n]


def histogram(known: np.ndarray) -> bytes:
    """How many of a set's shingles fall to each counter, 255 at most; two sets differ in at least as many shingles as their histograms."""
    return np.minimum(np.bincount((known >> np.uint64(32)).astype(np.int64) % COUNTERS, minlength=COUNTERS), 255).astype(np.uint8).tobytes()


def least_of(known: np.ndarray) -> np.ndarray:
    """A set's least shingle in each of a few orders, told apart by the order's number."""
    out = np.empty(len(ORDERS) if len(known) else 0, np.uint64)
    for k in range(len(out)):
        x = known * ORDERS[k]
        out[k] = (x ^ (x >> np.uint64(31))).min() // np.uint64(len(ORDERS)) * np.uint64(len(ORDERS)) + np.uint64(k)
    return out


def connected(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of n rows; near(i, rest) tells which of the rows in rest are linked to row i.

    Each row is compared with all that no tree has reached yet, so no link is missed that a forest could need; where most rows are linked
    few are left after the first.
    """
    rest = np.arange(n)
    while len(rest):
        todo, rest = [int(rest[0])], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            hit = near(i, rest)
            if hit.any():
                found, rest = rest[hit].tolist(), rest[~hit]
                todo += found
                yield from ((i, j) for j in found)


def crossing(asked: np.ndarray, others: np.ndarray, label: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links between the rows asked and others that connect what links between them connect, beyond what one label says is connected already."""
    label = label.copy()
    for i in asked.tolist():
        rest = others[label[others] != label[i]]
        for j in rest[near(i, rest)].tolist() if len(rest) else ():
            if label[j] != label[i]:
                yield i, j
                label[label == label[j]] = label[i]


def may_be_near(sizes: np.ndarray, counts: np.ndarray, similarity: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """For connected(): whether sizes and histograms of two sets don't rule out that they are alike by similarity."""
    share = (1 - similarity) / (1 + similarity)

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(rest), bool)
        for k in range(0, len(rest), 1 << 14):
            part = rest[k : k + (1 << 14)]
            at = np.flatnonzero(np.minimum(sizes[part], sizes[i]) >= similarity * np.maximum(sizes[part], sizes[i]) - 1e-6)
            apart = np.abs(counts[part[at]].astype(np.int16) - counts[i].astype(np.int16)).sum(axis=1, dtype=np.int64)
            hit[k + at[apart <= share * (sizes[part[at]] + sizes[i]) + 1e-6]] = True
        return hit

    return near


def is_near(sets: list[np.ndarray], similarity: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """For connected(): whether the Jaccard similarity of two sets (distinct, sorted) is as given or more, exactly."""
    sizes = np.array([len(s) for s in sets], np.int64)

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(rest), bool)
        at = np.flatnonzero(np.minimum(sizes[rest], sizes[i]) >= similarity * np.maximum(sizes[rest], sizes[i]) - 1e-6)
        for k in at.tolist():
            other = sets[rest[k]]
            both = int((sets[i][np.minimum(np.searchsorted(sets[i], other), sizes[i] - 1)] == other).sum()) if sizes[i] else 0
            hit[k] = both >= similarity * (sizes[i] + len(other) - both) - 1e-9
        return hit

    return near


def by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[list, list[tuple]]]:
    """The other columns' rows of each key of batches sorted by it, once the key is over."""
    held, at = [], None
    for batch in batches:
        rest = [c for c in batch.schema.names if c not in keys]
        known = zip(*(batch.column(c).to_pylist() for c in keys), strict=True)
        for key, row in zip(known, zip(*(batch.column(c).to_pylist() for c in rest), strict=True), strict=True):
            if key != at:
                if held:
                    yield at, held
                held, at = [], key
            held.append(row)
    if held:
        yield at, held


def shared_prefixes(spots: DataFrame) -> DataFrame:
    """(s, n): the shingles that stand in the prefixes of n > 1 nodes. spots: columns uid and s."""
    return spots.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


Nearness = Callable[[list[tuple]], Callable[[int, np.ndarray], np.ndarray]]


def _linked(held: list[tuple], found: Iterator[tuple[int, int]]) -> pa.RecordBatch:
    at = list(found)
    return pa.RecordBatch.from_arrays([pa.array([held[p[i]][0] for p in at], pa.int64()) for i in (0, 1)], ["a", "b"])


def _parts(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def first_links(rows: DataFrame, large: DataFrame, nearness: Nearness, payload: list[str], leaders: int = LEADERS) -> DataFrame:
    """Links (a, b) that connect what links within a group connect, but for large groups: these are dealt in blocks of rows at random, all
    of which have a few leaders in common. Where most rows of such a group are linked that connects them.

    rows: g (the group), uid and payload columns, of which nearness makes the near() of connected(). large: g, n (rows) and blocks.
    """
    random = (F.xxhash64("uid", F.lit(1)).cast("double") / float(1 << 64)) + 0.5
    own = F.array(F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    each = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).when(random < leaders / F.col("n"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_key(batches, ["g", "block"]):
            if len(held) > 1:
                yield _linked(held, connected(len(held), nearness([x[1:] for x in held])))

    dealt = rows.join(large, "g", "left").select("g", F.explode(each).alias("block"), "uid", *payload)
    return dealt.repartition(_parts(rows), "g", "block").sortWithinPartitions("g", "block", "uid").mapInArrow(linked, "a long, b long").distinct()


def missing_links(rows: DataFrame, values: DataFrame, roots: DataFrame, nearness: Nearness, payload: list[str], most: int) -> DataFrame | None:
    """Links (a, b) that, with those that gave roots (uid, root), connect all that links within a group connect; None if there is nothing to compare.

    rows: g, uid; values: uid, w (a row's weight) and payload columns. Groups that roots connect already drop out before any payload is fetched. Of
    the others all rows but those of the group's largest part are compared with the whole group, block by block, so no task holds more than two
    blocks, of weight `most`.
    """
    named = rows.join(roots, "uid", "left").select("g", "uid", F.coalesce("root", "uid").alias("root"))
    wide = named.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("g")
    named = stored(named.join(wide, "g", "left_semi").join(values.select("uid", "w"), "uid"))
    labels = named.groupBy("g", "root").agg(F.sum("w").alias("w"))
    spread = labels.groupBy("g").agg(F.max_by("root", F.struct("w", "root")).alias("main"), F.sum("w").alias("all"), F.max("w").alias("most"))
    spread = stored(spread.select("g", "main", F.ceil(F.col("all") / most).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("most")) / most).cast("int").alias("asks")))
    if spread.isEmpty():
        forget(named, spread)
        return None
    both = named.join(spread, "g")
    place = lambda n: F.pmod(F.xxhash64("uid"), F.col(n)).cast("int")
    asked = both.where("root <> main").select("g", "uid", "root", F.lit(True).alias("asked"), place("asks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    others = both.select("g", "uid", "root", F.lit(False).alias("asked"), F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("i"), place("blocks").alias("j"))
    met = asked.unionByName(others).join(values.select("uid", *payload), "uid").select("g", "i", "j", "uid", "asked", "root", *payload)

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in by_key(batches, ["g", "i", "j"]):
            ask = np.array([x[1] for x in held])
            label = np.unique(np.array([x[2] for x in held]), return_inverse=True)[1]
            yield _linked(held, crossing(np.flatnonzero(ask), np.flatnonzero(~ask), label, nearness([x[3:] for x in held])))

    found = stored(met.repartition(_parts(rows), "g", "i", "j").sortWithinPartitions("g", "i", "j", "uid").mapInArrow(crossed, "a long, b long").distinct())
    forget(named, spread)
    return found


def in_groups(groups: DataFrame, values: DataFrame, nearness: Nearness, payload: list[str], most: int, *, leaders: int = LEADERS, wanted: DataFrame | None = None) -> DataFrame:
    """(uid, root): what links between rows of one group connect; root is a uid, rows without a link may be missing.

    groups: g, uid; values: uid, w and payload, once for each uid. Groups that weigh more than `most` go out in blocks first, and what that leaves
    apart is compared then, so no link is missed, and no task holds more than two blocks. wanted: further groups, of which only
    what the others don't connect is compared.
    """
    large = groups.join(values.select("uid", "w"), "uid").groupBy("g").agg(F.sum("w").alias("all"), F.count(F.lit(1)).alias("n")).where(F.col("all") > most)
    large = stored(large.select("g", "n", F.ceil(F.col("all") / most).cast("int").alias("blocks")))
    links = stored(first_links(groups.join(values.select("uid", *payload), "uid"), large, nearness, payload, leaders))
    roots = rooted(links)
    todo = [] if large.isEmpty() else [groups.join(large.select("g"), "g", "left_semi")]
    if wanted is not None:
        todo.append(wanted)
    for rows in todo:
        more = missing_links(rows, values, roots, nearness, payload, most)
        if more is not None:
            after = stored(links.unionByName(more))
            forget(links, roots, more)
            links = after
            roots = rooted(links)
    forget(links, large)
    return roots


def rooted(links: DataFrame) -> DataFrame:
    """(uid, root) of links, stored."""
    found = components(links)
    out = stored(found.select(F.col("node").alias("uid"), "root"))
    forget(found)
    return out


def frequent(counts: DataFrame, most: int) -> np.ndarray:
    """The shingles that stand in the most prefixes, at most `most` of them, sorted. Where to stop is read off a histogram, so no more reach the driver."""
    level = F.floor(8 * F.log2("n")).cast("int")
    bound, total = None, 0
    for k, n in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        total += n
        if total > most:
            break
        bound = k
    if bound is None:
        return np.zeros(0, np.uint64)
    return np.sort(counts.where(level >= bound).select("s").toArrow().column("s").to_numpy().view(np.uint64))


def similar_groups(df: DataFrame, key: str = "doc_id", text: str = "text", *, words: int = 5, similarity: float = 0.8, most: tuple[int, int] = (ROWS, SHINGLES)) -> DataFrame:
    """Adds component_id and kept, for groups of texts that links of Jaccard similarity `similarity` or more of their shingles connect.

    component_id is the group's least key, null where the whole group has none; kept is true for one row of each group, one with that
    key. Null and empty texts are one group; texts alike but for case and white space always are. Every row comes back, rows repeated too. Columns
    called like the new ones give way; others stay. An empty table gives an empty one. Very long texts count whole. Links are exact but
    for hash collisions. most: what a task compares at a time, rows that share a shingle and shingles of texts to be verified.
    """

    small_batches(df.sparkSession)
    sc = df.sparkSession.sparkContext
    hashed = lambda t: np.unique(shingles(t, words))
    longs = lambda sets: pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))

    @F.arrow_udf("struct<fp:binary,p:array<long>>")
    def sketched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            fps, firsts = [], []
            for t in batch:
                known = hashed(t.as_py())
                fps.append(xxhash.xxh3_128_digest(known.tobytes()))
                firsts.append(prefix(known, similarity, known[:0]).copy())
            yield pa.StructArray.from_arrays([pa.array(fps, pa.binary()), longs(firsts)], ["fp", "p"])

    base = without(df, "component_id", "kept")
    uid_, best_ = unused(base, "_uid", "_best")
    rows = stored(base.withColumn(uid_, F.monotonically_increasing_id()))
    texts = rows.select(F.col(uid_).alias("uid"), quoted(text).cast("string").alias("t"))
    prints = stored(rows.select(F.col(uid_).alias("uid"), quoted(key).alias("key"), sketched(quoted(text).cast("string")).alias("s")).select("uid", "key", "s.fp", "s.p"))
    first = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("key"), F.col("uid").alias("uid"))
    nodes = stored(prints.groupBy("fp").agg(F.min(first).alias("_first")).withColumn("uid", F.col("_first.uid")))

    # a node that shares no shingle of its prefix is alone; of the others, frequent shingles go to the prefix's end
    spots = prints.select("uid", "p").join(nodes.select("uid"), "uid", "left_semi").select("uid", F.explode("p").alias("s"))
    counts = stored(shared_prefixes(spots))
    near = spots.join(counts, "s", "left_semi").select("uid").distinct()
    sent = sc.broadcast(frequent(counts, HOT))

    @F.arrow_udf("struct<p:array<long>,least:array<long>,size:long,counts:binary>")
    def described(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets = [hashed(t.as_py()) for t in batch]
            firsts, least = longs([prefix(s, similarity, sent.value) for s in sets]), longs([least_of(s) for s in sets])
            sizes, found = pa.array([len(s) for s in sets], pa.int64()), pa.array([histogram(s) for s in sets], pa.binary())
            yield pa.StructArray.from_arrays([firsts, least, sizes, found], ["p", "least", "size", "counts"])

    some = stored(texts.join(near, "uid").withColumn("d", described("t")).select("uid", F.lit(1).alias("w"), "d.*"))

    def by_histograms(held: list[tuple]):
        sizes, found = zip(*held, strict=True)
        return may_be_near(np.array(sizes), np.frombuffer(b"".join(found), np.uint8).reshape(len(held), -1), similarity)

    # most that may be alike share the least shingle in one of a few orders; what these leave apart must share one of the prefix
    few = some.select(F.explode("least").alias("g"), "uid")
    spots = some.select(F.explode("p").alias("s"), "uid")
    wanted = spots.join(shared_prefixes(spots).select("s"), "s", "left_semi").select(F.col("s").alias("g"), "uid")
    maybe = in_groups(few, some.select("uid", "w", "size", "counts"), by_histograms, ["size", "counts"], most[0], wanted=wanted)

    # of what may be alike, the shingles themselves decide
    @F.arrow_udf("binary")
    def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([hashed(t.as_py()).tobytes() for t in batch], pa.binary())

    values = some.select("uid", F.col("size").alias("w")).join(maybe.select("uid"), "uid", "left_semi").join(texts, "uid").select("uid", "w", known("t").alias("known"))
    roots = in_groups(maybe.select(F.col("root").alias("g"), "uid"), values, lambda x: is_near([np.frombuffer(k, np.uint64) for (k,) in x], similarity), ["known"], most[1])
    named = stored(nodes.join(roots, "uid", "left").select("fp", "_first", F.coalesce("root", "uid").alias("_root")))
    least = named.groupBy("_root").agg(F.min("_first").alias("best"))
    best = stored(prints.select("uid", "fp").join(named.join(least, "_root").select("fp", "best"), "fp").select(F.col("uid").alias(uid_), F.col("best").alias(best_)))
    forget(prints, nodes, counts, some, maybe, roots, named)
    # best has a row for each document, so its size has no bound and it isn't sent to all, whatever its size is just now
    out = rows.join(best.hint("merge"), uid_).withColumns({"component_id": F.col(best_)["key"], "kept": F.col(uid_) == F.col(best_)["uid"]})
    return out.drop(uid_, best_)
