"""Removing passages that documents with smaller keys hold, by relative Lempel-Ziv parsing.

A passage is a window of `length` consecutive words. Every window holds one anchor, the place in it where a hash of the next GRAM words is least, which
depends on the window's own words only; the windows of one anchor follow each other, and with their words they are a block. Equal windows have
equal anchors, so blocks are indexed by their anchor's hash, and only those whose anchor stands in two documents go on. Of blocks that are
alike word by word, one is the reference, that of the document with the smallest key: later holders of it hold nothing else.

References of one anchor meet in one task, sorted by key, and each is parsed greedily against those before it: at each place the earliest
reference that starts with the same window gives a factor, extended as far as the two agree. Ranks of 1, 2, 4, ... words, made by doubling, find both. The next place
is the first window that crosses the factor's end, so windows on the boundary of two factors are looked up too; where nothing starts, the parse goes on by a word.
Factors, all of them at least `length` words long, are the duplicate spans.

An anchor with more than HOT references doesn't meet in one task: its windows are dealt by their own hash, each of them a reference block of one factor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, quoted, small_batches, stored, unused, without
from .suffix_dedup import mixed, powers, sliding_least

LENGTH, GRAM = 50, 12
#: Words whose anchors are found together, at most 2 ** BITS; places take that many bits beside the hashes that they order.
BITS = 20
PIECE = 1 << 17
#: References that are parsed together, and references of one anchor beyond which its windows are dealt instead.
BATCH, HOT = 4096, 1 << 14
NEW = ("n_words", "n_removed", "kept", "spans")


class Hashes(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def summed(words: np.ndarray) -> np.ndarray:
    """Sums of words times rising powers, from which range_hash() takes the hash of any range."""
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(1 << BITS)[0][: len(words)], out=total[1:])
    return total


def range_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((total[end] - total[start]) * powers(1 << BITS)[1][start])


def anchors(texts: list[np.ndarray], length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The blocks of texts (word hashes): i (whose), h (hash of the anchor's words), c (hash of the block), a and b (its first and last window)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    words = np.concatenate(texts)
    total = summed(words)
    grams = mixed((total[gram:] - total[:-gram]) * powers(1 << BITS)[1][: len(words) - gram + 1])
    bits = np.uint64(BITS)
    ranked = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)  # ties go to the first
    place = (sliding_least(ranked, length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    edge = np.zeros(len(place) + 1, np.int64)
    edge[starts] += 1
    edge[starts + sizes - length + 1] -= 1
    inside = np.cumsum(edge[:-1]) > 0
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    new[starts] = True
    new[1:] |= ~inside[:-1]
    first = np.flatnonzero(new & inside)
    ends = np.ones(len(place), bool)
    ends[:-1] = new[1:] | ~inside[1:]
    last = np.flatnonzero(ends & inside)
    i = np.searchsorted(starts, first, side="right") - 1
    return {"i": i, "h": grams[place[first]].view(np.int64), "c": range_hash(total, first, last + length).view(np.int64), "a": first - starts[i], "b": last - starts[i]}


def blocks(texts: list[np.ndarray], length: int = LENGTH, gram: int = GRAM, piece: int = PIECE) -> dict[str, np.ndarray]:
    """anchors() of texts of any number and length, piece by piece."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in "ihcab"}
    held: list[tuple[int, int, np.ndarray]] = []

    def run() -> None:
        if held:
            x = anchors([t for *_, t in held], length, gram)
            whose, at = (np.array([e[k] for e in held], np.int64)[x["i"]] for k in (0, 1))
            for k, v in (x | {"i": whose, "a": x["a"] + at, "b": x["b"] + at}).items():
                out[k].append(v)
            held.clear()

    for i, t in enumerate(texts):
        for at in range(0, len(t) - length + 1, piece):
            part = t[at : at + piece + length - 1]
            if sum(len(e[2]) for e in held[-1:]) and sum(len(e[2]) for e in held) + len(part) > piece + length:
                run()
            held.append((i, at, part))
    run()
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def ranks(ids: np.ndarray, most: int) -> list[np.ndarray]:
    """Ranks of the 1, 2, 4, ... (at most `most`) elements from each place on: equal where these are."""
    out, width = [ids], 1
    while 2 * width <= most:
        x = out[-1]
        after = np.concatenate([x[width:], np.zeros(min(width, len(x)), np.int64)])
        out.append(np.unique(x * (int(x.max()) + 1) + after, return_inverse=True)[1].astype(np.int64))
        width *= 2
    return out


def factors(words: np.ndarray, sizes: np.ndarray, keys: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy parses of blocks (word hashes one after another, their sizes and documents' keys) against blocks of smaller keys: of each
    factor the block, the place in it and how many words."""
    order = np.argsort(keys, kind="stable")
    began = (np.cumsum(sizes) - sizes)[order]
    sizes, keys = sizes[order], keys[order]
    n = len(sizes)
    starts = np.cumsum(sizes + 1) - sizes - 1
    block = np.repeat(np.arange(n), sizes + 1)
    inner = np.arange(len(block)) - starts[block]
    ids = np.empty(len(block), np.int64)
    stop = inner == sizes[block]
    ids[stop] = np.arange(n)  # each block ends in an element of its own
    ids[~stop] = np.unique(words[(began[block] + inner)[~stop]], return_inverse=True)[1] + n
    ladder = ranks(ids, length)
    top, wide = ladder[-1], 1 << (len(ladder) - 1)
    windows = np.flatnonzero(inner <= sizes[block] - length)
    _, earliest, which = np.unique(top[windows] * (int(top.max()) + 1) + top[windows + length - wide], return_index=True, return_inverse=True)
    source = np.zeros(len(block), np.int64)
    source[windows] = windows[earliest[which]]  # in the order of keys, so the first has the least
    end = starts + sizes - length + 1
    b, at = np.arange(n), starts.copy()
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(b):
        from_ = source[at]
        found = keys[block[from_]] < keys[b]
        x, y = at[found] + length, from_[found] + length
        for k in range(len(ladder) - 1, -1, -1):
            fits = (x < len(ids)) & (y < len(ids))
            same = np.zeros(len(x), bool)
            same[fits] = ladder[k][x[fits]] == ladder[k][y[fits]]
            x, y = x + (same << k), y + (same << k)
        out.append((order[b[found]], (at - starts[b])[found], x - at[found]))
        at = at + 1
        at[found] = x - length + 1
        more = at < end[b]
        b, at = b[more], at[more]
    return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in range(3))


def indexed_udf(length: int, gram: int, piece: int):
    """n (words), z (the text, compressed), h and c of each block, one of those alike in the text, and a and b of all, w telling which block it is."""
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())

    @F.arrow_udf("struct<n:long,z:binary,h:array<long>,c:array<long>,w:array<int>,a:array<long>,b:array<long>>")
    def indexed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        packer, hashes = zstandard.ZstdCompressor(3), Hashes()
        for batch in batches:
            texts = [(x or "").encode() for x in batch.to_pylist()]
            words = [hashes.of(t.split()) for t in texts]
            x = blocks(words, length, gram, piece)
            order = np.lexsort((x["a"], x["c"], x["h"], x["i"]))
            x = {k: v[order] for k, v in x.items()}
            new = np.ones(len(order), bool)
            new[1:] = (x["i"][1:] != x["i"][:-1]) | (x["h"][1:] != x["h"][:-1]) | (x["c"][1:] != x["c"][:-1])
            kind = np.cumsum(new) - 1
            to = np.searchsorted(x["i"], np.arange(len(texts) + 1))
            one = np.searchsorted(x["i"][new], np.arange(len(texts) + 1))
            listed = lambda v, ends, kind_: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, kind_.value_type))
            yield pa.StructArray.from_arrays(
                [pa.array([len(w) for w in words], pa.int64()), pa.array([packer.compress(t) for t in texts], pa.binary()), listed(x["h"][new], one, longs), listed(x["c"][new], one, longs)]
                + [listed((kind - one[x["i"]]).astype(np.int32), to, ints), listed(x["a"], to, longs), listed(x["b"], to, longs)],
                ["n", "z", "h", "c", "w", "a", "b"],
            )

    return indexed


def cut_udf(length: int):
    """The word hashes of the blocks that `needs` names, by the first place of each."""

    @F.arrow_udf("array<struct<k:int,words:binary>>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        unpack, hashes = zstandard.ZstdDecompressor(), Hashes()
        kind = pa.list_(pa.struct([("k", pa.int32()), ("words", pa.binary())]))
        for z, w, a, b, needs in batches:
            out = []
            for packed, w_, a_, b_, needed in zip(z, w, a, b, needs, strict=True):
                words = hashes.of(unpack.decompress(packed.as_py()).split())
                which, first = np.unique(w_.values.to_numpy(), return_index=True)
                first = dict(zip(which.tolist(), first.tolist(), strict=True))
                from_, to = a_.values.to_numpy(), b_.values.to_numpy()
                out.append([{"k": k, "words": words[from_[first[k]] : to[first[k]] + length].tobytes()} for k in needed.as_py()])
            yield pa.array(out, kind)

    return cut


def parsed(references: DataFrame, length: int, batch: int) -> DataFrame:
    """references: h, c, key, words. h, c and spans, the factors of each reference that has any."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())]))

        def run(held: pa.Table) -> pa.RecordBatch:
            sizes = np.array([len(x) // 8 for x in held["words"].to_pylist()], np.int64)
            words = np.frombuffer(b"".join(held["words"].to_pylist()), np.uint64)
            block, at, n = factors(words, sizes, held["key"].to_numpy(), length)
            order = np.lexsort((at, block))
            block, at, n = block[order], at[order], n[order]
            have, first = np.unique(block, return_index=True)
            flat = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(n, pa.int32())], fields=list(span.value_type))
            rows = held.take(pa.array(have))
            return pa.RecordBatch.from_arrays([rows["h"].combine_chunks(), rows["c"].combine_chunks(), pa.ListArray.from_arrays(pa.array(np.append(first, len(block)), pa.int32()), flat)], ["h", "c", "spans"])

        held: pa.Table | None = None
        for part in batches:
            got = pa.Table.from_batches([part])
            held = got if held is None else pa.concat_tables([held, got])
            if held.num_rows >= batch:
                h = held["h"].to_numpy()
                last = int(np.argmax(h == h[-1]))  # rows of one anchor follow each other
                if last:
                    yield run(held.slice(0, last))
                    held = held.slice(last).combine_chunks()
        if held is not None and held.num_rows:
            yield run(held)

    rows = references.select("h", "c", "key", "words").repartition("h").sortWithinPartitions("h")
    return rows.mapInArrow(parse, "h long, c long, spans array<struct<at:int,n:int>>")


def dealt(references: DataFrame, length: int) -> DataFrame:
    """The same of anchors with too many references: each window goes by its own hash to the least key that holds it."""

    @F.arrow_udf("array<long>")
    def windows(words: pa.Array) -> pa.Array:
        out = []
        for x in words:
            held = np.frombuffer(x.as_py(), np.uint64)
            at = np.arange(len(held) - length + 1)
            out.append(range_hash(summed(held), at, at + length).view(np.int64))
        return pa.array(out, pa.list_(pa.int64()))

    each = stored(references.select("h", "c", "key", F.posexplode(windows("words")).alias("at", "window")))
    first = each.groupBy("h", "window").agg(F.min("key").alias("first"))
    late = each.join(first, ["h", "window"]).where("key > first")
    return late.groupBy("h", "c").agg(F.array_sort(F.collect_list(F.struct("at", F.lit(length).alias("n")))).alias("spans"))


def finished_udf(length: int):
    @F.arrow_udf("struct<removed:long,kept:string,spans:array<struct<start:long,end:long>>>")
    def finished(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        unpack = zstandard.ZstdDecompressor()
        kind = pa.struct([("removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        for z, w, a, b, hits in batches:
            out = []
            for packed, w_, a_, b_, found in zip(z, w, a, b, hits, strict=True):
                words = unpack.decompress(packed.as_py()).split()
                if not found.is_valid:
                    out.append({"removed": 0, "kept": b" ".join(words).decode(), "spans": []})
                    continue
                which, from_, to = (x.values.to_numpy() for x in (w_, a_, b_))
                edge = np.zeros(len(words) + 1, np.int64)
                whole = {x["k"]: x["spans"] for x in found.as_py()}
                for at in np.flatnonzero(np.isin(which, np.fromiter(whole, np.int64, len(whole)))).tolist():
                    spans = whole[int(which[at])]
                    if spans is None:
                        edge[from_[at]] += 1
                        edge[to[at] + length] -= 1
                    for s in spans or ():
                        edge[from_[at] + s["at"]] += 1
                        edge[from_[at] + s["at"] + s["n"]] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                ends = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
                kept, last = [], 0
                for s, e in ends:
                    kept += words[last:s]
                    last = e
                kept += words[last:]
                out.append({"removed": int(gone.sum()), "kept": b" ".join(kept).decode(), "spans": [{"start": s, "end": e} for s, e in ends]})
            yield pa.array(out, kind)

    return finished


def cut_passages(df: DataFrame, key: str = "doc_id", text: str = "text", *, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE, batch: int = BATCH, hot: int = HOT) -> DataFrame:
    """df without `text`, and n_words, n_removed, kept (the remaining words, joined by one space) and spans (start, end of each removed run of words).

    Words covered by a window of `length` words that also starts in a document with a smaller key are removed. Keys are whole numbers. A null text
    has no words; shorter texts stay whole. Documents that share a key, rows repeated among them, take nothing from each other, nor does a text from itself; documents
    with a null key are neither smaller nor larger, and stay whole. Very long texts are read whole, in pieces. An empty table gives an empty one. Columns called
    like the new ones give way; others stay. Exact but for collisions of 64-bit hashes. What it stores on its way and its result doesn't read is deleted.
    """
    spark = df.sparkSession
    small_batches(spark)
    base = without(df, *NEW)
    uid, key_, x = unused(base, "_uid", "_key", "_x")
    rest = [c for c in base.columns if c.lower() != text.lower()]
    got = base.withColumn(x, indexed_udf(length, gram, piece)(quoted(text).cast("string")))
    docs = stored(got.select(F.monotonically_increasing_id().alias(uid), quoted(key).cast("long").alias(key_), F.col(x), *map(quoted, rest)))
    placed = docs.where(F.col(key_).isNotNull()).select(F.col(uid).alias("uid"), F.col(key_).alias("key"), F.posexplode(F.arrays_zip(F.col(x)["h"].alias("h"), F.col(x)["c"].alias("c"))).alias("k", "e")).select("uid", "key", "k", "e.h", "e.c")
    heads = placed.groupBy("h").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most")
    # stored, so that the join's own exchange deals both sides and can split an anchor that stands everywhere; the number of anchors, blocks and documents
    # has no bound, so these tables are merged with and never sent to all, whatever their sizes are just now
    heads = stored(heads.select("h"))
    live = stored(placed.join(heads.hint("merge"), "h"))
    kinds = stored(live.groupBy("h", "c").agg(F.min(F.struct("key", "uid", "k")).alias("first")).select("h", "c", "first.*"))
    several = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = stored(several.select("h", (F.col("n") > hot).alias("hot")))
    asked = stored(kinds.join(several.hint("merge"), "h"))
    needs = asked.groupBy(F.col("uid").alias(uid)).agg(F.collect_list("k").alias("_needs"))
    part = lambda n: F.col(x)[n]
    cut = docs.select(uid, part("z").alias("z"), part("w").alias("w"), part("a").alias("a"), part("b").alias("b")).join(needs.hint("merge"), uid)
    cut = cut.select(F.col(uid).alias("uid"), F.explode(cut_udf(length)("z", "w", "a", "b", "_needs")).alias("e")).select("uid", "e.k", "e.words")
    references = stored(asked.join(cut.hint("merge"), ["uid", "k"]).select("h", "c", "key", "words", "hot"))
    spans = parsed(references.where("not hot"), length, batch)
    if not several.where("hot").isEmpty():
        spans = spans.unionByName(dealt(references.where("hot"), length))
    spans = stored(spans)
    # a later holder of a reference loses all of it, the reference itself what its factors cover; stored for the same reason as heads
    firsts = stored(kinds.select("h", "c", F.col("key").alias("first")).join(spans.hint("merge"), ["h", "c"], "left"))
    hits = live.join(firsts.hint("merge"), ["h", "c"]).where("key > first or spans is not null")
    hits = hits.groupBy(F.col("uid").alias(uid)).agg(F.collect_list(F.struct("k", F.when(F.col("key") <= F.col("first"), F.col("spans")).alias("spans"))).alias("_hits"))
    hits = stored(hits)
    forget(heads, live, kinds, several, asked, references, spans, firsts)
    done, = unused(docs, "_done")
    slim = F.struct(*[part(n).alias(n) for n in "nzwab"]).alias(x)  # without the hashes, which nothing needs any more and which don't compress
    out = docs.select(uid, slim, *map(quoted, rest)).join(hits.hint("merge"), uid, "left").withColumn(done, finished_udf(length)(part("z"), part("w"), part("a"), part("b"), "_hits"))
    return out.select(*map(quoted, rest), part("n").alias("n_words"), F.col(done)["removed"].alias("n_removed"), F.col(done)["kept"].alias("kept"), F.col(done)["spans"].alias("spans"))


SQL = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT r, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS m FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
f AS (SELECT m, min(doc_id) AS first FROM w GROUP BY m),
k AS (SELECT w.r, w.i FROM w JOIN f USING (m) WHERE w.doc_id > f.first),
p AS (SELECT r, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM d),
c AS (SELECT p.r, p.x, p.i, coalesce(max(k.i) OVER (PARTITION BY p.r ORDER BY p.i) > p.i - 50, false) AS gone FROM p LEFT JOIN k ON k.r = p.r AND k.i = p.i),
s AS (SELECT r, count_if(gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)"""
