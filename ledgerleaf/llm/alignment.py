"""How two tokenizers cut the same bytes, and which pairs of their tokens belong together.

A cuts a space and the text into byte-level pieces, B the text, before which it puts a space itself, so both cut the same bytes. The bytes between
two neighbouring ends of tokens lie in one token of each side, so these cells are the links, and ends that both sides share cut tokens into groups.

A pair counts the documents that hold it linked. Pairs are dealt by A's id into stripes; of each stripe one task adds up a dense matrix, a row for each id of A
and a column for each of B, and row maxima give the best partners. Links then meet their stripe's matrix: rows of a stripe are dealt over as many tasks as
their number asks for, each of which reads the matrix first and scores links as they stream by.

A batch of documents sends a stripe one packed row: its pairs, how many documents hold each, which, and how often. Only these rows are shuffled.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import by_bytes, forget, quoted, small_batches, stored

STRIPES = 64
#: Packed rows of a stripe that go to one task, on average.
ROWS = 4096
#: Documents and characters that are packed together.
PACKED, PACKED_CHARS = 4096, 4 << 20
#: Pieces longer than this go to the tokenizer whose time doesn't grow with their square.
LONG_PIECE = 1000
#: Nonzero cells of a matrix in one row.
CELLS = 1 << 19
# Fixed value: how the byte-level vocabulary's text is cut before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Pair:
    """Both tokenizers, by the paths of A's vocabulary (as JSON and as ranks, which give the same ids; ranks are faster) and B's."""

    def __init__(self, a_json: str, a_ranks: str, b_model: str):
        with open(a_ranks, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_whole = Tokenizer.from_file(a_json)
        self.a_whole.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_model)
        self.n_a, self.n_b = self.a_whole.get_vocab_size(), self.b.get_piece_size()
        self.a_bytes = [b""] * self.n_a
        for token, rank in ranks.items():
            self.a_bytes[rank] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        most = max(self.n_a, self.n_b)
        self.texts = np.empty(4 * most, object)  # every id in decimal, before a comma, a bar, a semicolon and the end
        self.texts[:] = [b"%d%s" % (i, end) for end in (b",", b"|", b";", b"") for i in range(most)]
        self.most = most

    def encoded(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Both sides' ids of each text; none where the joined tokens aren't a space and the text."""
        a, b = [], []
        for text, ids in zip(texts, self.b.encode([t or "" for t in texts], num_threads=1), strict=True):
            data = b" " + (text or "").encode()
            none = np.zeros(0, np.int64)
            if not text or b"".join(map(self.b_bytes.__getitem__, ids)) != data:
                a.append(none), b.append(none)
                continue
            if len(data) > LONG_PIECE and longest_run(data) > LONG_PIECE:
                mine = np.array(self.a_whole.encode(" " + text, add_special_tokens=False).ids, np.int64)
            else:
                mine = self.a.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int64)
            if int(self.a_sizes[mine].sum()) != len(data):  # bytes that A can't write
                mine, ids = none, []
            a.append(mine), b.append(np.array(ids, np.int64))
        return a, b


@lru_cache(maxsize=1)
def loaded(a_json: str, a_ranks: str, b_model: str) -> Pair:
    return Pair(a_json, a_ranks, b_model)


def longest_run(data: bytes) -> int:
    """The longest run of ASCII white space, or of anything else."""
    x = np.frombuffer(data, np.uint8)
    space = (x == 32) | ((x >= 9) & (x <= 13))
    turns = np.flatnonzero(np.diff(space))
    return int(np.diff(np.concatenate([[-1], turns, [len(x) - 1]])).max())


def before(x: np.ndarray) -> np.ndarray:
    """Sums of what comes before each place, and of all."""
    return np.concatenate([[0], np.cumsum(x, dtype=np.int64)])


def aligned(pair: Pair, texts: list[str | None]) -> tuple[dict[str, list], np.ndarray, np.ndarray, np.ndarray]:
    """n_a, n_b, n_groups, n_links and groups_sha256 of each text; and of all links the text, A's id and B's id."""
    a_ids, b_ids = pair.encoded(texts)
    n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (a_ids, b_ids))
    a, b = np.concatenate(a_ids), np.concatenate(b_ids)
    a_ends, b_ends = np.cumsum(pair.a_sizes[a]), np.cumsum(pair.b_sizes[b])
    mark = np.zeros(int(a_ends[-1]) + 1 if len(a) else 1, np.uint8)  # tokens follow each other over all texts
    mark[a_ends] |= 1
    mark[b_ends] |= 2
    cells = np.flatnonzero(mark)
    kind = mark[cells]
    both = kind == 3
    of_a, of_b = before(kind & 1)[:-1], before(kind >> 1)[:-1]
    group = before(both)[:-1]
    bytes_to = before(np.array([pair.a_sizes[x].sum() for x in a_ids], np.int64))
    at = np.searchsorted(cells, bytes_to, side="right")
    n_links, n_groups = np.diff(at), np.diff(before(both)[at])
    ends_a, ends_b = np.flatnonzero(kind & 1), np.flatnonzero(kind & 2)
    group_a, group_b = group[ends_a], group[ends_b]
    n = int(both.sum())
    place_a = np.arange(len(a)) + before(np.bincount(group_b, minlength=n))[group_a]
    place_b = np.arange(len(b)) + before(np.bincount(group_a, minlength=n))[group_b + 1]
    code = np.empty(len(a) + len(b), np.int64)
    code[place_a] = a + both[ends_a] * pair.most
    code[place_b] = b + both[ends_b] * (2 * pair.most)
    to = before(n_a + n_b)
    last = to[1:][n_a > 0] - 1
    code[last] += pair.most
    words = pair.texts[code].tolist()
    shas = [hashlib.sha256(b"".join(words[i:j])).hexdigest() if j > i else "" for i, j in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
    rows = {"n_a": n_a.tolist(), "n_b": n_b.tolist(), "n_groups": n_groups.tolist(), "n_links": n_links.tolist(), "groups_sha256": shas}
    return rows, np.repeat(np.arange(len(texts)), n_links), a[of_a], b[of_b]


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, each by its bytes' places, which compress better than whole numbers."""
    return zstandard.ZstdCompressor(1).compress(b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes() for x in arrays))


def opened(data: bytes, *kinds: type) -> list[np.ndarray]:
    """What squeezed() packed: arrays of one length."""
    x = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n, at, out = len(x) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(x[at : at + n * size].reshape(size, n).T).view(k).ravel())
        at += n * size
    return out


def packed(doc: np.ndarray, a: np.ndarray, b: np.ndarray, width: int, stripes: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Links as a row for each stripe: the stripe; its pairs (A's row in the stripe times width, plus B's id) as steps, and how many documents hold
    each; those documents, and how often each holds it."""
    height = int(a.max()) // stripes + 1
    code = np.sort(((((a % stripes) * height + a // stripes) * width + b) << 16) | doc)
    new = np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    at = np.flatnonzero(new)
    often = np.diff(np.append(at, len(code))).astype(np.uint32)
    entry = code[at]
    pair = entry >> 16
    first = np.ones(len(pair), bool)
    first[1:] = pair[1:] != pair[:-1]
    heads = np.flatnonzero(first)
    held = np.diff(np.append(heads, len(pair))).astype(np.uint32)
    docs = (entry & 0xFFFF).astype(np.uint16)
    steps = np.diff(docs, prepend=np.uint16(0))
    steps[heads] = docs[heads]
    stripe = pair[heads] // (height * width)
    for s in np.unique(stripe).tolist():
        i, j = np.searchsorted(stripe, [s, s + 1])
        k, m = heads[i], heads[j] if j < len(heads) else len(pair)
        keys = (pair[heads[i:j]] - s * height * width).astype(np.int64)
        yield s, squeezed(np.diff(keys, prepend=0).astype(np.uint32), held[i:j]), squeezed(steps[k:m], often[k:m])


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, held = opened(data, np.uint32, np.uint32)
    return np.cumsum(steps.astype(np.int64)), held.astype(np.int64)


def coded(docs: DataFrame, key: str, text: str, paths: tuple[str, str, str], stripes: int) -> DataFrame:
    """A row for each document (uid, key and what concerns it alone), and one for each stripe of each batch (uid of the batch's first, stripe, pairs, holders)."""
    kind = docs.schema[key].dataType
    doc = T.StructType([T.StructField("uid", T.LongType()), T.StructField("key", kind)])
    for n in ("n_a", "n_b", "n_groups", "n_links"):
        doc.add(n, T.LongType())
    schema = doc.add("groups_sha256", T.StringType()).add("stripe", T.IntegerType()).add("pairs", T.BinaryType()).add("holders", T.BinaryType())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, uid, out = loaded(*paths), TaskContext.get().partitionId() << 33, None
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            out = pa.schema([("uid", pa.int64()), ("key", keys.type), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("stripe", pa.int32()), ("pairs", pa.binary()), ("holders", pa.binary())])
            for start, end in by_bytes(texts, PACKED_CHARS):
                for i in range(start, end, PACKED):
                    part = texts[i : min(i + PACKED, end)]
                    n = len(part)
                    rows, doc_, a, b = aligned(pair, part)
                    yield pa.RecordBatch.from_pydict({"uid": list(range(uid, uid + n)), "key": keys.slice(i, n), **rows, "stripe": [None] * n, "pairs": [None] * n, "holders": [None] * n}, out)
                    links = list(packed(doc_, a, b, pair.n_b, stripes)) if len(a) else []
                    if links:
                        m = len(links)
                        empty = dict.fromkeys(("n_a", "n_b", "n_groups", "n_links", "groups_sha256"), [None] * m)
                        yield pa.RecordBatch.from_pydict({"uid": [uid] * m, "key": pa.nulls(m, keys.type), **empty} | dict(zip(("stripe", "pairs", "holders"), map(list, zip(*links, strict=True)), strict=True)), out)
                    uid += n

    return docs.select(quoted(key).alias("key"), quoted(text).cast("string").alias("text")).mapInArrow(encode, schema)


def counted(rows: DataFrame, paths: tuple[str, str, str], stripes: int, salts: int, cells: int = CELLS) -> DataFrame:
    """rows: stripe, salt, pairs. The same with pairs added up for each stripe and salt, at most `cells` of them in a row."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = loaded(*paths)
        matrix = np.zeros((pair.n_a // stripes + 1) * pair.n_b, np.int64)
        at = None

        def done() -> Iterator[pa.RecordBatch]:
            found = np.flatnonzero(matrix)
            for i in range(0, len(found), cells):
                some = found[i : i + cells]
                yield pa.RecordBatch.from_pydict({"stripe": pa.array([at[0]], pa.int32()), "salt": pa.array([at[1]], pa.int32()), "pairs": [squeezed(np.diff(some, prepend=0).astype(np.uint32), matrix[some])]})
            matrix[found] = 0

        for batch in batches:
            for stripe, salt, wide, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if at != (stripe, salt):
                    if at is not None:
                        yield from done()
                    at = stripe, salt
                steps, held = opened(data, np.uint32, np.int64 if wide else np.uint32)
                np.add.at(matrix, np.cumsum(steps.astype(np.int64)), held.astype(np.int64))
        if at is not None:
            yield from done()

    return rows.select("stripe", "salt", "wide", "pairs").repartition("stripe", "salt").sortWithinPartitions("stripe", "salt").mapInArrow(add, "stripe int, salt int, pairs binary")


def scored(links: DataFrame, counts: DataFrame, paths: tuple[str, str, str], stripes: int) -> DataFrame:
    """links: stripe, salt, uid, pairs, holders; counts: stripe, salt, pairs. uid, n_best and count_sum, a row for each stripe that a document has links of."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = loaded(*paths)
        matrix = np.zeros((pair.n_a // stripes + 1, pair.n_b), np.int64)
        flat, best, at, ready = matrix.ravel(), None, None, False
        for batch in batches:
            for stripe, salt, uid, pairs, holders in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if at != (stripe, salt):
                    flat[:] = 0
                    at, ready = (stripe, salt), False
                if holders is None:  # the stripe's matrix comes before its links
                    steps, held = opened(pairs, np.uint32, np.int64)
                    flat[np.cumsum(steps.astype(np.int64))] = held
                    continue
                if not ready:
                    best, ready = matrix.max(axis=1), True
                keys, held = unpacked(pairs)
                steps, often = opened(holders, np.uint16, np.uint32)
                starts = before(held)[:-1]
                total = before(steps.astype(np.int64))
                docs = total[1:] - np.repeat(total[starts], held)
                count = flat[keys]
                often = often.astype(np.int64)
                n_best, count_sum = np.zeros(int(docs.max()) + 1, np.int64), np.zeros(int(docs.max()) + 1, np.int64)
                np.add.at(n_best, docs, np.repeat(count == best[keys // pair.n_b], held) * often)
                np.add.at(count_sum, docs, np.repeat(count, held) * often)
                there = np.flatnonzero(count_sum)
                yield pa.RecordBatch.from_arrays([pa.array(uid + there), pa.array(n_best[there]), pa.array(count_sum[there])], ["uid", "n_best", "count_sum"])

    rows = links.select("stripe", "salt", "uid", "pairs", "holders").unionByName(counts.select("stripe", "salt", F.lit(None).cast("long").alias("uid"), "pairs", F.lit(None).cast("binary").alias("holders")))
    return rows.repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", F.col("holders").isNotNull()).mapInArrow(score, "uid long, n_best long, count_sum long")


def align(docs: DataFrame, a_json: str, a_ranks: str, b_model: str, *, key: str = "doc_id", text: str = "text", stripes: int = STRIPES, rows: int = ROWS) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document.

    Texts that are null, empty, or of which either side's joined tokens differ from a space and the text have no tokens: zeros and ''. Special
    tokens' strings in a text are plain text. Ties for the best partner all count. Keys may be of any type, null or repeated; rows repeated count as
    documents each. Very long texts are encoded whole, in memory that grows with the text. An empty table gives an empty one. Other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    paths = (a_json, a_ranks, b_model)
    all_ = stored(coded(docs, key, text, paths, stripes))
    mine = all_.where("stripe is null").select("uid", F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    links = all_.where("stripe is not null").select("uid", "stripe", "pairs", "holders")
    salts = max(1, -(-links.count() // (stripes * rows)))
    salt = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int").alias("salt")
    counts = counted(links.select("stripe", salt(salts), F.lit(False).alias("wide"), "pairs"), paths, stripes, salts)
    n = salts
    while n > 1:  # partial matrices of a stripe are added up 64 at a time
        n = -(-n // 64)
        counts = counted(counts.select("stripe", F.pmod(F.col("salt"), F.lit(n)).cast("int").alias("salt"), F.lit(True).alias("wide"), "pairs"), paths, stripes, n)
    counts = stored(counts)
    each = counts.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "pairs")
    sums = scored(links.select("uid", "stripe", salt(salts), "pairs", "holders"), each, paths, stripes).groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    sums = stored(sums)
    forget(counts)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return mine.join(sums, "uid", "left").select(quoted(key), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
