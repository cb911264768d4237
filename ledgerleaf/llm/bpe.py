"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs, and decoding.

The ranks of a word's adjacent pairs are the leaves of a segment tree of minima with FAN children to a node: the root is the lowest rank, and
the first child that holds it, level by level, leads to its leftmost pair. A merge changes three leaves at most, each in logarithmic time, until no
pair of the vocabulary is left. A word of n symbols
costs O(n log n), so one very long "word" costs no more than the same length in short ones.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import quoted, small_batches, unused, without

#: Children of a node of the segment tree, whose minimum is one built-in call.
FAN = 8
#: A leaf that is no pair of the vocabulary.
NONE = 1 << 29
#: Words kept per Python worker.
CACHE_WORDS = 300_000
#: What the vocabulary's normaliser and splitter call white space (Unicode's White_Space).
SPACE = r"\t-\r \x85\xA0  -     　"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = [""] * 256, 0x100
    for b in range(256):
        if b in set(shown):
            letters[b] = chr(b)
        else:
            letters[b], extra = chr(extra), extra + 1
    return letters


#: Characters beyond those of most texts, looked for first.
FAR = re.compile("[\u0530-\U0010ffff]")
# How the vocabulary's file says that texts are normalised and split, the only way that WordBpe knows.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


@dataclass(frozen=True)
class Unicode:
    """What the library's version of Unicode says of characters that the standard library's, an older one, has not assigned."""

    #: Finds such a character.
    late: re.Pattern
    #: The vocabulary's words. The regex module knows a third version, so letters and numbers that the library doesn't know are left out.
    words: regex.Pattern


def class_of(points: list[int]) -> str:
    """Code points, ascending, as ranges of a character class."""
    runs: list[list[int]] = []
    for c in points:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


@lru_cache(maxsize=1)
def unicode() -> Unicode:
    """Read off the library: which of those characters it takes for letters and numbers."""
    late = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if unicodedata.category(c) == "Cn"]
    late = regex.findall(r"\P{Cn}", "".join(late))
    kinds = {}
    for kind in "LN":
        mine = "".join(regex.findall(rf"\p{{{kind}}}", "".join(late)))
        there = {c for part, _ in pre_tokenizers.Split(Regex(rf"\p{{{kind}}}"), "removed", invert=True).pre_tokenize_str(mine) for c in part} if mine else set()
        other = [ord(c) for c in mine if c not in there]
        kinds[kind] = rf"[\p{{{kind}}}--[{class_of(other)}]]" if other else rf"\p{{{kind}}}"
    words = rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{kinds['L']}+|{kinds['N']}|[^{SPACE}{kinds['L']}{kinds['N']}]+"
    return Unicode(re.compile(f"[{class_of([ord(c) for c in late])}]" if late else r"(?!)"), regex.compile(words))


def merge_word(symbols: list[int], rank: dict[tuple[int, int], int], merged: list[int]) -> list[int]:
    """Merges a word's symbol ids. rank: pair of ids -> its rank; merged: the id that a rank's pair becomes."""
    n = len(symbols)
    if n < 2:
        return symbols
    get = rank.get
    leaves = [get(pair, NONE) for pair in zip(symbols, symbols[1:], strict=False)]
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([min(low[k : k + FAN]) for k in range(0, len(low), FAN)])
    top, inner = levels.pop(), levels[::-1]
    steps = list(zip(levels, [*levels[1:], top], strict=False))  # each level and the one above
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    while (least := top[0]) != NONE:
        i = 0
        for level in inner:  # the first child that holds the root's value
            i = level.index(least, i * FAN)
        j, before = right[i], left[i]
        after = right[i] = right[j]
        symbols[i] = new = merged[least]
        low = high = i
        if j < n - 1:
            leaves[j] = NONE
            high = j
        if after < n:
            left[after] = i
            leaves[i] = get((new, symbols[after]), NONE)
        else:
            leaves[i] = NONE
        if before >= 0:
            leaves[before] = get((symbols[before], new), NONE)
            low = before
        for below, above in steps:
            low //= FAN
            high //= FAN
            for k in range(low, high + 1):
                above[k] = min(below[k * FAN : k * FAN + FAN])
    out, k = [], 0
    while k < n:
        out.append(symbols[k])
        k = right[k]
    return out


class WordBpe:
    """A vocabulary file of the tokenizers library with word ends, lower-casing and byte letters."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if spec["normalizer"] != NORMALIZER or spec["pre_tokenizer"] != SPLITTER or model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback"):
            raise ValueError("a vocabulary with another normaliser, splitter or model")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): k for k, (a, b) in enumerate(pairs)}
        self.merged = [self.vocab[a + b] for a, b in pairs]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.added.items()}
        letters = byte_letters()
        self.inner = [self.vocab[x] for x in letters]
        self.last = [self.vocab[x + self.end] for x in letters]
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")  # for texts without late characters, as it is faster
        self.late_words, self.late = unicode().words, unicode().late
        #: Words lately seen, and those seen before them: the older half goes when the newer is full, so frequent words stay.
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode_word(self, word: str) -> bytes:
        if (out := self.older.get(word)) is None:
            out = self.merge(word)
        if len(word) <= 64:
            if len(self.cache) >= CACHE_WORDS // 2:
                self.cache, self.older = {}, self.cache
            self.cache[word] = out
        return out

    def merge(self, word: str) -> bytes:
        raw = word.encode("utf-8", "surrogatepass")
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        return array("i", merge_word(symbols, self.rank, self.merged)).tobytes()

    def plain(self, text: str, out: list[bytes]) -> None:
        words = self.words
        if not text.isascii():
            if FAR.search(text) and self.late.search(text):
                words = self.late_words
                text = normalizers.Lowercase().normalize_str(normalizers.NFC().normalize_str(text))
            # letter by letter, so no rule for a word's last sigma
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        get, new = self.cache.get, self.encode_word  # should a new word start a new cache, this one's words are still right
        out += [get(w) or new(w) for w in words.findall(text.lower())]

    def encode(self, text: str | None) -> bytes:
        """The ids as int32 bytes."""
        out: list[bytes] = []
        if not text:
            return b""
        if self.special is None or not any(t in text for t in self.added):
            self.plain(text, out)
        else:
            for part in self.special.split(text):
                if part in self.added:
                    out.append(np.int32(self.added[part]).tobytes())
                elif part:
                    self.plain(part, out)
        return b"".join(out)

    def decode(self, ids: Iterator[int]) -> str:
        """Without a decoder of its own the vocabulary's tokens are joined by one space, special ones included."""
        token = self.token
        return " ".join([token[i] for i in ids if i in token])


@lru_cache(maxsize=2)
def vocabulary(content: str) -> WordBpe:
    return WordBpe(json.loads(content))


def load(path: str) -> str:
    """The vocabulary file's content, read on the driver (a few MB, fixed) and sent to the executors."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the array of token ids of each whole text, of any length.

    Null and empty texts give an empty array; texts alike give the same. Of pairs of one rank the leftmost merges first. An empty table gives an empty
    one. A column called ids gives way, others stay.
    """
    small_batches(df.sparkSession)
    content = df.sparkSession.sparkContext.broadcast(load(path))

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = vocabulary(content.value)
        for batch in batches:
            parts = [bpe.encode(t.as_py()) for t in batch]
            ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))

    return without(df, ids).withColumn(ids, encoded(quoted(text).cast("string")))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of each array of ids, as the library's decode does: unknown and null ids are left out, null and empty arrays give ''.

    Rows repeated give the same, an empty table an empty one. A column called like the new one gives way, others stay.
    """
    small_batches(df.sparkSession)
    content = df.sparkSession.sparkContext.broadcast(load(path))

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = vocabulary(content.value)
        for batch in batches:
            yield pa.array([bpe.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else "" for x in batch], pa.string())

    return without(df, out).withColumn(out, decoded(quoted(ids)))


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encode() and decode() of what it gives, in one Python worker for each task instead of two; what they say of odd rows holds."""
    small_batches(df.sparkSession)
    content = df.sparkSession.sparkContext.broadcast(load(path))

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = vocabulary(content.value)
        for batch in batches:
            parts = [bpe.encode(t.as_py()) for t in batch]
            ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))
            yield pa.StructArray.from_arrays([found, pa.array([bpe.decode(array("i", p)) for p in parts], pa.string())], ["ids", "decoded"])

    df = without(df, ids, out)
    both, = unused(df, "_coded")
    df = df.withColumn(both, coded(quoted(text).cast("string")))
    return df.withColumns({ids: F.col(both)["ids"], out: F.col(both)["decoded"]}).drop(both)
