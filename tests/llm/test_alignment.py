"""Two tokenizers' cuts against token ends, links and counts taken one by one."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerleaf.llm import alignment

PATHS = tuple(map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")))


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest for those from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(texts: list[str | None]) -> list[tuple]:
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[2])
    a.encode_special_tokens = True
    to = byte_of()
    docs = []
    for t in texts:
        data = b" " + (t or "").encode()
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        bytes_a = [bytes(to[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if not t or b"".join(bytes_a) != data or b"".join(bytes_b) != data:
            docs.append(([], [], Counter(), 0, ""))
            continue
        spans = [[(sum(map(len, side[:k])), sum(map(len, side[: k + 1]))) for k in range(len(side))] for side in (bytes_a, bytes_b)]
        links = Counter((i, j) for i, x in zip(ids_a, spans[0], strict=True) for j, y in zip(ids_b, spans[1], strict=True) if x[0] < y[1] and y[0] < x[1])
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        part = lambda ids, span, lo, hi: ",".join(str(i) for i, (_, e) in zip(ids, span, strict=True) if lo < e <= hi)
        text = ";".join(f"{part(ids_a, spans[0], lo, hi)}|{part(ids_b, spans[1], lo, hi)}" for lo, hi in zip([0, *ends], ends, strict=False))
        docs.append((ids_a, ids_b, links, len(ends), hashlib.sha256(text.encode()).hexdigest()))
    count = Counter(p for d in docs for p in d[2])
    best = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    return [(len(x), len(y), g, sum(links.values()), sum(n for p, n in links.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links.items()), s) for x, y, links, g, s in docs]


def made() -> list[str | None]:
    rng = random.Random(4)
    words = "the of alignment tokenizers été 日本語 🙂 don't <|endoftext|> <s> <0x41> 12345 ▁ x_y ... naïve".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    return [*texts, None, "", " ", "  two  spaces ", "\n\ta\r\n", "é", "ﬁ", " ", "　x", "a\x00b", *texts[:5], texts[0], "a" * 60]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("stripes, rows", [(64, 4096), (3, 1)])
def test_alignment(spark, stripes, rows, monkeypatch):
    texts = made()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(40 if rows == 1 else 2)
    got = alignment.align(df, *PATHS, stripes=stripes, rows=rows).orderBy("doc_id").collect()
    want = brute(texts)
    assert [tuple(r[c] for c in COLUMNS) for r in got] == want
    assert sum(w[3] > 0 for w in want) > 40 and any(0 < w[4] < w[3] for w in want)


def test_long_pieces_and_packing():
    """Long runs take the other tokenizer, which gives the same; what is packed comes out again."""
    pair = alignment.loaded(*PATHS)
    for t in ("ab" * 3000, "x" + " " * 3000 + "y", "!?" * 2000 + " word"):
        ids, _ = pair.encoded([t])
        assert not len(ids[0]) or ids[0].tolist() == pair.a_whole.encode(" " + t, add_special_tokens=False).ids == pair.a.encode_ordinary(" " + t)
        assert alignment.longest_run(t.encode()) > alignment.LONG_PIECE
    rng = np.random.default_rng(1)
    doc, a, b = (rng.integers(0, n, 5000) for n in (4096, 50257, 32000))
    want, got = Counter(zip(doc.tolist(), a.tolist(), b.tolist(), strict=True)), Counter()
    for s, pairs, holders in alignment.packed(doc, a, b, 32000, 7):
        keys, held = alignment.unpacked(pairs)
        steps, often = alignment.opened(holders, np.uint16, np.uint32)
        total = alignment.before(steps.astype(np.int64))
        docs = total[1:] - np.repeat(total[alignment.before(held)[:-1]], held)
        for k, d, n in zip(np.repeat(keys, held).tolist(), docs.tolist(), often.tolist(), strict=True):
            got[d, k // 32000 * 7 + s, k % 32000] += n
    assert got == want


def test_ranks_give_the_ids_of_the_vocabulary():
    """Every code point among letters, digits, spaces and apostrophes."""
    pair = alignment.loaded(*PATHS)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 16 == 0)]
    texts = [" " + "".join(f"a{c}b,{c}1 {c} {c}{c}  '{c}s" for c in map(chr, points[i : i + 64])) for i in range(0, len(points), 64)]
    assert [e.ids for e in pair.a_whole.encode_batch(texts, add_special_tokens=False)] == [pair.a.encode_ordinary(t) for t in texts]


def test_odd_tables(spark):
    assert not alignment.align(spark.createDataFrame([], "doc_id string, text string, uid int"), *PATHS).count()
    df = spark.createDataFrame([(None, "a b", 1, "k"), ("x", "a b", 2, "k"), ("x", None, 3, "k")], "doc_id string, text string, n_a int, stripe string")
    got = sorted(map(tuple, alignment.align(df, *PATHS).collect()), key=str)
    assert [r[0] for r in got] == ["x", "x", None] and got[1][1:] == got[2][1:] and got[0][1:] == (0, 0, 0, 0, 0, 0, "") and got[1][6] == 2 * got[1][4]
