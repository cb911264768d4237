"""Each operator against a plain version of itself, and on awkward tables."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import boosted_rules, bpe, components, compression_quality, html_extract, labelled, language_id, lattice, mixing, pii, simhash, suffix_dedup
from ledgerleaf.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 977}" for k in range(60_000))
ODD = ["", None, " \t\n", "one", "one two", "ONE two", LONG, "é ß 日本 🙂", "same text here again", "same text here again", "a\0b", " x y", "x" * 5000, "!?" * 700]


def rows(texts):
    return [(k, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None, len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([*rows(ODD), (None, "a row without a key", None, None, None), (8, ODD[8], None, "s2", 3), (8, ODD[8], None, "s2", 3)], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# ---- components


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5)]
    up: dict[int, int] = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if any(x in p and p[0] != p[1] for p in pairs)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1 PII


def test_pii_kinds_and_formats():
    key = b"k"
    text = "Dr. Anna Smith and Mr Smith met John Miller. +1 (017) 555-7713, 017-555-7713; 4111 1111 1111 1111; DE89 3704 0044 0532 0130 00; 123-45-6789; Г-н Иванов; api_key=AbCd1234EfGh; 10.0.0.1; A.b@Mail7.example.com a.b@mail7.example.com"
    found = pii.detect(text)
    assert [k for *_, k, _ in found] == ["given_f", "surname", "surname", "given_m", "surname", "phone", "phone", "card", "iban", "ssn", "surname", "secret", "ip", "email", "email"]
    new, spans = pii.replaced(text, {}, key)
    assert len(spans) == len(found)
    parts = re.fullmatch(r"Dr\. (\w+) (\w+) and Mr (\w+) met (\w+) (\w+)\. \+1 \((\d{3})\) (\d{3}-\d{4}), (\d{3})-(\d{3}-\d{4}); (\d{4}(?: \d{4}){3}); DE[\d ]{25}; \d{3}-\d{2}-\d{4}; Г-н ([А-Яа-я]+); api_key=\w{12}; [\d.]+; (\S+@\S+\.com) (\S+@\S+\.com)", new)
    assert parts and parts[2] == parts[3] and (parts[6], parts[7]) == (parts[8], parts[9])
    assert parts[1] in pii.GIVEN["latin", "f"] and parts[4] in pii.GIVEN["latin", "m"]
    assert pii.luhn(parts[10].replace(" ", "")[:-1]) == int(parts[10][-1])
    assert parts[12].lower() == parts[13] and parts[12] != parts[13]
    for _, _, kind, form in found:
        assert form not in new or kind == "given_f"
    assert pii.replaced(text, {}, b"other")[0] != new and pii.replaced(text, {}, key)[0] == new


def test_pii_leaves_clean_text():
    for t in ("", None, "Version 1.2.3.4.5 of 2024, page 17, 3.5 % and a - b.", "Der Monat hat 31 Tage.", "x@y", "1234567", "Drum and Mra words"):
        assert pii.replaced(t, {}, b"k") == (t, [])


def test_pii_numbers_that_follow_each_other():
    card, phone, ip, iban = "4111 1111 1111 1111", "+1 (826) 555-4081", "190.137.223.204", "DE89 3704 0044 0532 0130 00"
    kinds = {card: "card", phone: "phone", ip: "ip", iban: "iban", "4111111111111111": "card", "1232810148878565": "card", "+49 151 1234 5678": "phone", "+33 6 12 34 56 78": "phone", "612 345 678": "phone", "078-05-1120": "ssn", "a.b@example.org": "email"}
    for one, a in kinds.items():
        for other, b in kinds.items():
            for gap in (" ", ", ", "; tel. "):
                if one == "612 345 678" and other == "612 345 678" and gap == " ":
                    continue  # groups of three in a longer row of groups are no phone number
                text = f"Des {one}{gap}{other} du"
                want = [(one, a), (other, b)]
                assert [(text[i:j], k) for i, j, k, _ in pii.detect(text)] == want, text
    assert [k for *_, k, _ in pii.detect("DE89370400440532013000 DATE")] == ["iban"]
    for clean in ("01.02.2024 10:30", "01/2024 10 12", "2024-01-15 08:30", "01-02-2024 12", "05.06.2023, 07.08.2024", "12 345 678", "1.5 - 2.75", "9:30-10:45"):
        assert pii.detect(f"Am {clean} war es") == [], clean
    assert pii.detect("+49 1") == [] and len(pii.detect("+49 " + "12 " * 100_000)) > 1000


def test_pii_phones_by_language():
    phones = {
        "fr": ["+33 1 23 45 67 89", "+33 6 12 34 56 78", "+33 (0)1 23 45 67 89", "0033 1 23 45 67 89", "01 23 45 67 89", "06.12.34.56.78", "0612345678"],
        "de": ["+49 30 123456", "+49 (0)171 1234567", "030 123456", "030/1234567", "(030) 123456", "0171-1234567", "030 12 34 56 78"],
        "es": ["+34 612 345 678", "612 345 678", "912 34 56 78", "91 234 56 78"],
        "en": ["+1 (555) 123-4567", "555 123 4567", "555-123-4567", "(555) 123-4567", "1-800-555-1234", "+44 20 7946 0958"],
        "ru": ["+7 (495) 123-45-67", "8 (495) 123-45-67", "8-800-555-35-35"],
    }
    for phone in (p for ps in phones.values() for p in ps):
        text = f"Tel. {phone}, or so"
        assert [(text[a:b], k) for a, b, k, _ in pii.detect(text)] == [(phone, "phone")]
        assert phone not in pii.replaced(text, {}, b"k")[0]
    for t in ("On 05.12.2024 and 05-12-2024, at 01:23:45", "1 612 345 678 people", "12 345 678 of 2 345 678", "100 200 300", "pages 10 20 30 40"):
        assert not pii.detect(t), t


def test_pii_whole_names():
    for text, want in {
        "Dr. Ahmed Hassan came": [("Ahmed", "given_"), ("Hassan", "surname")],
        "Mrs Aisha Noor Hassan came": [("Aisha", "given_f"), ("Noor", "given_f"), ("Hassan", "surname")],
        "Mr John Michael Smith came": [("John", "given_m"), ("Michael", "given_m"), ("Smith", "surname")],
        "then John Michael Smith came": [("John", "given_m"), ("Michael", "given_m"), ("Smith", "surname")],
        "then Lucía Gómez Ortega came": [("Lucía", "given_f"), ("Gómez", "surname"), ("Ortega", "surname")],
        "Prof. Dr. Anna Smith came": [("Anna", "given_f"), ("Smith", "surname")],
        "Frau Dr. Nguyen came": [("Nguyen", "surname")],
    }.items():
        assert [(text[a:b], k) for a, b, k, _ in pii.detect(text)] == want
        assert not any(w in pii.replaced(text, {}, b"k")[0] for w, _ in want)


def test_permutations_are_permutations():
    assert len({pii.permuted_digits(b"k", "t", f"{n:03d}") for n in range(1000)}) == 1000
    assert len({pii.surrogate("ip", f"10.0.{a}.{b}", 0, b"k") for a in range(20) for b in range(20)}) == 400


def test_pii_later_mentions_and_case():
    def names(text):
        return [(text[a:b], k) for a, b, k, _ in pii.detect(text)]

    text = "Mrs Joan Baker and Dr Alexandra Smith met Mr Schmidt. Later Schmidt and SCHMIDT left; Baker stayed, Baker's dog and Joan too, but a baker did not."
    assert [w for w, _ in names(text)] == ["Joan", "Baker", "Alexandra", "Smith", "Schmidt", "Schmidt", "SCHMIDT", "Baker", "Baker", "Joan"]
    new = pii.replaced(text, {}, b"k")[0]
    parts = re.fullmatch(r"Mrs (\w+) (\w+) and Dr (\w+) (\w+) met Mr (\w+)\. Later (\w+) and (\w+) left; (\w+) stayed, (\w+)'s dog and (\w+) too, but a baker did not\.", new)
    assert parts[5] == parts[6] and parts[7] == parts[5].upper() and parts[2] == parts[8] == parts[9] and parts[1] == parts[10]
    assert {parts[1], parts[3]} <= set(pii.GIVEN["latin", "f"]) and len({*parts.groups()}) == 6
    assert not any(re.search(rf"\b{w}\b", new, re.I) for w in ("Joan", "Alexandra", "Smith", "Schmidt"))
    assert names("Maria Lopez called. Lopez agreed. MARIA LOPEZ") == [("Maria", "given_f"), ("Lopez", "surname"), ("Lopez", "surname"), ("MARIA", "given_f"), ("LOPEZ", "surname")]
    assert names("Mr J. R. Smith-Jones, Herr Otto von Bismarck, Señora Šimić, Frau Łucja Żak") == [("Smith-Jones", "surname"), ("Otto", "given_m"), ("Bismarck", "surname"), ("Šimić", "surname"), ("Łucja", "given_f"), ("Żak", "surname")]
    assert names("Г-жа Ольга Петрова; Петрова") == [("Ольга", "given_f"), ("Петрова", "surname"), ("Петрова", "surname")]
    # whose gender one mention tells, other mentions take it from there
    assert names("Dr Joan Baker spoke. Mrs Joan Baker left.") == [("Joan", "given_f"), ("Baker", "surname")] * 2
    new = pii.replaced("Mr Smith-Jones and Г-н Иванов", {}, b"k")[0]
    assert re.fullmatch(r"Mr [A-Z][a-z]+-[A-Z][a-z]+ and Г-н [А-Я][а-я]+", new)


def test_pii_checksums_and_scripts():
    def rest(iban):
        iban = iban.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97

    for valid in ("DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19", "FR14 2004 1010 0505 0001 3M02 606"):
        for key in (b"a", b"b", b"c"):
            new = pii.replaced(f"to {valid}.", {}, key)[0][3:-1]
            assert rest(valid) == 1 and rest(new) == 1 and new[:2] == valid[:2] and new != valid and [c == " " for c in new] == [c == " " for c in valid]
    assert rest(pii.replaced("DE88370400440532013000", {}, b"k")[0]) != 1
    card = "4111 1111 1111 1112"  # not valid, and stays so
    assert pii.luhn(pii.digits_of(pii.replaced(card, {}, b"k")[0])[:-1]) != int(pii.digits_of(pii.replaced(card, {}, b"k")[0])[-1])
    import unicodedata

    for address in ("محمد@example.com", "почта@пример.рф", "数学@example.com", "กข@example.com", "שלום9@example.com"):
        new = pii.replaced(f"an {address} .", {}, b"k")[0][3:-2]
        assert new != address and new.count("@") == 1 and len(new) == len(address)
        for a, b in zip(address, new, strict=True):
            assert unicodedata.category(a) == unicodedata.category(b) and unicodedata.name(a).split(" ")[0] == unicodedata.name(b).split(" ")[0]
    new = pii.replaced("٠١٢ +٩٦٦ ٥٠١٢٣٤٥٦٧", {}, b"k")
    assert not new[1] or all(c in "٠١٢٣٤٥٦٧٨٩+ " for c in new[0])


def test_pii_time_goes_with_length():
    import time

    def taken(n):
        text = " ".join(f"k{i}@mail.example.com, Mr Abc{i}x, 10.{i % 250}.0.{i // 250}" for i in range(n))
        start = time.perf_counter()
        assert len(pii.detect(text)) >= 2 * n
        return time.perf_counter() - start

    taken(100)
    assert taken(16_000) < 16 * max(taken(2_000), 0.02)


def test_pii_surrogates_are_distinct(spark):
    # far more given names than the list holds, and short numbers that meet each other
    names = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    known = [("given_f", f"{n}{m}") for n in names for m in ("na", "la", "ra", "ta")] + [("given_m", "adam"), ("given_m", "bruno")] + [("surname", f"{a}{b}") for a in pii.SYLLABLES["latin"] for b in pii.SYLLABLES["latin"]]
    known += [("ssn", f"{k:09d}") for k in range(0, 3000, 7)]
    df = spark.createDataFrame(known, "kind string, form string")
    again = {(r["kind"], r["form"]): r["attempt"] for r in pii.redrawn(df, b"k").collect()}
    assert again == {(r["kind"], r["form"]): r["attempt"] for r in pii.redrawn(df.repartition(7), b"k").collect()}
    drawn = collections.defaultdict(list)
    for kind, form in known:
        drawn[kind.partition("_")[0]].append(pii.surrogate(kind, form, again.get((kind, form), 0), b"k"))
    for family, cores in drawn.items():
        assert len(set(cores)) == len(cores), family
        assert not set(cores) & {f for k, f in known if k.partition("_")[0] == family}
    assert pii.redrawn(spark.createDataFrame([("email", "a@b.example")], df.schema), b"k") is None


def test_pii_over_tables(spark, odd, none):
    extra = odd.withColumn("PII_spans", F.lit(1)).withColumn("_uid", F.lit(7)).withColumn("_NEW", F.lit("n")).withColumn("_hits", F.lit(8)).withColumn("_again", F.lit(9))
    out = pii.pseudonymise(extra, b"k")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_uid", "_NEW", "_hits", "_again", "pii_spans"]
    assert sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, odd.select("doc_id", "text").collect()))
    assert {tuple(r) for r in out.select("_uid", "_NEW", "_hits", "_again").collect()} == {(7, "n", 8, 9)}
    assert pii.pseudonymise(none, b"k").count() == 0
    texts = [f"Frau Ilse{'abcdefghij'[k % 10]} schrieb an k{k}@mail.example.com" for k in range(60)]
    df = spark.createDataFrame(rows(texts), DOCS)
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(df, b"k").collect()}
    surnames = [t.split()[1] for t in (got[k] for k in range(60))]
    assert len(set(surnames)) == 10 and all(surnames[k] == surnames[k % 10] for k in range(60))
    assert len({t.split()[-1] for t in got.values()}) == 60 and not set(got.values()) & set(texts)
    again = pii.pseudonymise(df.union(df), b"k").collect()
    assert collections.Counter(r["text"] for r in again) == {t: 2 for t in got.values()}


# ---- 2 suffix arrays


def brute_repeats(texts, n):
    seen = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def cut(df, **more):
    got = suffix_dedup.cut_repeats(df, **more).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    return sorted((tuple(r) for r in got.collect()), key=str)


def wanted(df, n):
    had = df.select("doc_id", "text").collect()
    return sorted(((r["doc_id"], *x) for r, x in zip(had, brute_repeats([(r["text"] or "").encode() for r in had], n), strict=True)), key=str)


@pytest.mark.parametrize("more", [{}, {"batch": 32}, {"batch": 32, "hot": 3}])
def test_suffix_dedup_small_windows(docs, more):
    some = docs.where("n_chars < 4000")
    assert cut(some, length=60, gram=16, **more) == wanted(some, 60)


def test_suffix_dedup_odd(odd, none):
    assert cut(odd) == wanted(odd, 400)
    assert cut(odd.withColumn("Kept", F.lit(1)), length=20, gram=8) == wanted(odd, 20)
    assert cut(none) == []


def test_passage_in_many_texts(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(40))
    texts = [" ".join([*(word() for _ in range(rng.randrange(30))), passage, *(word() for _ in range(rng.randrange(30)))]) for _ in range(80)]
    df = spark.createDataFrame(rows(texts), DOCS).repartition(5)
    want = wanted(df, 100)
    assert all(r[2] >= len(passage) for r in want)
    for more in ({}, {"hot": 10}, {"batch": 16}):
        assert cut(df, length=100, gram=16, **more) == want


def test_family_of_levels():
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(20, 60))).encode() for _ in range(300)]
    n = 16
    counts = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    segments, places = [], []
    x, _ = suffix_dedup.anchors(texts, n, 6, distinct=False)
    for k in range(len(x["i"])):
        t, p, a, b = texts[x["i"][k]], *(int(x[c][k]) for c in "pab")
        segments.append((int(x["h"][k]), t[a:p], t[p : b + n]))
        places.append((t, p, a, b))
    assert sum(b - a + 1 for _, _, a, b in places) == sum(max(0, len(t) - n + 1) for t in texts)
    family = suffix_dedup.Family(n, 40)
    family.add(segments)
    hits = np.concatenate(family.hits)
    for k, (t, p, a, b) in enumerate(places):
        for i in range(a, b + 1):
            assert hits[k, p - i] == (counts[t[i : i + n]] > 1)
    ranks = [level.rank for level in family.levels]
    assert ranks == sorted(set(ranks), reverse=True)
    # a level from before is compared with what is added, not with itself
    old, new = segments[:200], segments[200:]
    family = suffix_dedup.Family(n, 40)
    family.load(sorted(old, key=lambda s: s[2]))
    family.add(new)
    hits, order = np.concatenate(family.hits), sorted(range(200), key=lambda k: segments[k][2])
    later = collections.Counter(t[i : i + n] for t, _, a, b in places[200:] for i in range(a, b + 1))
    for k, place in enumerate(order):
        t, p, a, b = places[place]
        for i in range(a, b + 1):
            assert (later[t[i : i + n]] > 0) <= hits[k, p - i] <= (counts[t[i : i + n]] > 1)


PERIODIC = ["a" * 30_000, "ab" * 4000, "abc" * 2000 + "x" + "abc" * 500, "b" * 399, "b" * 400, "b" * 401, "".join(chr(97 + k * k % 23) for k in range(4000)) * 2]


def test_segments_of_periodic_texts():
    for t in PERIODIC[:2]:
        x, twice = suffix_dedup.anchors([t.encode()] * 2)
        assert len(x["i"]) <= 8 and list(twice["i"]) == [0, 1] and (twice["a"] <= 1).all() and (twice["b"] >= len(t) - 402).all()
    x, twice = suffix_dedup.anchors([("a" * 3_000_000).encode()], piece=1 << 16)
    assert len(x["i"]) == 1 and int(x["n"][0]) == 3_000_000 - 399 and len(twice["i"]) == 1
    rng = np.random.default_rng(6)
    i, a = rng.integers(0, 4, 60), rng.integers(0, 300, 60)
    b = a + rng.integers(0, 9, 60)
    cover = {(int(k), p) for k, x, y in zip(i, a, b, strict=True) for p in range(x, y + 1)}
    got = suffix_dedup.ranges(i, a, b)
    assert {(int(k), p) for k, x, y in zip(*(got[c] for c in "iab"), strict=True) for p in range(x, y + 1)} == cover
    assert all(k != l or y + 1 < x for k, y, l, x in zip(got["i"], got["b"], got["i"][1:], got["a"][1:], strict=False))


def test_suffix_dedup_of_periodic_texts(spark):
    df = spark.createDataFrame(rows([*PERIODIC, *PERIODIC[2:4], "q" + PERIODIC[1][:700]]), DOCS).repartition(3)
    assert cut(df) == wanted(df, 400)
    assert cut(df, length=50, gram=8, hot=2) == wanted(df, 50)


def test_suffix_dedup_of_a_long_text(spark):
    # 10 MB that repeat nothing, twice 60 kB of them in another text, and 10 MB of one byte
    rng = np.random.default_rng(5)
    long = bytes(rng.integers(33, 127, 10_000_000, dtype=np.uint8)).decode()
    df = spark.createDataFrame(rows([long, long[5_000_000:5_060_000] + "|" + long[9_000_000:9_060_000], "z" * 10_000_000]), DOCS)
    got = {r["doc_id"]: r for r in suffix_dedup.cut_repeats(df).collect()}
    assert (got[0]["n_removed"], got[0]["n_spans"], got[1]["n_removed"], got[2]["n_removed"], got[2]["n_spans"]) == (120_000, 2, 120_000, 10_000_000, 1)
    assert bytes(got[0]["kept"]).decode() == long[:5_000_000] + long[5_060_000:9_000_000] + long[9_060_000:] and bytes(got[1]["kept"]) == b"|"


def test_suffix_dedup_clashing_columns(spark):
    names = ["_uid", "_AT", "_z", "_anchors", "_twice", "_hits", "_done", "uid", "h", "N_spans"]
    df = spark.createDataFrame([("t" * 500, *range(10)), (None, *range(10)), ("t" * 500, *range(10))], f"text string, {', '.join(n + ' int' for n in names)}")
    out = suffix_dedup.cut_repeats(df)
    assert out.columns == [*names[:-1], "n_bytes", "n_removed", "n_spans", "kept", "spans"]
    assert sorted((r["n_bytes"], r["n_removed"], r["_z"], r["_AT"], r["uid"]) for r in out.collect()) == [(0, 0, 2, 1, 7), (500, 500, 2, 1, 7), (500, 500, 2, 1, 7)]


@pytest.mark.parametrize("more", [{"batch": 16}, {"batch": 64, "hot": 3}])
def test_index_of_batches(spark, docs, more):
    some = docs.where("n_chars < 3000").select("doc_id", "text").orderBy("doc_id").limit(90)
    extra = spark.createDataFrame([(1000 + k, t) for k, t in enumerate([None, "", "a" * 900, "ab" * 300, "a" * 150])], some.schema)
    whole = some.union(extra)
    index = suffix_dedup.RepeatIndex(length=60, gram=16, **more)
    for k in range(3):
        index.add(whole.where(f"doc_id % 3 = {k}").repartition(2))
        ranks = [r for r, _ in index.levels]
        assert ranks == sorted(set(ranks), reverse=True)
    got = [tuple(r) for k in range(3) for r in index.repeats(k).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()]
    assert sorted(got, key=str) == wanted(whole, 60)
    for _, level in index.levels:
        for part in level.rdd.glom().collect():
            assert [bytes(r["right"]) for r in part] == sorted(bytes(r["right"]) for r in part)


def test_levels_deal_one_anchor_to_many_tasks(spark):
    """One passage in texts that are otherwise unlike: its anchors' kinds of segment don't all land in one task's run of a level."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(12))
    df = spark.createDataFrame(rows([" ".join([*(word() for _ in range(30)), passage, *(word() for _ in range(30))]) for _ in range(200)]), DOCS)
    index = suffix_dedup.RepeatIndex(length=100, gram=16)
    for k in range(2):
        index.add(df.where(f"doc_id % 2 = {k}"))
    ((_, level),) = index.levels
    runs = [collections.Counter(r["h"] for r in part) for part in level.rdd.glom().collect()]
    h, n = sum(runs, collections.Counter()).most_common(1)[0]
    assert n >= 100 and max(run[h] for run in runs) < n / 2
    got = [tuple(r) for k in range(2) for r in index.repeats(k).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()]
    assert sorted(got, key=str) == wanted(df, 100)


# ---- 3 SimHash


def plain_fingerprint(text, words=3):
    import xxhash

    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not parts:
        return 0
    found = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(prints, bits):
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_fingerprint(texts):
    for t in [*ODD, *list(texts.values())[:40]]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("leaf", [1024, 2])
def test_simhash_groups(docs, odd, none, leaf):
    for df in (docs.select("doc_id", "text"), odd.withColumn("FP", F.lit(2))):
        got = simhash.near_groups(df, leaf=leaf).select("doc_id", "fp", "component_id").collect()
        prints = [r["fp"] % (1 << 64) for r in got]
        root = joined(prints, 3)
        least = {}
        for r, k in zip(got, root, strict=True):
            if r["doc_id"] is not None:
                least[k] = min(least.get(k, 1 << 60), r["doc_id"])
        assert [r["component_id"] for r in got] == [least.get(k) for k in root]
        assert len(got) == df.count()
    assert simhash.near_groups(none).count() == 0


def test_links_of_dense_fingerprints(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for b in base for _ in range(60)} | {b for b in base}
    prints = sorted(p & simhash.ALL for p in prints)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    for leaf in (1024, 4):
        pairs = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(df, leaf=leaf).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
        up = {p: p for p in prints}

        def root(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            a, b = sorted((root(a), root(b)))
            up[b] = a
        want = joined(prints, 3)
        assert [prints.index(root(p)) for p in prints] == want


def test_similar_groups(spark, odd, none):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(3, 8)))
    shared = [word() for _ in range(30)]
    texts, group = [], []
    for g in range(40):
        base = [word() for _ in range(rng.randrange(120, 500))] + shared
        for c in range(1 + g % 4):
            mine = list(base)
            for _ in range(len(base) // 120 * min(c, 1)):
                mine[rng.randrange(len(mine))] = word()
            texts.append(" ".join(mine))
            group.append(g)
    df = spark.createDataFrame(rows(texts), DOCS).repartition(4)
    for most in ((simhash.ROWS, simhash.SHINGLES), (3, 700)):
        got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in simhash.similar_groups(df, most=most).collect()}
        assert [got[k][0] for k in range(len(texts))] == [group.index(g) for g in group]
        assert [k for k in range(len(texts)) if got[k][1]] == sorted({group.index(g) for g in group})
    out = simhash.similar_groups(odd.withColumn("KEPT", F.lit(1))).collect()
    assert len(out) == odd.count()
    kept = [r["text"] for r in out if r["kept"]]
    assert sum(not (t or "").split() for t in kept) == 1 and kept.count("same text here again") == 1
    assert sum((t or "").lower() == "one two" for t in kept) == 1 and LONG in kept and "a row without a key" in kept
    assert simhash.similar_groups(none).count() == 0


def grouped_by_jaccard(texts, similarity=0.8, words=5):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))})
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) and up[i] != up[j]:
                a, b = sorted((up[i], up[j]))
                up = [a if x == b else x for x in up]
    return up


def similar_to_brute_force(spark, texts, most=(simhash.ROWS, simhash.SHINGLES)):
    df = spark.createDataFrame(rows(texts), DOCS).repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(df, most=most).collect()}
    assert [got[k] for k in range(len(texts))] == grouped_by_jaccard(texts)


def test_similar_groups_of_short_texts(spark):
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = []
    for n in (5, 8, 9, 12, 20, 25, 30):
        for _ in range(25):
            base = [word() for _ in range(n)]
            changed = [word(), *base[1:]]
            texts += [" ".join(base), " ".join([*base, word()]), " ".join(changed)]
    similar_to_brute_force(spark, texts)


def test_similar_groups_of_chains(spark):
    rng = random.Random(22)
    texts = []
    for _ in range(6):  # revisions, each like the next but not like those far off, between two of which others may stand
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(30):
            base[rng.randrange(len(base))] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(base))
    rng.shuffle(texts)
    similar_to_brute_force(spark, texts, (2, 150))
    sizes = np.array([100] * 3)
    counts = np.zeros((3, simhash.COUNTERS), np.uint8)
    counts[0, :100], counts[1, 11:111], counts[2, 22:122] = 1, 1, 1
    assert sorted(map(sorted, simhash.connected(3, simhash.may_be_near(sizes, counts, 0.8)))) == [[0, 1], [1, 2]]


def test_large_groups_lose_no_link(spark):
    # points on a line, linked at a distance of 1, in groups that need many blocks; few of them may meet a leader
    rng = random.Random(41)
    points = [rng.uniform(0, 400) for _ in range(700)]
    groups = [(g, k) for g in range(3) for k in range(len(points)) if k % 3 != g]
    df = spark.createDataFrame(groups, "g long, uid long")
    values = spark.createDataFrame([(k, 1, x) for k, x in enumerate(points)], "uid long, w int, x double")

    def nearness(held):
        x = np.array([v for (v,) in held])
        return lambda i, rest: np.abs(x[rest] - x[i]) <= 1

    up = list(range(len(points)))
    for g in range(3):
        order = sorted((k for k in range(len(points)) if k % 3 != g), key=points.__getitem__)
        for a, b in zip(order, order[1:], strict=False):
            if points[b] - points[a] <= 1:
                a, b = sorted((up[a], up[b]))
                up = [a if y == b else y for y in up]
    one, rest = df.where("g = 0"), df.where("g > 0")
    for most, leaders, first, wanted in ((60, 16, df, None), (25, 0, df, None), (60, 16, one, rest)):
        got = {r["uid"]: r["root"] for r in simhash.in_groups(first, values, nearness, ["x"], most, leaders=leaders, wanted=wanted).collect()}
        assert [got.get(k, k) for k in range(len(points))] == up


def test_frequent_shingles(spark):
    df = spark.createDataFrame([(k, 2 + k) for k in range(200)] + [(1000 + k, 9000) for k in range(5)], "s long, n long")
    for most in (0, 3, 5, 17, 60, 205, 1000):
        got = simhash.frequent(df, most)
        assert len(got) <= most and (len(got) >= min(205, most) * 0.4 or most < 5) and (not len(got) or 1000 in got)


def test_similar_groups_clashing_columns(spark):
    names = ["_s", "_FP", "_p", "_uid", "_best", "uid", "root", "s", "component_ID"]
    df = spark.createDataFrame([(k, f"a b c d e f g h {k // 2}", *range(9)) for k in range(6)], f"doc_id long, text string, {', '.join(n + ' int' for n in names)}")
    out = simhash.similar_groups(df)
    assert out.columns == ["doc_id", "text", *names[:-1], "component_id", "kept"]
    assert sorted((r["doc_id"], r["component_id"], r["_uid"], r["_FP"], r["uid"]) for r in out.collect()) == [(k, k // 2 * 2, 3, 1, 5) for k in range(6)]


def test_similar_groups_of_a_shared_passage(spark):
    rng = random.Random(23)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = words(14)
    texts = [" ".join(shared), *(" ".join([*shared, *words(n)]) for n in (1, 2, 3, 9, 12, 20) for _ in range(6))]
    for most in ((simhash.ROWS, simhash.SHINGLES), (2, 30)):
        similar_to_brute_force(spark, texts, most)


def test_similar_groups_leave_texts_below_the_similarity(spark):
    rng = random.Random(24)
    texts = []
    for k in range(120):
        base = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        cut = 10 + k % 30  # as many shingles are exchanged of 200: 0.8 is at 22
        texts += [" ".join(base), " ".join([*base[: 204 - cut], *(f"v{rng.randrange(10**6)}" for _ in range(cut))])]
    similar_to_brute_force(spark, texts)


# ---- 4 language


def test_language_gradient():
    net = language_id.fresh(["a", "b"], 3, 1)
    for p in (net.w, net.u, net.b):
        p[:] = [x.astype(np.float64) for x in p]
    net.v, net.c = net.v.astype(np.float64), net.c.astype(np.float64)
    rng = np.random.default_rng(0)
    ids, y = rng.integers(0, 257, (6, 5)).astype(np.int16), np.array([0, 1, 1, 0, 1])
    _, grads = language_id.gradient(net, ids, y)
    for p, g in zip(net.parts(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), p.shape)
        old = p[at]
        p[at] = old + 1e-3
        up, _ = language_id.gradient(net, ids, y)
        p[at] = old - 1e-3
        down, _ = language_id.gradient(net, ids, y)
        p[at] = old
        assert g[at] == pytest.approx((up - down) / 2e-3, rel=1e-3)


def test_language_positions_follow_both_sides():
    net = language_id.fresh(["a", "b"], 4, 2)
    ids = np.full((language_id.SPAN, 1), 97, np.int16)
    one = language_id.probabilities(net, ids)
    ids[-1] = 98
    assert np.abs(one - language_id.probabilities(net, ids))[language_id.SPAN - 3].max() > 0
    assert one.shape == (language_id.SPAN, 1, 2) and np.allclose(one.sum(axis=2), 1)


def test_language_on_held_out_documents(spark, docs, odd, none, data):
    many = spark.read.parquet(f"{data}/../sf0.01/documents.parquet")
    net = language_id.trained(many, sample=700)
    out = language_id.identify(many.withColumn("SCORE", F.lit(1)), net).where(labelled.fold("doc_id", 5) == 0).collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in out]) >= 0.95 and all(0 <= r["score"] <= 1 for r in out)
    got = {r["text"]: (r["lang_pred"], r["score"]) for r in language_id.identify(odd, net).collect()}
    for t in ODD:
        assert got[t][0] == "und" if not t or not any(c.isalpha() for c in t) else got[t][0] in ("de", "en", "es", "fr")
    assert language_id.identify(none, net).count() == 0 and language_id.trained(none) is None
    assert {r["lang_pred"] for r in language_id.identify(odd, None).collect()} == {"und"}


def plain_language(net, text):
    """The mean of the distributions at every byte, each of two gated recurrent units that read a span's bytes one by one from either side."""
    data, k = text.encode(), net.u[0].shape[0]
    total = np.zeros(len(net.labels))
    for a in range(0, len(data), language_id.SPAN):
        span = list(data[a : a + language_id.SPAN])
        span += [256] * (language_id.SPAN - len(span))
        seen = np.zeros((2, len(span), k))
        for way in (0, 1):
            h = np.zeros(k)
            for t in range(len(span)) if way == 0 else reversed(range(len(span))):
                w, u = net.w[way][span[t]].astype(float), h @ net.u[way].astype(float)
                z, r = (np.clip(0.25 * (w[i * k : (i + 1) * k] + u[i * k : (i + 1) * k]) + 0.5, 0, 1) for i in (0, 1))
                h = z * h + (1 - z) * np.tanh(w[2 * k :] + r * (u[2 * k :] + net.b[way]))
                seen[way, t] = h
        for t in range(len(span)):
            if span[t] != 256:
                e = np.exp(np.concatenate(seen[:, t]) @ net.v + net.c)
                total += e / e.sum()
    return total / len(data)


def test_language_forward_pass(spark, texts):
    rng = np.random.default_rng(8)
    net = language_id.fresh(["a", "b", "c"], 5, 8)
    net.b, net.c = [rng.standard_normal(5).astype(np.float32) for _ in (0, 1)], rng.standard_normal(3).astype(np.float32)
    some = [*list(texts.values())[:12], "a", "é日本 🙂 ½", "x" * 64, "y" * 65]
    out = {r["text"]: (r["lang_pred"], r["score"]) for r in language_id.identify(spark.createDataFrame(rows(some), DOCS).repartition(2), net).collect()}
    for t in some:
        want = plain_language(net, t)
        assert out[t][0] == net.labels[int(want.argmax())] and out[t][1] == pytest.approx(want.max(), abs=1e-4)


def test_language_needs_a_letter(spark):
    net = language_id.fresh(["a"], 4, 1)
    for t in ("½", "²³", "Ⅷ", "12_3 !", "①", "ↀ", "\u0300"):
        assert language_id.predict(net, [t]) == (["und"], [0.0])
    for t in ("a", "½ ß", "ª", "日", "ʰ", "_é"):
        assert language_id.predict(net, [t])[0] == ["a"]
    # documents without a letter are not learned from
    df = spark.createDataFrame([(k, "½ ² Ⅷ", "xx", "s", 1) for k in range(9)] + [(k + 9, "the house", "en", "s", 1) for k in range(9)], DOCS)
    assert language_id.trained(df, sample=8).labels == ["en"]


def test_language_ties_and_copies():
    net = language_id.fresh(["a", "b"], 4, 1)
    net.v[:], net.c[:] = 0, 0
    assert language_id.predict(net, ["x y", "x y", "z"]) == (["a"] * 3, [0.5] * 3)


def test_language_learns_from_whole_texts(spark):
    # only the ends of long texts tell their languages
    same = "0123456789 " * 300
    df = spark.createDataFrame([(k, same + ("the house and the garden " if k % 2 else "το σπίτι και ο κήπος ") * 200, "en" if k % 2 else "el", "s", 1) for k in range(60)], DOCS)
    net = language_id.trained(df, sample=16)
    assert language_id.predict(net, ["the garden and the house", "ο κήπος και το σπίτι"])[0] == ["en", "el"]
    got = labelled.pieces(df.select("doc_id", "text", "lang"), 64, "lang").collect()
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    assert all(b"".join(map(bytes, r["pieces"])).decode() == texts[r["doc_id"]] for r in got)


def test_language_learns_a_bounded_number_of_languages(spark):
    df = spark.createDataFrame([(k, "abc " * 20, f"l{min(k % 30, k // 30):02d}", "s", 1) for k in range(600)], DOCS)
    assert len({r["lang"] for r in df.collect()}) == 20 and language_id.trained(df, sample=40, languages=3).labels == ["l00", "l01", "l02"]


def test_language_of_a_long_text_is_its_parts(texts):
    net = language_id.fresh(["a", "b"], 8, 3)
    for t in list(texts.values())[:5]:
        ids = language_id.spans_of(np.frombuffer(t.encode(), np.uint8)).T
        p = language_id.probabilities(net, np.ascontiguousarray(ids))
        mean = p[ids != language_id.PAD].mean(axis=0)
        assert language_id.predict(net, [t])[1][0] == pytest.approx(mean.max(), rel=1e-4)


def test_language_sample_is_even(spark):
    # one language in a thousand documents, and labels that are few in a large table
    texts = {"en": "the house and the garden of the town", "el": "το σπίτι και ο κήπος της πόλης", "fr": "la maison et le jardin de la ville"}
    common = [(k, texts["el" if k % 1000 == 7 else "en"], "el" if k % 1000 == 7 else "en", "s", 1) for k in range(4000)]
    assert language_id.trained(spark.createDataFrame(common, DOCS), sample=40).labels == ["el", "en"]
    sparse = [(k, texts["en"], ("en" if k % 2 else "fr") if k % 1000 < 2 else None, "s", 1) for k in range(4000)]
    assert language_id.trained(spark.createDataFrame(sparse, DOCS), sample=8).labels == ["en", "fr"]
    assert language_id.shares({"a": 3, "b": 100, "c": 100}, 43) == {"a": 3, "b": 20, "c": 20}


# ---- 5 HTML


def test_html_gradient():
    net = html_extract.fresh(1)
    for n in ("path", "word", "v", "c"):
        setattr(net, n, getattr(net, n).astype(np.float64))
    net.w, net.u, net.b = ([x.astype(np.float64) for x in y] for y in (net.w, net.u, net.b))
    rng = np.random.default_rng(3)
    pages = [html_extract.labelled(rng) for _ in range(2)]
    batch = html_extract.batched([html_extract.features(b) for b, _ in pages])
    y = np.zeros(batch.real.shape, np.float32)
    for j, (_, labels) in enumerate(pages):
        y[: len(labels), j] = labels
    _, grads = html_extract.gradient(net, batch, y)
    for p, g in zip(net.parts(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), p.shape)
        old = p[at]
        p[at] = old + 1e-2
        up, _ = html_extract.gradient(net, batch, y)
        p[at] = old - 1e-2
        down, _ = html_extract.gradient(net, batch, y)
        p[at] = old
        assert g[at] == pytest.approx((up - down) / 2e-2, rel=1e-2)


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>a<p>b &amp; c&nbsp;d</p>", ["a", "b & c d"]),
        ("<ul><li>x<li>y <b>z</b></ul>", ["x", "y z"]),
        ("<script>if (a < b) '</p>'</script><style>p{}</style><p>t", ["t"]),
        ("<!-- <p>no</p> --><p>yes", ["yes"]),
        ("<p><b>h<br><p>t</p>", ["h", "t"]),
        ("a<br>b", ["a b"]),
        ("<p title='a > b'>q</p>", ["q"]),
        ("1 < 2 and <3", ["1 < 2 and <3"]),
        ("<select><option>o</select><p>t", ["t"]),
        ("<p>cut <b", ["cut"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("&lt;p&gt; &amp;amp; &#233;&eacute", ["<p> &amp; éé"]),
        ("<title>t</title><svg><text>s</text></svg>", []),
        ("<p>for <math><mi>x</mi><mo>=</mo><mn>2</mn></math> only</p>", ["for x=2 only"]),
        ("<object data=x><p>fallback</object>", ["fallback"]),
        ("<p>before <svg><g><path d=M0></g></svg> after</p>", ["before after"]),
        ("<p>Choose <select><option>a<option>b</select> now</p>", ["Choose now"]),
        ("<p>a <button>Press</button> b<iframe src=x></iframe>c <canvas>no</canvas>d</p>", ["a bc d"]),
        ("<p>a<video><source src=x><p>no</video> b<script>var p = '<p>';</script>c</p>", ["a bc"]),
        ("<p>a<svg/>b <audio controls>no</audio></p><p>c", ["ab", "c"]),
        ("<div>a <select><option>x</div><p>b", ["a", "b"]),
        ("<p>a <button>x<div>y</div></button> b</p><p>c", ["a b", "c"]),
        ("<b><i>a</b>b</i></u>c<p>d</b>e", ["abc", "de"]),
        ("<div><b>a<div>b</b>c</div>d</div>", ["a", "bc", "d"]),
        ("", []),
        (None, []),
    ],
)
def test_blocks(source, want):
    assert [b.text for b in html_extract.blocks(source)] == want


def test_html_on_pages_not_seen():
    net, rng = html_extract.trained(), np.random.default_rng(4321)
    wrong = total = 0
    for _ in range(150):
        found, y = html_extract.labelled(rng)
        *_, p, _ = html_extract.forward(net, html_extract.batched([html_extract.features(found)]))
        wrong, total = wrong + int(((p[:, 0] >= 0.5) != (y == 1)).sum()), total + len(y)
    assert wrong / total < 0.01


def article(source):
    """The article of the pages table's one layout."""
    import html

    inner = source[source.index("<article>") + 9 : source.index("</article>")]
    parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:h1|p)>", inner)]
    return "\n".join(x for x in parts if x)


def test_html_prediction_is_the_forward_pass():
    net, rng = html_extract.fresh(3), np.random.default_rng(77)
    pages = [html_extract.labelled(rng)[0] for _ in range(9)]
    batch = html_extract.batched([html_extract.features(x) for x in pages])
    *_, p, _ = html_extract.forward(net, batch)
    assert np.abs((p - html_extract.predicted(net, pages))[batch.real]).max() < 1e-5
    for found in pages[:3]:
        want = p[: len(found), pages.index(found)]
        for most in (1, 2, 5):
            assert np.abs(html_extract.predicted(net, [found], most)[:, 0] - want).max() < 1e-5


MEMORY = """
import resource, sys
from ledgerleaf.llm import html_extract
net = html_extract.fresh(1)
small = ["<p>some words here<p>and more"] * 63
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
html_extract.main_texts(net, ["<p>a" * 60_000, *small, "<div class=x>" * 100_000 + "y", "<b>" * 50_000 + "<p>y" * 5_000, "<div>" * 50_000 + "</section>" * 50_000, "<p>" + "word " * 200_000])
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""


def test_html_memory_goes_with_the_page():
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", MEMORY], capture_output=True, text=True, check=True, timeout=200)
    assert int(done.stdout) < 300_000  # KiB; a page padded to the longest one took over 4 GB


def test_html_extract(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    out = html_extract.extract(pages.withColumn("TEXT", F.lit(1))).collect()
    assert np.mean([r["text"] == article(r["html"]) for r in out]) >= 0.98
    whole = pages.first()["html"]
    odd = [None, "", "<p>", "<div>" * 3000, "<nav><a href=/>Home</a></nav>", whole, whole, "<!-- " + whole.replace("-->", ""), "<script>" + whole.replace("</script>", "")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(list(enumerate(odd)), "page_id int, html string")).collect()}
    assert [got[k] for k in range(len(odd))] == ["", "", "", "", "", article(whole), article(whole), "", ""]
    assert html_extract.extract(spark.createDataFrame([], "page_id int, html string")).count() == 0


# ---- 6 lattice


def test_decode_gives_the_nearest_point():
    x = np.random.default_rng(0).standard_normal((300, 8)) * 2
    p = lattice.decode(x)
    near = ((x[:, None] - (p[:, None] + lattice.ROOTS)) ** 2).sum(axis=2).min(axis=1)
    assert (((x - p) ** 2).sum(axis=1) <= near + 1e-9).all() and len(lattice.ROOTS) == 240
    assert (np.abs((lattice.ROOTS**2).sum(axis=1) - 2) < 1e-9).all() and np.allclose(lattice.decode(lattice.ROOTS), lattice.ROOTS)


def vectors(seed, groups, dim=64):
    rng = np.random.default_rng(seed)
    out = []
    for g, n in enumerate(groups):
        base = rng.standard_normal(dim)
        for _ in range(n):
            v = base + rng.standard_normal(dim) * np.linalg.norm(base) / np.sqrt(dim) * rng.uniform(0, 0.16)
            out.append((v * rng.uniform(0.5, 2), g % 3))
    return out


def brute_links(had, least=0.98):
    n, root = [0] * len(had), list(range(len(had)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ok = [v is not None and y is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, y in had]
    for i in range(len(had)):
        for j in range(i):
            if ok[i] and ok[j] and had[i][2] == had[j][2] and len(had[i][1]) == len(had[j][1]):
                a, b = np.array(had[i][1], float), np.array(had[j][1], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                    n[i], n[j] = n[i] + 1, n[j] + 1
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    comp = collections.defaultdict(list)
    for i in range(len(had)):
        comp[find(i)].append(had[i][0])
    return n, [min(comp[find(i)]) for i in range(len(had))]


def test_lattice_links(spark):
    had = [(k, [float(x) for x in v], y) for k, (v, y) in enumerate(vectors(1, [1] * 60 + [2, 3, 5, 40, 25]))]
    n = len(had)
    had += [(n, had[3][1], had[3][2]), (n + 1, had[3][1], had[3][2]), (n + 2, None, 1), (n + 3, [0.0] * 64, 1), (n + 4, [math.nan] + [1.0] * 63, 1), (n + 5, had[3][1], None), (n + 6, [1.0, 2.0], 1), (n + 7, [2.0, 4.0], 1), (n + 8, [], 1), (n + 9, [None, 1.0], 1), (n + 10, [math.inf, 1.0], 1)]
    df = spark.createDataFrame(had, "vec_id long, embedding array<double>, label int").withColumn("Kept", F.lit("x")).repartition(5)
    want = brute_links(had)
    for more in ({}, {"block": 7}, {"blocks": 1, "tables": 4}):
        got = {r["vec_id"]: r for r in lattice.near_vectors(df, **more).collect()}
        links, comp = [got[k]["n_links"] for k in range(len(had))], [got[k]["component_id"] for k in range(len(had))]
        assert all(a <= b for a, b in zip(links, want[0], strict=True)) and sum(links) >= 0.97 * sum(want[0])
        assert np.mean([a == b for a, b in zip(comp, want[1], strict=True)]) > 0.97
        assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert lattice.near_vectors(df.limit(0)).count() == 0


# ---- 7 mixing


def shares(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by resharing the excess until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, rest = set(), share * sum(sizes.values())
    while True:
        level = (rest - sum(most * sizes[s] for s in full)) / max(1e-300, sum(w[s] for s in names if s not in full))
        over = {s for s in names if s not in full and level * w[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else level * w[s] for s in names}
        full |= over


def test_mix(spark, odd, none, docs):
    rng = random.Random(17)
    skewed = spark.createDataFrame([(k, "w " * rng.randrange(0, 60), None, rng.choice(["a"] * 6 + ["b", "c", "d", None, "é"]), 0) for k in range(900)], DOCS)
    for df in (docs, skewed, odd):
        got = mixing.mix(df).collect()
        assert len(got) == df.count()
        size = collections.Counter()
        for r in got:
            size[r["source"]] += r["size"]
        want = shares(size)
        for s, n in size.items():
            mine = [r for r in got if r["source"] == s]
            assert all(r["source_size"] == n and r["target"] == pytest.approx(want[s]) for r in mine)
            assert abs(sum(r["taken"] for r in mine) - want[s]) <= max(r["size"] for r in mine) + 1e-6
        assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 for r in got)
        assert sorted(map(str, mixing.mix(df.repartition(7)).collect())) == sorted(map(str, got))
        taken = sum(r["copies"] for r in got)
        extra = df.withColumns({"_copies": F.lit(9), "_SIZE": F.lit(8), "_key": F.lit(7), "key": F.lit("k")})
        out = mixing.emitted(extra)
        assert out.columns == extra.columns and out.count() == taken and {(r[0], r[1], r[2]) for r in out.select("_copies", "_SIZE", "_key").collect()} == {(9, 8, 7)}
        assert mixing.emitted(df).columns == df.columns
        named = mixing.mix(df.withColumn("doc_id", F.concat(F.lit("k"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))).collect()
        assert len(named) == len(got) and all(r["key"].startswith("k") for r in named)
    assert mixing.mix(none).count() == 0 and mixing.emitted(none).count() == 0


def test_targets_of_many_sources(spark):
    rng = random.Random(18)
    sizes = {f"host{rng.randrange(10**6)}": rng.choice([0, 1, 3, 10, 500, 90_000]) + rng.randrange(50) for _ in range(400)} | {None: 77}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(6)
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = shares(sizes)
    assert got.keys() == sizes.keys() and all(got[s] == pytest.approx(want[s]) for s in sizes)
    one = {"only": 5}
    assert mixing.targets(spark.createDataFrame(list(one.items()), "source string, source_size long")).first()["target"] == pytest.approx(shares(one)["only"])


def test_mix_deals_keys_that_step(spark):
    # keys by thousands, and none: no bucket holds more than a few of the documents of one source and size
    df = spark.createDataFrame([(k * 4096 if k % 2 else None, f"w{k} x", None, "a", 0) for k in range(4000)], DOCS)
    buckets = df.select(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), "text").cast("binary")), 1, 3).alias("b")).groupBy("b").count().agg(F.max("count")).first()[0]
    assert buckets < 12
    got = mixing.mix(df).collect()
    assert abs(sum(r["taken"] for r in got) - 1.5 * 8000) <= 2


# ---- 8 BPE


def test_bpe_is_the_librarys(spark, texts, odd, none):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    there = Tokenizer.from_file(path)
    cases = [*ODD, *texts.values(), "I'm the dog's <|endoftext|> ΑΣ ΟΔΟΣ İstanbul x\x85y　z \x1c", "1234 ½ ²x", "<|startoftext|><|endoftext|>x<|endoftext", "中文 हिन्दी", "​⁠x", "a" * 3000]
    df = spark.createDataFrame(rows(cases), DOCS)
    out = bpe.decode(bpe.encode(df.withColumn("IDS", F.lit(1)), path), path)
    for r in out.collect():
        want = there.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == there.decode(want, skip_special_tokens=False)
    again = bpe.round_trip(df.withColumn("Decoded", F.lit(1)), path)
    assert sorted(map(str, again.select("doc_id", "ids", "decoded").collect())) == sorted(map(str, out.select("doc_id", "ids", "decoded").collect()))
    assert bpe.encode(none, path).count() == 0 and bpe.round_trip(none, path).count() == 0
    odd_ids = spark.createDataFrame([(None,), ([],), ([1, None, 49407, 10**6],)], "ids array<int>")
    with_null = odd_ids.where("ids is null or size(ids) = 0")
    assert {r["decoded"] for r in bpe.decode(with_null, path).collect()} == {""}


def test_bpe_of_every_code_point():
    """Each character between letters, digits and spaces gives the library's ids, whatever version of Unicode first had it."""
    from tokenizers import Tokenizer

    there, here = Tokenizer.from_file(tokenizer_path()), bpe.vocabulary(bpe.load(tokenizer_path()))
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x34000 or c % 97 == 0 or 0xE0000 <= c < 0xE0200)]
    wrong: list[str] = []
    for k in range(0, len(points), 20_000):
        texts = [f"a{c}b,{c}1 {c}" for c in map(chr, points[k : k + 20_000])]
        want = [e.ids for e in there.encode_batch(texts, add_special_tokens=False)]
        wrong += [hex(c) for c, t, ids in zip(points[k : k + 20_000], texts, want, strict=True) if np.frombuffer(here.encode(t), np.int32).tolist() != ids]
    assert not wrong, (len(wrong), wrong[:50])
    assert here.late.search("\u1c89") and bpe.FAR.search("\u1c89") and not any(here.late.search(chr(c)) for c in range(0x530))


def test_other_vocabularies_are_refused():
    import json

    spec = json.loads(bpe.load(tokenizer_path()))
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}):
        with pytest.raises(ValueError, match="another normaliser"):
            bpe.WordBpe(spec | change)


def test_merges_in_any_order():
    rng = random.Random(19)
    rank, k = {}, 0
    for a in range(40):
        for b in range(40):
            if rng.random() < 0.2:
                rank[a, b] = (k, rng.randrange(40))
                k += 1
    ranks = list(range(k))
    rng.shuffle(ranks)
    rank = {p: (ranks[r], m) for p, (r, m) in rank.items()}
    only, merged = {p: r for p, (r, _) in rank.items()}, [m for _, m in sorted(rank.values())]
    for _ in range(300):
        word = [rng.randrange(40) for _ in range(rng.randrange(0, 90))]
        slow = list(word)
        while pairs := [(rank[p][0], i) for i, p in enumerate(zip(slow, slow[1:], strict=False)) if p in rank]:
            _, i = min(pairs)
            slow[i : i + 2] = [rank[slow[i], slow[i + 1]][1]]
        assert bpe.merge_word(list(word), only, merged) == slow


# ---- 9 and 10 quality


@pytest.fixture(scope="module")
def many(spark, data):
    d = f"{data}/../sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_sample_is_bounded_and_outside_the_fold(many):
    docs, labels = many
    got = labelled.sample(docs, labels, per_class=20, folds=3, held_out=1).collect()
    assert collections.Counter(r["label"] for r in got) == {0: 20, 1: 20}
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 for r in got)
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    least = sorted((hashlib.md5(str(k).encode()).hexdigest(), k) for k, q in known.items() if q == 1 and zlib.crc32(str(k).encode()) % 3 != 1)[:20]
    assert {r["doc_id"] for r in got if r["label"] == 1} == {k for _, k in least}


def plain_chance(model, text):
    """The score by hand: pieces compressed one by one, and a line between the curve's neighbouring points."""
    import zstandard

    data, saved = (text or "").encode(), 0
    for k in range(0, len(data), 512):
        sizes = [len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(data[k : k + 512])) for d in (model.bad, model.good)]
        saved += sizes[0] - sizes[1]
    d = saved / max(1, len(data))
    if d <= model.at[0]:
        p = model.chances[0]
    elif d >= model.at[-1]:
        p = model.chances[-1]
    else:
        k = next(i for i, x in enumerate(model.at) if x > d)
        p = model.chances[k - 1] + (model.chances[k] - model.chances[k - 1]) * (d - model.at[k - 1]) / (model.at[k] - model.at[k - 1])
    return p


def test_compression_quality(many, odd, none):
    docs, labels = many
    model = compression_quality.trained(docs, labels)
    out = compression_quality.score(docs.withColumn("SCORE", F.lit(1)), model).join(labels, "doc_id").where(labelled.fold("doc_id", 3) == 1).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in out]) >= 0.9
    assert list(model.chances) == sorted(model.chances) and list(model.at) == sorted(model.at)
    got = compression_quality.score(odd, model).collect()
    assert all(r["score"] == pytest.approx(plain_chance(model, r["text"]), abs=1e-9) and 0 <= r["score"] <= 1 for r in got if len(r["text"] or "") < 10_000)
    for r in out[:60]:
        assert r["score"] == pytest.approx(plain_chance(model, r["text"]), abs=1e-9)
    assert len({r["score"] for r in got if r["text"] == "same text here again"}) == 1
    assert all(r["score"] < 0.5 for r in got if not (r["text"] or "").strip())
    assert all(compression_quality.chance(model, t) < 0.5 for t in ("", None, "a", " ", "\n" * 5000, "one " * 3000))
    assert compression_quality.score(none, model).count() == 0
    assert {r["score"] for r in compression_quality.score(odd, compression_quality.trained(none, labels)).collect()} == {0.5}


def test_compression_sample_covers_long_texts(spark):
    # what tells good from bad stands behind a long common beginning; keys come twice
    rng = random.Random(31)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 9)))
    good, bad = [word("abcdefgh") for _ in range(300)], [word("mnopqrst") for _ in range(300)]
    same = " ".join(word("uvwxyz") for _ in range(6000))
    texts = [same + " ".join(rng.choice(good if k % 2 else bad) for _ in range(4000)) for k in range(60)]
    docs = spark.createDataFrame([*rows(texts), *rows(texts[:20])], DOCS)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    model = compression_quality.trained(docs, labels, per_class=30)
    assert compression_quality.chance(model, " ".join(good)) > 0.6 > 0.4 > compression_quality.chance(model, " ".join(bad))
    held = labelled.sample(docs, labels, per_class=30, folds=3, held_out=1).collect()
    assert len({r["doc_id"] for r in held}) == len(held)


def test_isotonic_calibration():
    d, y = np.array([-1.0, 0.0, 1.0, 2.0, 3.0, 4.0]), np.array([0, 1, 0, 0, 1, 1])
    at, chances = compression_quality.calibrate(d, y, 0.5)
    assert at == (-1.0, 1.0, 3.5) and list(chances) == sorted(chances) and chances[0] < 0.5 < chances[2]
    assert chances[1] == pytest.approx((1 / 6 + 1 / 12) / (1 / 2 + 1 / 6))


def test_dictionary_of_few_pieces():
    assert compression_quality.dictionary([b"abc", b"de"]) == b"abcde"
    assert compression_quality.dictionary([b"a" * 512] * 300).count(b"a") <= compression_quality.DICTIONARY
    assert compression_quality.dictionary([b"xy" * 100_000] * 3) == b"xy" * 100_000


def test_texts_without_evidence_weigh_as_bad():
    d, y = np.array([-2.0, -1.0, -0.5, 0.5, 1.0, 2.0]), np.array([0, 0, 1, 1, 1, 1])
    for none, good in ((0.0, True), (0.2, False)):
        at, chances = compression_quality.calibrate(d, y, 0.5, none)
        assert (np.interp(0.0, at, chances) > 0.5) == good and list(chances) == sorted(chances) and np.interp(2.0, at, chances) > 0.5


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, cover = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            cover.update(range(i, i + 5))
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)]


def test_statistics(texts):
    for t in [*ODD, *texts.values(), "a b c d e a b c d e", "a a a a a a", "l\nl\n \n \nl\r\nl"]:
        assert boosted_rules.statistics(t)[0] == plain_statistics(t)


def test_boosted_rules(many, odd, none):
    docs, labels = many
    trees = boosted_rules.trained(docs, labels)
    out = boosted_rules.judge(docs.withColumn("KEPT", F.lit(1)), trees).join(labels, "doc_id").where(labelled.fold("doc_id", 3) == 1).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in out]) >= 0.95
    for r in boosted_rules.judge(odd, trees).collect():
        want = plain_statistics(r["text"])
        assert [r[c] for c in boosted_rules.BASE] == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r["base_failed"] and r["kept"])
    assert boosted_rules.judge(none, trees).count() == 0
    assert boosted_rules.trained(none, labels) is None
    assert all(r["kept"] != r["base_failed"] for r in boosted_rules.judge(odd, None).collect())


def test_trees_are_monotonic_and_flat():
    rng = np.random.default_rng(23)
    x = rng.uniform(size=(800, len(boosted_rules.FEATURES)))
    y = ((x[:, 0] - x[:, 2] + 0.3 * rng.standard_normal(800)) > 0).astype(int)
    trees = boosted_rules.grow(x, y, trees=30)
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.85
    for f, sign in enumerate(boosted_rules.FEATURES.values()):
        if sign:
            line = np.repeat(x[:20], 50, axis=0)
            line[:, f] = np.tile(np.linspace(-0.1, 1.1, 50), 20)
            steps = np.diff(trees.score(line).reshape(20, 50), axis=1)
            assert (sign * steps >= -1e-12).all()

    def walk(tree, row):
        k = tree
        while trees.left[k] != k:
            k = trees.left[k] if row[trees.feature[k]] <= trees.threshold[k] else trees.right[k]
        return trees.value[k]

    for row in x[:20]:
        assert trees.score(row[None])[0] == pytest.approx(1 / (1 + math.exp(-sum(walk(r, row) for r in trees.roots))))


def test_own_columns_of_an_input_stay(spark, many, tmp_path):
    """Columns called like an operator's own come back as they were; keys may be texts; repeated rows get the same."""
    names = ["_named", "_coded", "_stats", "_v", "_v2", "_label", "_uid", "_links", "_component", "_root", "_n", "features"]
    extra = ", ".join(f"{n} int" for n in names)
    docs, labels = many
    df = spark.createDataFrame([(f"k{k // 2}", t, *range(len(names))) for k, t in enumerate(["the house of the town " * 4, "the house of the town " * 4, None, ""])], f"doc_id string, text string, {extra}")
    path = tokenizer_path()
    outs = [
        language_id.identify(df, language_id.fresh(["a"], 4, 1)),
        bpe.round_trip(df, path),
        boosted_rules.judge(df, boosted_rules.trained(docs, labels)),
        lattice.near_vectors(df.withColumn("embedding", F.array(F.lit(1.0), F.length("doc_id") * 1.0)).withColumn("label", F.lit(3)), "doc_id"),
    ]
    for out in outs:
        got = out.collect()
        assert len(got) == 4 and all([r[n] for n in names] == list(range(len(names))) for r in got)
        assert len({str(r.asDict()) for r in got if r["text"]}) == 1
    assert {r["component_id"] for r in outs[-1].collect()} == {"k0"}


def test_shared_folder(spark):
    from ledgerleaf.llm import common

    n = len(common.written(spark))
    df = common.stored(spark.range(3))
    assert len(common.written(spark)) == n + 1 and df.count() == 3
    common.forget(df)
    assert len(common.written(spark)) == n


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from ledgerleaf.llm import common

    nothing = SimpleNamespace(isDefined=lambda: False)
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://https://host"):
        context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: nothing)))
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: ""), sparkContext=context))
