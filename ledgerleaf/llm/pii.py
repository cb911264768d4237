"""Keyed surrogates for personal data.

Each detected entity is replaced by one of its own type and format, drawn by a secret key from its normal form, so the same person,
number or address gets the same surrogate everywhere (coreference), however it is written. Numbers go through a keyed permutation
of all numbers of their length. A name once found by a title or a known given name is replaced wherever it stands in the same text.
A given name is one entity whatever its mentions tell of its gender, which is settled over the whole table; a Slavic surname is one in both genders.
The entities of the whole table are then checked: where a surrogate is also some entity's surrogate, or is itself an entity of the
table, the loser draws again until all are distinct. Draws that fail get longer; of numbers so many that they crowd their space, the first draw stays, as a
permutation draws no two alike.

Names are found in Latin, Greek and Cyrillic script; numbers and addresses in any.
"""

from __future__ import annotations

import hmac
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, quoted, small_batches, stored, unused, without

# Given names by script and gender; surnames are composed. Any list of common names will do.
GIVEN = {
    ("latin", "f"): "Alice Bella Carla Diana Elena Flora Greta Hanna Irene Julia Karin Laura Marta Nadia Olivia Paula Rosa Sofia Teresa Vera".split(),
    ("latin", "m"): "Adam Bruno Carlos David Edgar Felix Georg Henri Ivan Jonas Karl Lucas Marco Nils Oscar Pablo Robert Simon Thomas Victor".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Мария Нина Ольга Татьяна".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Дмитрий Иван Максим Олег Павел Сергей Юрий".split(),
    ("greek", "f"): "Άννα Ελένη Μαρία Σοφία Κατερίνα Ειρήνη".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Πέτρος Δημήτρης Ανδρέας".split(),
}
KNOWN = {n.lower(): k for k, names in GIVEN.items() for n in names} | {
    n.lower(): ("latin", g)
    for g, names in (("f", "Mary Anna Emma Emily Sarah Linda Susan Lisa Karen Maria Claire Sophie Camille Lucía Carmen Isabel Sabine Ursula Monika Heidi Jane"), ("m", "John James Michael William Richard Peter Paul Jean Pierre Luis José Juan Miguel Hans Klaus Jürgen Wolfgang Stefan Frank Daniel"))
    for n in names.split()
}
TITLES = {"Mr": "m", "Mister": "m", "Herr": "m", "Señor": "m", "Monsieur": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Señora": "f", "Señorita": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Dr": "", "Prof": "", "Professor": "", "Г-н": "m", "Г-жа": "f"}
TITLES |= {t.upper(): g for t, g in TITLES.items()}
SYLLABLES = {
    "latin": ["ba", "den", "for", "gar", "hol", "kin", "lan", "mer", "nor", "pel", "ros", "sel", "tor", "ven", "wick", "zan"],
    "cyrillic": ["ба", "вол", "гор", "ден", "кар", "лен", "мир", "нов", "пет", "ром", "сел", "тар"],
    "greek": ["βα", "γε", "δο", "κα", "λε", "μι", "νο", "πα", "ρι", "σε", "τα", "φω"],
}
ENDS = {("latin", "f"): "a", ("latin", "m"): "o", ("cyrillic", "f"): "а", ("cyrillic", "m"): "ий", ("greek", "f"): "α", ("greek", "m"): "ος"}

EMAIL = re.compile(r"[^\W_][\w.+\-]*@(?:[^\W_](?:[\w\-]*[^\W_])?\.)+[^\W\d_]{2,}")
SECRET = re.compile(
    r"(?i:\b(?:api[_\- ]?key|access[_\- ]?key|auth[_\- ]?token|token|secret|passwd|password)\b[\"']?\s*[=:]\s*[\"']?)([A-Za-z0-9_\-/+=.]{8,})"
    r"|\b(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_\-]{20,}|xox[abpr]-[A-Za-z0-9\-]{10,}|eyJ[\w\-]{10,}\.[\w\-]{10,}\.[\w\-]{5,})"
)
SECRET_HINT = re.compile(r"[=:]|AKIA|gh[pousr]_|sk-|xox[abpr]-|eyJ")
IPV4 = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d|[^\W\d])")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
SSN = re.compile(r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])")
CARD = re.compile(r"(?<![\w.\-])\d(?:[ \-]?\d){12,18}(?![\w\-])")
#: Cards grouped as cards are, or not at all.
GROUPED_CARD = re.compile(r"(?<![\w.\-+])(?:\d{4}([ \-])\d{4}\1\d{4}\1\d{4}(?:\1\d{1,3})?|\d{4}([ \-])\d{6}\2\d{5}|\d{13,19})(?![\w\-])")
#: After + or 00 and a country code, groups of any usual length; numbers of 1, 7, 33 and 34 have one length.
PHONE_ABROAD = re.compile(
    r"(?:(?<![\d+])\+(?:[17](?:[ .\-]?\(\d{3}\)|(?:[ .\-]?\d){3})(?:[ .\-]?\d){7}|3[34](?:[ .\-]?\(0\))?(?:[ .\-]?\d){9})(?![\w\-])"
    r"|(?:(?<![\d+])\+\d{1,3}[ .\-]?|(?<![\w.\-+])00\d{1,3}[ .\-])(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-/]?\d{2,4}){1,5})(?![\w\-])"
)
#: Without: the forms of North America, with or without a leading 1, pairs after 0 (French), area codes with 0 (German), nine digits without one
#: (Spanish) and ten after 8 (Russian). Numbers of groups of three are told apart by what stands before and after.
PHONE = re.compile(
    r"(?<![\w.\-+])(?:(?:1[ .\-])?(?:\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})|0\d([ .\-]?)\d{2}(?:\1\d{2}){3}|\(0\d{1,4}\) ?\d{3,4}(?:[ \-]?\d{2,4}){1,2}"
    r"|0\d{2,4}[ /\-]\d{3,4}(?:[ \-]?\d{2,4}){1,2}|0\d{2,4}(?: \d{2}){3,4}"
    r"|(?<!\d )(?:(?:1 )?[2-9]\d{2} \d{3}[ \-]\d{4}|[6-9]\d{2} \d{3} \d{3}|[6-9]\d{2}(?: \d{2}){3}|9\d \d{3} \d{2} \d{2}|8[ \-](?:\(\d{3}\)|\d{3})[ \-]\d{3}[ \-]\d{2}[ \-]\d{2})(?! \d))"
    r"(?![\w\-])"
)
DIGITS = re.compile(r"\d\d")
IPV4_HINT = re.compile(r"\d\.\d")
#: Capital letters of the scripts that names are found in.
_UP = "".join(chr(c) for c in range(0x41, 0x530) if chr(c).isupper())
_CAP = rf"[{_UP}]\w+(?:['’\-]\w+)*"
#: Small words within names, which stay.
PARTICLES = {"von", "van", "der", "den", "zu", "zum", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "bin", "ibn", "al", "el", "y"}
_PARTICLE = "|".join(sorted(PARTICLES, key=len, reverse=True))
#: Capitalised words and initials, with small words only between them. These start with a letter, not with a boundary, so that the
#: search skips to capitals; detect() looks at what stands before.
_WORD = rf"(?:{_CAP}|[{_UP}]\.)"
_TITLE, _RUN = "|".join(sorted(TITLES, key=len, reverse=True)), rf"{_WORD}(?:(?: (?:{_PARTICLE})){{0,3}} {_WORD})*"
TITLED = re.compile(rf"((?:(?:{_TITLE})\.? )+)({_RUN})")
_SPELLED = sorted({n for names in GIVEN.values() for n in names} | {w.title() for w in KNOWN}, key=len, reverse=True)
NAMED = re.compile(rf"((?:{'|'.join([*_SPELLED, *(n.upper() for n in _SPELLED)])})(?!\w)(?:(?: (?:{_PARTICLE})){{0,3}} {_WORD})+)")
CAPITALISED = re.compile(_CAP)


def digits_of(surface: str) -> str:
    return "".join(str(unicodedata.decimal(c)) for c in surface if c.isdecimal())


def script_of(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


#: Endings of Slavic surnames in Cyrillic; women's have one letter more.
SLAVIC, FEMALE = ("ов", "ев", "ёв", "ин", "ын"), "а"


def is_female(surname: str) -> bool:
    """Whether a surname is a woman's form of a Slavic one."""
    return len(surname) > 4 and surname.lower().endswith(tuple(x + FEMALE for x in SLAVIC))


def normal(kind: str, surface: str) -> str:
    """What two ways of writing one entity have in common."""
    if kind == "surname":
        form = unicodedata.normalize("NFC", surface).lower()
        return form[:-1] if is_female(form) else form
    if kind == "email" or kind.startswith("given"):
        return unicodedata.normalize("NFC", surface).lower()
    if kind == "phone":
        d = digits_of(surface)
        return d[-10:] if len(d) >= 10 else d
    if kind in ("card", "ssn"):
        return digits_of(surface)
    if kind == "iban":
        return surface.replace(" ", "")
    if kind == "ip":
        return ".".join(str(int(x)) for x in surface.split("."))
    return surface


def gender_of(name: str) -> str:
    """f, m or '' of a given name: as listed, else by its ending where a script's names have one."""
    name = name.lower()
    if name in KNOWN:
        return KNOWN[name][1]
    script = script_of(name)
    if script == "cyrillic":
        return "f" if name[-1] in "ая" else "m"
    if script == "greek":
        return "m" if name[-1] in "ςσ" else "f" if name[-1] in "αάηή" else ""
    return "f" if name[-1] == "a" else ""


def is_phone(surface: str) -> bool:
    return 7 <= len(digits_of(surface)) <= 15


def is_card(surface: str) -> bool:
    """Whether the check digit holds; 15 digits and more in one piece are no phone number anyway."""
    d = digits_of(surface)
    return len(surface) == len(d) >= 15 or luhn(d[:-1]) == int(d[-1])


def is_iban(surface: str) -> bool:
    form = normal("iban", surface)
    return int(form[2:4]) == iban_check(form[:2], form[4:])


#: Numbers in the order in which they are looked for; those whose check digits hold go before others of their kind, which may be more than one.
NUMBERS: list[tuple[str, re.Pattern, Callable[[str], bool] | None]] = [
    ("iban", IBAN, is_iban), ("iban", IBAN, None), ("ip", IPV4, None), ("ssn", SSN, None), ("card", GROUPED_CARD, is_card),
    ("phone", PHONE_ABROAD, is_phone), ("phone", PHONE, is_phone), ("card", CARD, None),
]
SEPARATORS = " .-/"


def apart(pattern: re.Pattern, text: str, fits: Callable[[str], bool] | None) -> Iterator[tuple[int, int]]:
    """Spans of a pattern that fit. Of one that doesn't, as where numbers follow each other, the longest beginning that does counts, up to a
    separator; if there is none the search goes on within it."""
    at = 0
    while m := pattern.search(text, at):
        start, at = m.start(), m.start() + 1
        while m:
            end = m.end()
            if fits is None or fits(m[0]):
                yield start, end
                at = end
                break
            cut = max(text.rfind(c, start, end) for c in SEPARATORS)
            while cut > start and text[cut - 1] in SEPARATORS:
                cut -= 1
            m = pattern.match(text, start, cut) if cut > start else None


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of each entity, in order and not overlapping; where two overlap the kind named first below wins.

    Names come last: after a title or a known given name, and then every other capitalised mention of a name so found. Time goes with
    the text's length.
    """
    if not text:
        return []
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray()

    def add(start: int, end: int, kind: str) -> None:
        if not taken:
            taken.extend(bytes(len(text)))
        if taken.find(1, start, end) < 0:
            taken[start:end] = b"\1" * (end - start)
            found.append((start, end, kind, normal(kind, text[start:end])))

    def rest() -> str:
        """The text without what was found, so that numbers beside it end there."""
        out, at = [], 0
        for start, end, *_ in sorted(found):
            out += [text[at:start], "\0" * (end - start)]
            at = end
        return "".join([*out, text[at:]]) if found else text

    for m in SECRET.finditer(text) if any(x in text for x in ("=", ":", "AKIA", "gh", "sk-", "xox", "eyJ")) and SECRET_HINT.search(text) else ():
        k = 1 if m[1] else 2
        add(m.start(k), m.end(k), "secret")
    if "@" in text:
        for m in EMAIL.finditer(text):
            add(m.start(), m.end(), "email")
    if DIGITS.search(text) or IPV4_HINT.search(text):
        for kind, pattern, fits in NUMBERS:
            for start, end in apart(pattern, rest(), fits):
                add(start, end, kind)
    whole = lambda m: not m.start() or not (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_")
    names: dict[str, str] = {}

    def bare(word: str) -> str:
        """Without a possessive ending."""
        return word[:-2] if len(word) > 3 and word[-2:] in ("'s", "’s", "'S", "’S") else word

    def name(start: int, run: str, gender: str | None) -> None:
        """The last word is the surname, those before it are given names; without a title only the known ones are taken for such."""
        words, last = run.split(" "), 0
        for k, w in enumerate(words):
            if w not in PARTICLES and not w.endswith("."):
                last = k
        for k, w in enumerate(words):
            if w not in PARTICLES and not w.endswith("."):
                part = bare(w)
                given = k < last and (gender is not None or part.lower() in KNOWN)
                kind = f"given_{gender or gender_of(part)}" if given else "surname"
                form = normal(kind, part)
                if given and kind == "given_" and names.get(form, "").startswith("given"):
                    kind = names[form]
                add(start, start + len(part), kind)
                if names.get(form, "given_") == "given_":
                    names[form] = kind
            start += len(w) + 1

    for m in filter(whole, TITLED.finditer(text)):
        name(m.start(2), m[2], next((g for t in m[1].replace(".", "").split() if (g := TITLES[t])), ""))
    for m in filter(whole, NAMED.finditer(text)):
        name(m.start(1), m[1], None)
    if names:
        # one person's given name is one entity, also where only one mention tells the gender
        found[:] = [(a, b, names[f] if k == "given_" and names.get(f, "").startswith("given") else k, f) for a, b, k, f in found]
        for m in CAPITALISED.finditer(text):
            part = bare(m[0])
            kind = names.get(normal("given", part)) or names.get(normal("surname", part))
            if kind and whole(m):
                add(m.start(), m.start() + len(part), kind)
    found.sort()
    return found


class Draw:
    """A stream of numbers that a key and a text determine."""

    def __init__(self, key: bytes, *what: object):
        self.seed, self.n, self.left = hmac.digest(key, "\0".join(map(str, what)).encode("utf-8", "surrogatepass"), "sha256"), 0, 0
        self.key = key

    def below(self, n: int) -> int:
        self.n += 1
        return int.from_bytes(hmac.digest(self.key, self.seed + self.n.to_bytes(4, "big"), "sha256")[:16], "big") % n


def permuted(key: bytes, tweak: str, value: int, size_a: int, size_b: int) -> int:
    """A keyed permutation of range(size_a * size_b): eight Feistel rounds of modular addition."""
    a, b = divmod(value, size_b)
    for r in range(8):
        if r % 2:
            b = (b + Draw(key, tweak, r, a).below(size_b)) % size_b
        else:
            a = (a + Draw(key, tweak, r, b).below(size_a)) % size_a
    return a * size_b + b


def permuted_digits(key: bytes, tweak: str, digits: str) -> str:
    n = len(digits)
    if not n:
        return digits
    half = n // 2
    return str(permuted(key, f"{tweak}/{n}", int(digits), 10**half, 10 ** (n - half))).zfill(n)


def luhn(digits: str) -> int:
    """The check digit that digits call for."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_check(country: str, body: str) -> int:
    """The check number, 2 to 98, that a country and an account call for."""
    return 98 - int("".join(str(int(c, 36)) for c in body + country) + "00") % 97


@lru_cache(maxsize=4096)
def letters_near(c: str) -> str:
    """Letters of c's script and case: the plain alphabet of Latin, Cyrillic and Greek, else those of its kind in its block of 128 characters."""
    kind, script = unicodedata.category(c), unicodedata.name(c, "").split(" ")[0]
    pool = {"LATIN": "abcdefghijklmnopqrstuvwxyz", "CYRILLIC": "абвгдежзиклмнопрстуфхцчшя", "GREEK": "αβγδεζηθικλμνξοπρστυφχψω"}.get(script)
    if pool:
        return pool.upper() if c.isupper() else pool
    block = map(chr, range(ord(c) & ~127, (ord(c) | 127) + 1))
    return "".join(x for x in block if unicodedata.category(x) == kind and unicodedata.name(x, "").split(" ")[0] == script) or c


def letters_like(draw: Draw, text: str) -> str:
    """Each letter becomes one of its case and script, each digit a digit of its script, the rest stays."""
    out = []
    for c in text:
        if c.isdecimal():
            out.append(chr(ord(c) - unicodedata.decimal(c) + draw.below(10)))
        elif c.isalpha():
            pool = letters_near(c)
            out.append(pool[draw.below(len(pool))])
        else:
            out.append(c)
    return "".join(out)


def surrogate(kind: str, form: str, attempt: int, key: bytes) -> str:
    """The normal form of an entity's replacement."""
    tweak = f"{kind}/{attempt}"
    draw = Draw(key, tweak, form)
    if kind in ("phone", "ssn"):
        return permuted_digits(key, tweak, form)
    if kind == "card":  # a valid check digit stays valid, an invalid one stays as wrong as it was
        body = permuted_digits(key, tweak, form[:-1])
        return body + str((luhn(body) + int(form[-1]) - luhn(form[:-1])) % 10)
    if kind == "ip":
        x = int.from_bytes(bytes(map(int, form.split("."))), "big")
        usable = lambda v: 0 < v >> 24 < 224 and v >> 24 != 127
        y = permuted(key, tweak, x, 1 << 16, 1 << 16)
        while usable(x) and not usable(y):  # walks the cycle, so still a permutation of usable addresses
            y = permuted(key, tweak, y, 1 << 16, 1 << 16)
        return ".".join(map(str, y.to_bytes(4, "big")))
    if kind == "email":
        local, _, domain = form.rpartition("@")
        labels = domain.split(".")
        local += "a" * max(0, attempt - LONGER)  # draws that fail get longer
        return letters_like(draw, local) + "@" + ".".join([*(letters_like(Draw(key, "label", x, attempt), x) for x in labels[:-1]), labels[-1]])
    if kind == "iban":  # valid check digits stay valid, others stay as wrong as they were
        body = letters_like(draw, form[4:])
        off = (int(form[2:4]) - iban_check(form[:2], form[4:])) % 97
        return f"{form[:2]}{(iban_check(form[:2], body) - 2 + off) % 97 + 2:02d}{body}"
    if kind == "secret":
        if re.fullmatch(r"[0-9a-f]+", form):
            return "".join("0123456789abcdef"[draw.below(16)] for _ in range(len(form) + max(0, attempt - LONGER)))
        head = re.match(r"AKIA|gh[pousr]_|sk-|xox[abpr]-|", form)[0]
        return head + letters_like(draw, form[len(head) :] + "a" * max(0, attempt - LONGER))
    if "-" in form:  # a name of two parts gets one of two parts
        return "-".join(named(kind, part, attempt, Draw(key, tweak, form, i)) for i, part in enumerate(form.split("-")) if part)
    return named(kind, form, attempt, draw)


def named(kind: str, form: str, attempt: int, draw: Draw) -> str:
    """A name in small letters, of the form's script, and of the kind's gender if that is a given name."""
    script = script_of(form)
    if kind.startswith("given"):
        gender = kind[-1] if kind[-1] in "fm" else "fm"[draw.below(2)]
        pool = GIVEN[script, gender]
        if attempt < 4:
            return pool[draw.below(len(pool))].lower()
        return "".join(SYLLABLES[script][draw.below(len(SYLLABLES[script]))] for _ in range(2 + attempt // 8)) + ENDS[script, gender]
    end = SLAVIC[draw.below(2)] if script == "cyrillic" and form.endswith(SLAVIC) else ""  # which a woman's form can be made of
    return "".join(SYLLABLES[script][draw.below(len(SYLLABLES[script]))] for _ in range(2 + draw.below(2) + attempt // 4)) + end


def rendered(kind: str, surface: str, core: str) -> str:
    """A replacement written as the entity was: its separators, prefix, digits and case."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(core[::-1])
        return "".join([chr(ord(c) - unicodedata.decimal(c) + int(next(digits, str(unicodedata.decimal(c))))) if c.isdecimal() else c for c in reversed(surface)])[::-1]
    if kind == "iban":
        chars = iter(core)
        return "".join(c if c == " " else next(chars) for c in surface)
    if kind == "email":
        return "".join(x.upper() if c.isupper() else x for c, x in zip(surface, core, strict=True)) if len(core) == len(surface) else core
    if kind == "surname" or kind.startswith("given"):
        if kind == "surname" and is_female(surface) and core.endswith(SLAVIC):
            core += FEMALE
        return core.upper() if surface.isupper() and len(surface) > 1 else "-".join(x[:1].upper() + x[1:] for x in core.split("-")) if surface[:1].isupper() else core
    return core


def written(text: str, spans: list[tuple[int, int, str, str]], settled: dict[tuple[str, str], tuple[str, int]], key: bytes) -> str:
    """The text with the surrogates of detect()'s spans. settled: the kind and the attempt of entities that keep neither their mention's kind nor the first draw."""
    draw = _cached(key)
    out, at = [], 0
    for start, end, kind, form in spans:
        known, attempt = settled.get((kind, form), (kind, 0))
        out += [text[at:start], rendered(known, text[start:end], draw(known, form, attempt))]
        at = end
    return "".join([*out, text[at:]])


def replaced(text: str | None, settled: dict[tuple[str, str], tuple[str, int]], key: bytes) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with surrogates, and (start, end, kind) of each in the original."""
    spans = detect(text)
    return written(text, spans, settled, key) if spans else text, [(a, b, k) for a, b, k, _ in spans]


@lru_cache(maxsize=4)
def _cached(key: bytes):
    return lru_cache(maxsize=1 << 15)(lambda kind, form, attempt: surrogate(kind, form, attempt, key))


SPANS = "array<struct<start:int,end:int,kind:string>>"
#: Failed draws after which draws get longer; the share of a number format's space that entities may hold and still all be avoided; rounds of drawing.
LONGER, CROWDED, ROUNDS = 2, 0.25, 200
_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("form", pa.string())]))


def detected(text: Column) -> Column:
    """detect() of a column."""

    @F.arrow_udf("array<struct<start:int,end:int,kind:string,form:string>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[dict(zip(("start", "end", "kind", "form"), x, strict=True)) for x in detect(t.as_py())] for t in batch], _FOUND)

    return found(text)


def redrawn(known: DataFrame, key: bytes) -> DataFrame | None:
    """(kind, form, attempt) of the entities whose first surrogate was another's, or an entity itself; None if there are none.

    Rounds go on until all are settled. Who is settled stays so: each round joins those still to settle with the others, and only they draw again.
    A draw fails with a chance of CROWDED at most: formats of numbers of which the table holds more of their space are settled with the first draw,
    which is a permutation, though it may be another entity of the table, and other formats get longer as draws fail. So rounds grow as the logarithm
    of the entities, and ROUNDS is never reached but by a fault.
    """

    @F.arrow_udf("string")
    def core(kinds: pa.Array, forms: pa.Array, attempts: pa.Array) -> pa.Array:
        return pa.array([surrogate(k.as_py(), f.as_py(), a.as_py(), key) for k, f, a in zip(kinds, forms, attempts, strict=True)], pa.string())

    family = F.regexp_replace("kind", "_.*", "")  # given names are distinct whatever their gender
    # card numbers without their check digits, and a format for each length, so that the space is what a draw may give
    long = F.when(F.col("kind") == "ip", F.lit(0)).otherwise(F.length("form") - (F.col("kind") == "card").cast("int"))
    sizes = known.where(F.col("kind").isin("phone", "ssn", "card", "ip")).groupBy("kind", long.alias("_long")).agg(F.count(F.lit(1)).alias("n"))
    space = F.when(F.col("kind") == "ip", F.lit(2.0**32)).otherwise(F.pow(F.lit(10.0), F.col("_long")))
    crowded = sizes.where(F.col("n") > CROWDED * space).select("kind", "_long", F.lit(True).alias("full"))
    first = known.withColumn("_long", long).join(crowded, ["kind", "_long"], "left").select("kind", "form", F.coalesce("full", F.lit(False)).alias("full"))
    first = first.withColumn("attempt", F.lit(0)).withColumn("core", core("kind", "form", "attempt")).withColumn("family", family)
    first = stored(first)
    taken = first.select("family", F.col("form").alias("core")).distinct()

    def settled(drawn: DataFrame, before: DataFrame | None) -> DataFrame:
        """drawn with column ok: whether an entity may keep what it drew."""
        own = drawn.groupBy("family", "core").agg(F.min(F.struct("kind", "form")).alias("_first"))
        out = drawn.join(own, ["family", "core"]).withColumn("ok", (F.col("kind") == F.col("_first.kind")) & (F.col("form") == F.col("_first.form"))).drop("_first")
        gone = taken if before is None else taken.unionByName(before.where("ok").select("family", "core"))
        gone = drawn.select("family", "core").distinct().join(gone, ["family", "core"], "left_semi").withColumn("_gone", F.lit(True))
        return out.join(gone, ["family", "core"], "left").withColumn("ok", F.col("full") | F.col("ok") & F.col("_gone").isNull()).drop("_gone")

    rounds = [stored(settled(first, None))]
    while not (losers := rounds[-1].where("not ok")).isEmpty():
        if len(rounds) > ROUNDS:
            raise RuntimeError(f"entities are not distinct after {ROUNDS} draws")
        again = losers.drop("core", "ok").withColumn("attempt", F.col("attempt") + 1).withColumn("core", core("kind", "form", "attempt"))
        before = rounds[0]
        for x in rounds[1:]:
            before = before.unionByName(x)
        rounds.append(stored(settled(again, before)))
    forget(first)
    if len(rounds) == 1:
        forget(rounds[0])
        return None
    out = rounds[1].where("ok")
    for x in rounds[2:]:
        out = out.unionByName(x.where("ok"))
    out = stored(out.select("kind", "form", "attempt"))
    forget(*rounds)
    return out


def genders(known: DataFrame) -> DataFrame:
    """known: kind, form, n of given names. kind, form and what: the kind that all mentions of the name have, that of most of them, f where m is as frequent."""
    n = lambda g: F.sum(F.when(F.col("kind") == f"given_{g}", F.col("n")).otherwise(0))
    of = known.groupBy("form").agg(n("f").alias("f"), n("m").alias("m"))
    what = F.when(F.col("f") + F.col("m") == 0, "given_").when(F.col("f") >= F.col("m"), "given_f").otherwise("given_m")
    return known.select("kind", "form").join(of.select("form", what.alias("what")), "form")


def settle(known: DataFrame, key: bytes) -> DataFrame | None:
    """kind and form of mentions, and what and attempt, their entity's kind and draw, where these aren't the mention's own kind and 0; None if there are none."""
    given = F.col("kind").startswith("given")
    what = stored(genders(known.where(given)).unionByName(known.where(~given).select("form", "kind", F.col("kind").alias("what"))))
    again = redrawn(what.select(F.col("what").alias("kind"), "form").distinct(), key)
    if again is None:
        out = what.where("kind <> what").withColumn("attempt", F.lit(0))
    else:
        out = what.join(again.withColumnRenamed("kind", "what"), ["what", "form"], "left").where("kind <> what or attempt is not null").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
    out = stored(out.select("kind", "form", "what", "attempt"))
    forget(what)
    if again is not None:
        forget(again)
    if out.isEmpty():
        forget(out)
        return None
    return out


def pseudonymise(df: DataFrame, key: bytes, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """df with its texts' entities replaced, and an array of (start, end, kind) of what was replaced in the original text.

    Null texts stay null and have an empty array, like texts without entities, which stay as they are. Rows repeated get the same text.
    Where entities overlap the kind that detect() names first counts. Very long texts are read whole, in time that goes with their length. An empty
    table gives an empty one. A column called like spans gives way; others stay. Entities are distinct and coreferent within this
    table and key. Texts are searched once: what was found is stored along with them.
    """
    small_batches(df.sparkSession)
    base = without(df, spans)
    uid, hits, again_, new = unused(base, "_uid", "_hits", "_again", "_new")
    held = stored(base.withColumns({uid: F.monotonically_increasing_id(), hits: detected(quoted(text).cast("string"))}))
    each = held.where(F.size(hits) > 0).select(uid, F.explode(F.array_distinct(F.transform(hits, lambda x: F.struct(x.kind.alias("kind"), x.form.alias("form"))))).alias("e")).select(uid, "e.*")
    known = stored(each.groupBy("kind", "form").agg(F.count(F.lit(1)).alias("n")))
    again = settle(known, key)
    forget(known)
    if again is None:
        held = held.withColumn(again_, F.lit(None).cast("array<struct<kind:string,form:string,what:string,attempt:int>>"))
    else:
        drawn = each.join(again, ["kind", "form"]).groupBy(uid).agg(F.collect_list(F.struct("kind", "form", "what", "attempt")).alias(again_))
        held = held.join(drawn, uid, "left")

    @F.arrow_udf("string")
    def changed(texts: pa.Array, hits: pa.Array, again: pa.Array) -> pa.Array:
        out = []
        for t, h, a in zip(texts, hits, again, strict=True):
            found = [(x["start"], x["end"], x["kind"], x["form"]) for x in h.as_py() or ()]
            out.append(written(t.as_py(), found, {(x["kind"], x["form"]): (x["what"], x["attempt"]) for x in a.as_py() or ()}, key) if found else t.as_py())
        return pa.array(out, pa.string())

    out = held.withColumn(new, changed(quoted(text).cast("string"), F.col(hits), F.col(again_)))
    columns = [F.col(new).alias(c) if c.lower() == text.lower() else quoted(c) for c in base.columns]
    return out.select(*columns, F.transform(hits, lambda x: F.struct(x.start.alias("start"), x.end.alias("end"), x.kind.alias("kind"))).alias(spans))
