"""String, number and map functions. Every one is built of Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that trimming removes.
SPACE = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Field names by which a field counts as required.
REQUIRED_WORDS, REQUIRED_MARK = ("required", "must"), "*"
#: The texts that check a box.
TRUE_TEXTS = ("true", "yes", "1")


def trimmed(c: Column) -> Column:
    """Without white space at either end, Unicode's and the byte order mark included."""
    return F.btrim(c, F.lit(SPACE))


def is_blank(c: Column) -> Column:
    return F.coalesce(F.length(F.ltrim(c, F.lit(SPACE))) == 0, F.lit(True))


def parts(c: Column, separator: str) -> Column:
    """All parts between separators, empty ones at the end too."""
    return F.split(c, f"\\Q{separator}\\E", -1)


def without_first(c: Column, text: str) -> Column:
    """Without the first occurrence of text."""
    at = F.instr(c, text)
    return F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + len(text), F.length(c)))).otherwise(c)


def fixed2(c: Column) -> Column:
    """Two decimals, ties away from zero."""
    return F.format_string("%.2f", c.cast("double"))


def size_kb(n_bytes: Column) -> Column:
    return fixed2(n_bytes / F.lit(1024.0))


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def base64_line(c: Column) -> Column:
    """Base64 in one line."""
    return F.regexp_replace(F.base64(c), "[\\r\\n]", "")


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def yes_no(c: Column) -> Column:
    return F.when(c, "yes").otherwise("no")


def quoted_cell(c: Column) -> Column:
    """A cell between quotes; quotes inside stay as they are."""
    return F.concat(F.lit('"'), c, F.lit('"'))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+\\z", ""), "/"), -1)


def has_suffix(name: Column, suffix: str, *, any_case: bool) -> Column:
    return F.lower(name).endswith(suffix.lower()) if any_case else name.endswith(suffix)


def is_required(name: Column) -> Column:
    found = name.contains(REQUIRED_MARK)
    for word in REQUIRED_WORDS:
        found = found | F.lower(name).contains(word)
    return found


def checks(value: Column, kind: Column) -> Column:
    """Whether a value checks a box: the boolean true, or one of three texts exactly. The number 1 does not."""
    return F.coalesce(((kind == "boolean") & (value == "true")) | ((kind == "string") & value.isin(*TRUE_TEXTS)), F.lit(False))


def as_text(value: Column, kind: Column) -> Column:
    """What a value of any kind looks like as text; a JSON null is the text null."""
    return F.when(kind == "null", "null").otherwise(value)


def raster_scale(kb: Column) -> Column:
    """min(1.5, sqrt(375 / kb)) of the rounded size; a size of zero gives 1.5."""
    return F.least(F.lit(1.5), F.sqrt(F.try_divide(F.lit(375.0), kb.cast("double"))))


def merged(base: Column, over: Column) -> Column:
    """Two maps as one: over's values win, base's keys keep their places, over's new keys follow."""
    kept = F.transform(F.map_entries(base), lambda e: F.struct(e.key.alias("key"), F.when(F.map_contains_key(over, e.key), F.element_at(over, e.key)).otherwise(e.value).alias("value")))
    new = F.filter(F.map_entries(over), lambda e: ~F.map_contains_key(base, e.key))
    return F.map_from_entries(F.concat(kept, new))


#: The texts that are whole numbers, as keys of objects.
WHOLE = "^(0|[1-9][0-9]{0,8}|[1-3][0-9]{9}|4[01][0-9]{8})$"


def in_key_order(entries: Column) -> Column:
    """Entries (key, value) in the order in which objects list them: whole numbers first, ascending, then the rest as they came."""
    number = lambda e: e.key.rlike(WHOLE)
    first = F.array_sort(F.filter(entries, number), lambda a, b: F.when(a.key.cast("long") < b.key.cast("long"), -1).when(a.key.cast("long") > b.key.cast("long"), 1).otherwise(0))
    return F.concat(first, F.filter(entries, lambda e: ~number(e)))


def indented(entries: Column) -> Column:
    """The JSON of an object on lines of its own, two spaces before each key. entries: key, and json, the text of a value that is no object or list."""
    lines = F.transform(entries, lambda e: F.concat(F.lit("  "), json_string(e["key"]), F.lit(": "), e["json"]))
    return F.when(F.size(entries) > 0, F.concat(F.lit("{\n"), F.array_join(lines, ",\n"), F.lit("\n}"))).otherwise("{}")


def json_string(c: Column) -> Column:
    """A text as JSON; null is null."""
    return F.when(c.isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', 1))


def utf16_order(names: list[str]) -> list[str]:
    """Names in the order of their UTF-16 code units."""
    return sorted(names, key=lambda s: s.encode("utf-16-be", "surrogatepass"))
