"""Column functions on texts, spans and n-grams; all run in the JVM unless said otherwise."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes in capitals with a digit, e-mail addresses, bracketed phone numbers, dashed or dotted groups of digits.
IDENTIFIER = r"\b[A-Z]{2,}[A-Z0-9-]*[0-9][A-Z0-9-]*\b|\b[A-Za-z0-9][A-Za-z0-9_.+-]*@[A-Za-z0-9_.-]+\b|\([0-9]{3}\) [0-9]{3}-[0-9]{4}|\b[0-9]{1,4}(?:[-.][0-9]{1,4}){2,}\b"
#: Parts of a skeleton: words of plain letters, placeholders, digit marks.
SKELETON_TOKEN = r"[a-z]+|<[^>]+>|#"
#: The same without digit marks.
MARKER_TOKEN = r"[a-z]+|<[^>]+>"
WORD_OR_SIGN = r"\w+|[^\w\s]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for a row, even where the body uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeezed(text: str | Column) -> Column:
    """White space collapsed to one space, none at the ends."""
    return F.trim(F.regexp_replace(col(text), r"(?U)\s+", " "))


#: Characters that folding changes further than lower-casing does, and what they become.
_FOLDS = {c: c.casefold() for c in map(chr, range(sys.maxunicode + 1)) if c.lower() == c and c.casefold() != c}
_ONE = {k: v for k, v in _FOLDS.items() if len(v) == 1}
#: A class of a few ranges that has all characters that become several, but for the sharp s, which is common.
_SEVERAL = "[\u0149\u01f0\u0390\u03b0\u0587\u1e96-\u1e9f\u1f50-\u1fff\ufb00-\ufb17]"


def casefold(text: str | Column) -> Column:
    """Full case folding, so that equal texts in any case compare equal.

    Plain ASCII texts need no more than lower case; of the others few have a
    character that becomes several, and only those are taken apart.
    """
    table = F.str_to_map(F.lit("\x1e".join(f"{k}\x1f{v}" for k, v in _FOLDS.items())), F.lit("\x1e"), F.lit("\x1f"))

    def folded(low: Column) -> Column:
        apart = F.array_join(F.transform(F.split(low, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
        ones = F.translate(F.replace(low, F.lit("ß"), F.lit("ss")), "".join(_ONE), "".join(_ONE.values()))
        return F.when(F.octet_length(low) == F.length(low), low).when(low.rlike(_SEVERAL), apart).otherwise(ones)

    return let(F.lower(col(text)), folded)


def fingerprint(text: str | Column) -> Column:
    """A body without regard to case and white space."""
    return casefold(squeezed(text))


def matches(text: str | Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of a pattern's matches, in code points.

    The pieces between the matches give the offsets: a match begins behind all
    pieces up to its own and all matches before. Their sums come from one fold
    over numbers; texts without a match, which are most, build nothing.
    """

    def placed(p: Column) -> Column:
        steps = F.zip_with(p["found"], p["gaps"], lambda m, g: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
        ends = F.aggregate(F.slice(steps, F.lit(1), F.size(p["found"])), F.array(F.lit(0)), lambda seen, x: F.concat(seen, F.array(F.element_at(seen, -1) + x["g"] + x["m"])))
        return F.transform(p["found"], lambda m, i: F.struct((F.get(ends, i + 1) - F.length(m)).alias("start"), F.get(ends, i + 1).alias("end"), m.alias("text")))

    found = F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start: int, end: int, text: string>>")
    return let(found, lambda own: F.when(F.size(own) == 0, none).when(F.size(own) > 0, let(F.struct(own.alias("found"), F.split(col(text), pattern, -1).alias("gaps")), placed)))


def whole(value: str | Column, pattern: str) -> Column:
    """Whether the pattern matches all of the value."""
    return col(value).rlike(rf"\A(?:{pattern})\z")


def byte_offset(text: str | Column, place: Column) -> Column:
    """UTF-8 bytes before a code point."""
    return F.octet_length(F.substring(col(text), F.lit(1), place)).cast("int")


def code_point(text: str | Column, byte: Column) -> Column:
    """Code points before a byte; null where the byte is not at a boundary or out of range."""
    raw = col(text).cast("binary")
    head = F.substring(raw, F.lit(1), byte)
    inside = (byte >= 0) & (byte <= F.octet_length(raw)) & F.is_valid_utf8(head.cast("string"))
    return F.when(inside, F.length(head.cast("string")))


def skeleton(text: str | Column, annotations: str | Column, persona: Column | None = None, organization: Column | None = None) -> Column:
    """The text with spans, names and numbers replaced by placeholders, in lower case."""
    source = col(text)
    spans = F.array_sort(F.coalesce(F.transform(col(annotations), lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end"))), F.array().cast("array<struct<start: int, end: int>>")))
    seen = F.aggregate(
        spans,
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda s, a: F.struct(F.concat(s["done"], F.substring(source, s["at"] + 1, F.greatest(a["start"] - s["at"], F.lit(0))), F.lit("<entity>")).alias("done"), a["end"].alias("at")),
    )
    plain = F.concat(seen["done"], F.substring(source, seen["at"] + 1, F.length(source)))
    for name, mark in ((persona, "<persona>"), (organization, "<organization>")):
        if name is not None:
            plain = F.when(F.length(name) > 0, F.replace(plain, name, F.lit(mark))).otherwise(plain)
    return casefold(squeezed(F.regexp_replace(plain, r"(?U)\b\d+\b", "#")))


def ngrams(tokens: Column, width: int) -> Column:
    """Runs of ``width`` neighbours, joined by spaces; an empty array where there are fewer tokens."""

    def runs(own: Column) -> Column:
        n = F.size(own) - width + 1
        return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(own, i, width), " "))).otherwise(F.array().cast("array<string>"))

    return let(tokens, runs)


def shingles(text: str | Column, width: int = 4) -> Column:
    """Hashes of the word n-grams; a shorter text has one for the whole, an empty or null one none.

    Words are hashed once and n-grams from the hashes of their words, so no
    n-gram is put together as a string.
    """

    def hashes(words: Column) -> Column:
        n = F.size(words) - width + 1
        long = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(width))))
        short = F.when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
        return F.array_distinct(F.when(n >= 1, long).otherwise(short))

    words = F.filter(F.split(fingerprint(text), " "), lambda w: w != "")
    return let(F.transform(words, lambda w: F.xxhash64(w)), hashes)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    total = F.size(F.array_union(a, b))
    return F.when(total == 0, F.lit(1.0)).otherwise(both / total)


def char_ngrams(text: str | Column, widths=(3, 4, 5)) -> Column:
    """The character n-grams of a text, in any case, with repeats."""

    def of_width(chars: Column, w: int) -> Column:
        n = F.size(chars) - w + 1
        return F.when(n >= 1, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(chars, i, w), ""))).otherwise(F.array().cast("array<string>"))

    # An array of characters: reaching into a long string would take time in proportion to the place.
    return let(F.filter(F.split(casefold(text), ""), lambda c: c != ""), lambda chars: F.concat(*(of_width(chars, w) for w in widths)))


def char_grams(text: str | Column, widths=(3, 4, 5), buckets: int = 1 << 18) -> Column:
    """Buckets of the character n-grams of a text, with repeats."""
    return F.transform(char_ngrams(text, widths), lambda g: F.crc32(g.cast("binary")).bitwiseAND(F.lit(buckets - 1)).cast("int"))


_SHAPES: dict[str, object] = {}


def register_shape(name: str, matcher, replace: bool = False) -> None:
    """Add a named shape: a pattern that must match a whole value, or a function from Column to Column."""
    if name in _SHAPES and not replace:
        raise ValueError(f"shape {name} exists")
    _SHAPES[name] = matcher


def registered_shapes() -> tuple[str, ...]:
    return tuple(_SHAPES)


def generic_shape(value: str | Column) -> Column:
    """Classes of characters: runs of letters with their length, digits, white space, and the others as they are."""
    mapped = F.regexp_replace(F.regexp_replace(F.regexp_replace(col(value), r"(?U)\p{L}", "A"), r"\p{Nd}", "9"), r"(?U)\s", " ")
    runs, gaps = F.regexp_extract_all(mapped, F.lit("A+"), F.lit(0)), F.split(mapped, "A+", -1)
    each = F.zip_with(gaps, runs, lambda g, r: F.concat(g, F.coalesce(F.concat(F.lit("A"), F.length(r).cast("string")), F.lit(""))))
    return F.concat(F.lit("generic:"), F.array_join(each, ""))


def shape(value: str | Column) -> Column:
    """The first registered shape that a value has, else its generic one."""
    found = None
    for name, matcher in _SHAPES.items():
        has = matcher(col(value)) if callable(matcher) else whole(value, matcher)
        found = F.when(has, F.lit(name)) if found is None else found.when(has, F.lit(name))
    return generic_shape(value) if found is None else found.otherwise(generic_shape(value))


def contains_folded(text: str | Column, part: Column) -> Column:
    """Whether a non-empty part occurs in the text in any case."""
    return F.coalesce((F.length(part) > 0) & casefold(text).contains(casefold(part)), F.lit(False))


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap over union of two half-open spans."""
    both = F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))
    return F.when(both > 0, both / (F.greatest(a_end, b_end) - F.least(a_start, b_start))).otherwise(F.lit(0.0))


def entropy(counts: Column) -> Column:
    """Shannon bits of an array of counts."""
    total = F.aggregate(counts, F.lit(0).cast("double"), lambda s, n: s + n)
    return F.aggregate(counts, F.lit(0.0), lambda s, n: s - F.when(n > 0, n / total * F.log2(n / total)).otherwise(F.lit(0.0)))


for _name, _pattern in {
    "spoken_synthetic": lambda v: F.startswith(casefold(F.trim(v)), F.lit("synthetic ")),
    "synthetic_calendar": r"SYN-DATE-\d{4}-\d{2}-\d{2}",
    "synthetic_alpha_five": r"SYN-ID-[A-Z]\d{5}",
    "synthetic_two_alpha_four": r"SYN-ID-[A-Z]{2}\d{4}",
    "synthetic_segmented": r"SYN-ID-[A-Z]{3}-\d{3}",
    "synthetic_noisy": lambda v: F.startswith(v, F.lit("SYN-ID-")),
}.items():
    register_shape(_name, _pattern)

REALISTIC_SHAPES = {
    "reserved_email": r"[a-z]+\.[a-z]+\d{2}@example\.(?:com|net|org)",
    "phone_paren": r"\(\d{3}\) 555-01\d{2}",
    "phone_dash": r"\d{3}-555-01\d{2}",
    "card_shaped": r"\d{4}(?:-\d{4}){3}",
    "documentation_ip": r"(?:192\.0\.2|198\.51\.100|203\.0\.113)\.\d{1,3}",
    "never_issued_ssn": r"9\d{2}-\d{2}-\d{4}",
}


def register_realistic() -> None:
    """Register the shapes of reserved realistic values."""
    for name, pattern in REALISTIC_SHAPES.items():
        register_shape(name, pattern, replace=True)
