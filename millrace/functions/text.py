"""Normalizers, hashes, keys, shingles and similarities as Column expressions.

Compatibility forms (NFKC) have no built-in: an Arrow function makes them, and only texts that hold a character which
NFKC may change are sent to it; all others stay inside the JVM.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ZERO_WIDTH = r"[\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2060}\x{FEFF}]"
CJK_KANA = r"\x{3400}-\x{9FFF}\x{3040}-\x{30FF}"
# Classes of several ranges are slow to try on every character.  Patterns below try one range first, and look back at what
# it lets through.
#: Texts without these are their own NFKC form: ASCII, Latin-1 letters, dashes, quotes, kana, common ideographs.
CHANGING = r"[\x{A0}-\x{10FFFF}](?<![\x{C0}-\x{FF}\x{2013}\x{2014}\x{2018}-\x{201D}\x{3001}\x{3002}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FFF}\x{1F300}-\x{1FAFF}])"
#: Texts without these are of Latin-1 characters, dashes and quotes only: letters and marks can be taken out by translation.
BEYOND_LATIN = r"[\x{100}-\x{10FFFF}](?<![\x{2010}-\x{2015}\x{2018}-\x{201E}\x{2026}\x{20AC}])"
_LATIN = [chr(c) for r in (range(1, 0x100), range(0x2010, 0x2016), range(0x2018, 0x201F), (0x2026, 0x20AC)) for c in r]
#: What goes from lower-case text of these characters, and from text as it is.
_NO_WORD = "".join(c for c in _LATIN if not ("a" <= c <= "z" or "0" <= c <= "9"))
SENTENCE_ENDS = r"[\n\r\x{3002}\x{FF01}\x{FF1F}!?\x{FF1B};]+"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` where ``value`` is worked out once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def is_ascii(text: Column) -> Column:
    """By counting bytes and characters, which is much cheaper than a pattern."""
    return F.octet_length(text) == F.length(text)


def is_inert(text: Column) -> Column:
    return ~text.rlike(CHANGING)


def nfkc(text: Column) -> Column:
    """NFKC form; only texts that it may change travel to Python."""
    return F.coalesce(_nfkc(F.when(~is_ascii(text) & ~is_inert(text), text)), text)


def _shown(form: Column) -> Column:
    return F.when(is_ascii(form), form).otherwise(F.regexp_replace(form, rf"[\x{{200B}}-\x{{FEFF}}](?<={ZERO_WIDTH})", ""))


def _visible(text: Column) -> Column:
    return _shown(nfkc(text))


def normalize_nfkc(form: Column) -> Column:
    return F.trim(_spaced(F.lower(_shown(form)), is_ascii(form)))


def _spaced(text: Column, ascii_only: Column) -> Column:
    """White space collapsed.  Single spaces, nearly all of it, are no match of the patterns.

    ``ascii_only`` is asked of the text as it came: the one given here may be long to make, and both patterns read ASCII alike.
    """
    return F.when(ascii_only, F.regexp_replace(text, r" \s+|[\t-\r]\s*", " ")).otherwise(F.regexp_replace(text, r"(?U) \s+|[^ -~](?<=\s)\s*", " "))


def is_latin(text: Column) -> Column:
    return is_ascii(text) | ~text.rlike(BEYOND_LATIN)


def dense_nfkc(form: Column) -> Column:
    # Nearly all that goes is Latin, and goes by translation; the pattern then looks for the rest alone.
    plain = F.translate(form, _NO_WORD, "")
    return F.when(is_latin(form), plain).otherwise(F.lower(F.regexp_replace(plain, rf"[^a-z](?<![0-9{CJK_KANA}])", "")))


def normalize_text(text: Column) -> Column:
    """NFKC, zero-width marks out, lower case, white space collapsed, trimmed."""
    return normalize_nfkc(nfkc(text))


def dense_text(text: Column) -> Column:
    """NFKC, then CJK, kana, lower-case Latin and digits only; upper-case Latin goes, since the filter comes before lower case."""
    return dense_nfkc(nfkc(text))


def _compact(visible: Column, kept: str = rf"{CJK_KANA}a-z0-9") -> Column:
    plain = F.translate(F.lower(visible), _NO_WORD, "")
    return F.when(is_latin(visible), plain).otherwise(F.regexp_replace(F.lower(visible), f"[^{kept}]", ""))


def farm_text(text: Column) -> Column:
    """NFKC, lower case, CJK, kana, Latin and digits only."""
    return _compact(_visible(text))


def feeling_text(text: Column) -> Column:
    """As ``farm_text`` without kana."""
    return _compact(_visible(text), r"\x{3400}-\x{9FFF}a-z0-9")


def lines(text: Column) -> Column:
    """Normalized non-empty lines or sentences.  Split before NFKC: some of its forms are made of sentence marks."""
    marks = _NO_WORD.replace("\n", "").translate({ord(c): None for c in "\r!?;"})
    plain = F.split(F.translate(F.lower(text), "\r!?;" + marks, "\n\n\n\n"), "\n")
    parted = _visible(F.when(~(is_latin(text) & (is_ascii(text) | is_inert(text))), F.regexp_replace(text, SENTENCE_ENDS, "\n")))
    other = F.transform(F.split(parted, "\n"), lambda x: F.regexp_replace(F.lower(x), f"[^{CJK_KANA}a-z0-9]", ""))
    # A Latin-1 text that NFKC changes (fractions, raised digits) goes the longer way.
    return F.filter(F.when(is_latin(text) & (is_ascii(text) | is_inert(text)), plain).otherwise(other), lambda x: x != "")


def farm_key(text: Column, least: int = 8) -> Column:
    """Distinct lines joined; null when shorter than ``least``."""
    return once(F.array_join(F.array_distinct(lines(text)), ""), lambda key: F.when(F.length(key) >= least, key))


def repeated_line(text: Column, least: int = 8) -> Column:
    return once(F.filter(lines(text), lambda x: F.length(x) >= least), lambda long: F.size(F.array_distinct(long)) < F.size(long))


def strip_invisible(label: Column) -> Column:
    """A label without direction marks, wrapping quotes and outer or doubled spaces."""
    bare = F.regexp_replace(F.regexp_replace(label, ZERO_WIDTH + r"|[\x{2066}-\x{2069}]", ""), r"(?U)\s+", " ")
    return F.trim(F.regexp_replace(F.trim(bare), r"^[\"'\x{201C}\x{201D}\x{2018}\x{2019}\x{300C}\x{300D}]+|[\"'\x{201C}\x{201D}\x{2018}\x{2019}\x{300C}\x{300D}]+$", ""))


def truncate(text: Column, most: int) -> Column:
    """The text, or its first ``most`` - 1 characters and an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 1)), F.lit("…"))).otherwise(text)


def one_line(text: Column, most: int = 400) -> Column:
    """White space collapsed, cut; ``(empty)`` where nothing is left."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return once(flat, lambda x: F.when(x == "", "(empty)").otherwise(truncate(x, most)))


def preview(text: Column, most: int = 30) -> Column:
    return F.left(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(most))


def collapse_runs(text: Column) -> Column:
    """Runs of three or more of a character become two."""
    return F.regexp_replace(text, r"(?s)(.)\1{2,}", "$1$1")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, as eight lower-case hex digits."""
    raw = F.hex(F.encode(text, "UTF-16BE"))
    unit = lambda raw: lambda i: F.conv(F.substring(raw, i * 4 + 1, F.lit(4)), 16, 10).cast("long")
    some = lambda raw: F.transform(F.sequence(F.lit(0), (F.length(raw) / 4).cast("int") - 1), unit(raw))
    units = lambda raw: F.when(F.length(raw) >= 4, some(raw)).otherwise(F.array().cast("array<bigint>"))
    step = lambda h, u: (h.bitwiseXOR(u) * 16777619).bitwiseAND(F.lit(4294967295))
    code = once(raw, lambda r: F.aggregate(units(r), F.lit(2166136261).cast("long"), step))
    return F.lower(F.lpad(F.hex(code), 8, "0"))


def entry_key(id_: Column, handle: Column, text: Column) -> Column:
    """Identity of a post: its id, or a hash of author and text where it has none."""
    hashed = fnv1a(F.concat(F.coalesce(handle, F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))
    return F.when(id_.isNotNull(), F.concat(F.lit("id:"), id_.cast("string"))).otherwise(F.concat(F.lit("h:"), hashed))


def group_key(normal: Column, id_: Column) -> Column:
    """Key of a fold, from the normalized text of its representative, or from its id where that is empty."""
    return F.concat(F.lit("bk_"), fnv1a(F.when(normal != "", normal).otherwise(F.coalesce(id_.cast("string"), F.lit("")))))


def grams(text: Column, n: int) -> Column:
    """All stretches of ``n`` characters, in order; one pass, however long the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1))


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams of a normalized text; a shorter one is its own."""
    return once(text, lambda t: F.when(F.length(t) < n, F.array(t)).otherwise(F.array_distinct(grams(t, n))))


def overlap(a: Column, b: Column) -> Column:
    """Share of the smaller shingle set that the other holds."""
    return F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))


def semantic_similarity(a: Column, b: Column) -> Column:
    """Overlap of the trigrams of two normalized texts; an empty one resembles nothing."""
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(overlap(shingles(a), shingles(b)))


def farm_similarity(a: Column, b: Column) -> Column:
    """As ``semantic_similarity``, but two empty texts are alike and lengths beyond a factor of two are not."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when((short == 0) | (short * 2 < long), 0.0).otherwise(overlap(shingles(a), shingles(b)))


def random_name(name: Column) -> Column:
    """At least five letters, at most six digits, no separator, and few vowels or a long run of consonants."""
    letters = F.regexp_replace(F.lower(name), "[^a-z]", "")
    digits = F.length(F.regexp_replace(name, "[^0-9]", ""))

    def odd(x: Column) -> Column:
        vowels = F.length(F.regexp_replace(x, "[^aeiouy]", ""))
        run = F.array_max(F.transform(F.split(x, "[aeiouy]+"), F.length))
        return (F.length(x) >= 5) & ((vowels / F.greatest(F.length(x), F.lit(1)) < 0.22) | (run >= 5))

    return ~name.rlike(r"[\s_\-.]") & (digits <= 6) & once(letters, odd)


def looks_random(handle: Column, display_name: Column) -> Column:
    """``random_name`` of the handle or of the display name."""
    each = [F.coalesce(random_name(F.coalesce(x, F.lit(""))), F.lit(False)) for x in (handle, display_name)]
    return each[0] | each[1]
