"""Text normalisation, splitting and matching as column expressions.

Unicode normal form and case folding have no built-in, so they are one Arrow
function; all else stays in the JVM. Null texts stay null unless stated.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from adagium.functions import fixed

SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"


def _each(f, texts: pa.Array) -> pa.Array:
    """f of each text, a few hundred at a time: besides the batch and its result no copy of all texts is held."""
    parts = [pa.array([t if t is None else f(t) for t in texts[i : i + 256].to_pylist()], pa.string()) for i in range(0, len(texts), 256)]
    return pa.concat_arrays(parts) if parts else texts


@F.arrow_udf(StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    return _each(lambda t: unicodedata.normalize("NFC", t), texts)


@F.arrow_udf(StringType())
def _folded(texts: pa.Array) -> pa.Array:
    return _each(lambda t: unicodedata.normalize("NFC", t).casefold(), texts)


def _beyond_ascii(c: Column, ascii: Column, other) -> Column:
    """Only texts with other than ASCII characters are sent to other."""
    plain = F.octet_length(c) == F.length(c)
    return F.when(plain, ascii).otherwise(other(F.when(~plain, c)))


def nfc(c: Column) -> Column:
    """Unicode normal form C."""
    return _beyond_ascii(c, c, _nfc)


def folded(c: Column) -> Column:
    """Normal form C, case-folded (the Unicode folding, not lower-casing)."""
    return _beyond_ascii(c, F.lower(c), _folded)


def collapse(c: Column) -> Column:
    """Runs of Unicode white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def clean(c: Column) -> Column:
    """Null becomes '', normal form C, white space collapsed."""
    return collapse(F.coalesce(nfc(c), F.lit("")))


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def norm_key(c: Column) -> Column:
    """Comparison key. Case-folded, white space collapsed and dropped before punctuation, edge punctuation stripped."""
    tight = F.regexp_replace(collapse(F.coalesce(folded(c), F.lit(""))), rf"\s+([{fixed.TIGHT_PUNCTUATION}])", "$1")
    return strip_chars(tight, fixed.EDGE_PUNCTUATION)


def sentences(c: Column) -> Column:
    """Split after . ! ? (also where a capital follows at once); blank pieces drop."""
    apart = F.trim(F.regexp_replace(c, r"([.!?])(?=[A-Z])", "$1 "))
    return F.filter(F.split(apart, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def english_words(c: Column, least: int = 3) -> Column:
    """Lower-cased tokens of ASCII letters and apostrophes, of at least so many characters."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z']+)"), 1), lambda w: F.length(w) >= least)


def english_fraction(c: Column, lexicon: list[str] | Column) -> Column:
    """T4: share of English tokens found in the lexicon, 0 with fewer than two tokens."""
    words = english_words(c)
    # A literal list becomes a hash set; a column is searched.
    known = (lambda w: w.isin(*lexicon)) if isinstance(lexicon, list) else (lambda w: F.array_contains(lexicon, w))
    hits = F.size(F.filter(words, known))
    return F.when(F.size(words) >= 2, hits / F.size(words)).otherwise(F.lit(0.0))


def split_english(c: Column, lexicon: list[str], share: float = 0.6) -> tuple[Column, Column]:
    """T5: (native, english): trailing sentences of English words are cut off; not if none or all are."""
    parts = sentences(c)
    flags = F.transform(parts, lambda s: english_fraction(s, lexicon) >= share)
    # Length of the longest run of true values at the end.
    tail = F.aggregate(flags, F.lit(0), lambda n, f: F.when(f, n + 1).otherwise(0))
    n = F.size(parts)
    cut = (tail > 0) & (tail < n)
    join = lambda start, k: F.trim(F.array_join(F.slice(parts, start, k), " "))
    return F.when(cut, join(1, n - tail)).otherwise(c), F.when(cut, join(n - tail + 1, tail)).otherwise("")


def split_at_english(c: Column, pattern: str = fixed.EMBEDDED_ENGLISH) -> tuple[Column, Column]:
    """(native, english): cut after the last full stop before the first clearly English word."""
    hit = F.regexp_instr(c, F.lit(pattern))
    before = F.substring(c, F.lit(1), hit - 1)
    stop = F.length(before) - F.instr(F.reverse(before), ".") + 1
    cut = (hit > 0) & (F.instr(before, ".") > 0)
    return F.when(cut, collapse(F.substring(c, F.lit(1), stop))).otherwise(c), F.when(cut, collapse(F.substring(c, stop + 1, F.length(c)))).otherwise("")


def is_junk(c: Column, lexicon: list[str]) -> Column:
    """Empty, without any letter or digit, or one lexicon word (with or without full stop)."""
    word = F.lower(F.regexp_extract(c, r"^([A-Za-z]+)\.?$", 1))
    return (c == "") | c.rlike(r"(?U)^[\W_]+$") | word.isin(*lexicon)


def straight_quotes(c: Column) -> Column:
    """Curly quotes become straight ones."""
    return F.translate(c, "’‘“”", "''\"\"")


def outcome_clause(c: Column) -> Column:
    """What follows the first comma, semicolon or ' then ' if it has two words, else the whole."""
    parts = F.split(c, ",|;| then ", 2)
    second = F.try_element_at(parts, F.lit(2))
    return F.when(F.size(F.split(F.trim(F.coalesce(second, F.lit(""))), r"\s+")) >= 2, second).otherwise(c)


def hits(c: Column, pattern: str) -> Column:
    """Non-overlapping matches."""
    return F.regexp_count(c, F.lit(pattern))


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def truncated(c: Column, n: int) -> Column:
    """The first n characters, for display or a model's input."""
    return F.substring(c, 1, n)


def first_word(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, "[a-zA-Z']+", 0))


def prefer_text(english: Column, native: Column) -> Column:
    """The English text if it isn't blank, else the native one."""
    return F.when(F.trim(english) != "", english).otherwise(native)


def has_english(c: Column) -> Column:
    """P5: neither blank nor the text 'nan'."""
    return F.coalesce((F.trim(c) != "") & (F.lower(F.trim(c)) != "nan"), F.lit(False))


def needs_translation(english: Column, native: Column) -> Column:
    """P6."""
    return (F.trim(F.coalesce(english, F.lit(""))) == "") & (F.trim(F.coalesce(native, F.lit(""))) != "")
