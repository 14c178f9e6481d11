"""Text functions as Column expressions: tokens, n-grams, joins and renderings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English stop words of the default analyzer.
STOP_WORDS = (
    "a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does doing down "
    "during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on "
    "once only or other our ours out over own same she should so some such than that the their theirs them then there these they this those through to too under "
    "until up very was we were what when where which while who whom why will with would you your yours"
).split()


def split_words(text: Column) -> Column:
    """Runs of anything but white space, case kept."""
    return F.filter(F.split(text, "(?U)\\s+"), lambda t: t != "")


def word_characters(text: Column) -> Column:
    """Runs of letters, numerals and underscores of any script."""
    return F.regexp_extract_all(text, F.lit("[\\p{L}\\p{N}_]+"), 0)


def analyze(text: Column, stop_words=STOP_WORDS) -> Column:
    """Default analyzer: lower-cased alphabetic tokens that are no stop words."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("(?<![\\p{L}\\p{N}_])\\p{L}++(?![\\p{N}_])"), 0)  # word_characters() of letters alone
    return F.array_except(tokens, F.array(*map(F.lit, stop_words))) if stop_words else F.array_distinct(tokens)


def char_ngrams(word: Column, n: int = 2) -> Column:
    """The set of substrings of n characters; empty for a shorter word."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, F.lit(n))))
    return F.when(F.length(word) >= n, grams).otherwise(F.array().cast("array<string>"))


def letters(word: Column) -> Column:
    """The characters of a word, each with the number of its occurrence, so that sets of them meet as multisets do."""
    each = F.filter(F.split(word, ""), lambda c: c != "")
    return F.transform(each, lambda c, i: F.concat(c, F.size(F.filter(F.slice(each, F.lit(1), i + 1), lambda x: x == c)).cast("string")))


def all_text(*columns: Column) -> Column:
    """Every field of a record joined by spaces, lower-cased; nulls read 'none'."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("None")) for c in columns]))


def join_tokens(pairs: Column, by: str = " ") -> Column:
    """Tokens of an array of (place, token) structs, in order of place."""
    return F.array_join(F.transform(F.array_sort(pairs), lambda s: s["token"]), by)


def render_ids(ids: Column, by: str = ",") -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), by)


#: Units of byte counts, each 1,024 of the one before.
UNITS = ("B", "KB", "MB", "GB")


def format_bytes(size: float) -> str:
    """A byte count in the largest unit of which it has one, two decimals."""
    power = min(max(int(size).bit_length() - 1, 0) // 10, len(UNITS) - 1)
    return f"{size / 1024**power:.2f} {UNITS[power]}"
