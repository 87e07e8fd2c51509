"""Scalar functions on strings, as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Symbol rewrites of the simple normaliser, applied in this order.
REWRITES = [
    ("‚", ","), ("„", ",,"), ("·", "."), ("…", "..."), ("ˆ", "^"), ("˜", "~"), ("‹", "<"), ("›", ">"),
    ("[‘’´`]", "'"), ("[“”«»]", '"'), ("[•†‡]", ""), ("[‐‑–—]", "-"), ("[\u2e00-\uffff]", ""),
]


def trim(c: Column) -> Column:
    """Without blanks and control characters at the ends."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+\z", "")


def ws_normalize(c: Column) -> Column:
    """Runs of white space become a blank; control characters and blanks at the ends go."""
    return trim(F.regexp_replace(c, r"[ \t\n\x0B\f\r]+", " "))


def without_marks(x: str) -> str:
    """Canonical decomposition without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFD", x) if not "̀" <= c <= "ͯ")


@F.pandas_udf(StringType())
def strip_marks(s: pd.Series) -> pd.Series:
    """Canonical decomposition without combining marks: no built-in function decomposes."""
    return s.map(lambda x: None if x is None else without_marks(x))


def simple_normalize(c: Column, marks: bool = True) -> Column:
    """Marks, symbols, citations, trailing stars, years or numbers in brackets, outer quotes and list numbers go. ``marks=False`` leaves marks in place, all in built-in functions."""
    c = strip_marks(c) if marks else c
    for pattern, to in REWRITES:
        c = F.regexp_replace(c, pattern, to)
    for pattern, to in ((r"\[(nb ?)?\d+\]", ""), (r"\*+$", ""), (r"\(\d* ?-? ?\d*\)", ""), ('^"(.*)"$', "$1")):
        c = F.regexp_replace(c, pattern, to)
    return ws_normalize(F.when(c.rlike(r"^[0-9.]+\z"), c).otherwise(F.regexp_replace(c, r"^\d+\.", "")))


def aggressive_normalize(c: Column, marks: bool = True) -> Column:
    """The simple form without any bracketed text, non-ASCII, tail after a dash or final parenthesis."""
    c = simple_normalize(c, marks)
    for pattern in (r"\[[^\]]*\]", "[\u007f-\uffff]", r" - .*$", r"\([^)]*\)$"):
        c = F.regexp_replace(trim(c), pattern, "")
    return ws_normalize(c)


def normalize(c: Column, level: int, marks: bool = True) -> Column:
    """Level 1 white space, 2 simple, 3 and more aggressive, else unchanged."""
    return c if level < 1 else ws_normalize(c) if level == 1 else simple_normalize(c, marks) if level == 2 else aggressive_normalize(c, marks)


def phrase_shape(c: Column) -> Column:
    """Lower-case letters a, other letters A, digits 0, any space a blank; equal neighbours collapse."""
    c = F.regexp_replace(c, r"\p{javaLowerCase}", "a")
    c = F.regexp_replace(c, r"[\p{L}&&[^a]]", "A")
    c = F.regexp_replace(c, r"\p{Nd}", "0")
    c = F.regexp_replace(c, r"[\p{Z}\t-\r\x1c-\x1f]", " ")
    return F.regexp_replace(c, r"(?s)(.)\1+", "$1")


def java_split(c: Column, by: str) -> Column:
    """Parts between ``by``, without empty ones at the end; a string without ``by`` is one part, even if empty."""
    cut = F.regexp_replace(c, f"({by})+\\z", "")
    return F.when(F.contains(c, F.lit(by)) & (cut == ""), F.array().cast("array<string>")).otherwise(F.split(cut, by))


def collapse(words: Column) -> Column:
    """An array without elements that equal the one before."""
    return F.filter(words, lambda x, i: (i == 0) | (x != F.get(words, i - 1)))


def bag_of_words(c: Column) -> Column:
    """The set of words, in order; each run of digits is one 0."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.regexp_replace(c, r"[0-9]+", "0"), F.lit("[A-Za-z0-9]+"), F.lit(0))))


def alnum_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]+|[0-9]+"), F.lit(0))


def near(a: Column, b: Column, limit: int) -> Column:
    """Bounded edit distance of gold ``a`` and ``b``, with the banded form's rule that the first character of ``a`` is never plainly deleted."""
    tail = F.substring(a, 2, 2**30)
    ways = [F.when(F.lit(j) < F.char_length(b), j + (F.substring(a, 1, 1) != F.substring(b, j + 1, 1)).cast("int") + F.levenshtein(tail, F.substring(b, j + 2, 2**30))) for j in range(limit + 1)]
    hit = F.exists(F.array(*ways), lambda d: F.coalesce(d <= limit, F.lit(False)))
    return F.coalesce((F.abs(F.char_length(a) - F.char_length(b)) <= limit) & F.when(a == "", F.char_length(b) <= limit).otherwise(hit), F.lit(False))


def deletions(c: Column) -> Column:
    """A string and all that is left of it without one or two characters: strings within edit distance 2 have one of these in common."""
    cut = lambda s, i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.char_length(s)))
    end = F.char_length(c) + 1  # a place behind the string takes nothing away
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), end), lambda j: F.transform(F.sequence(F.lit(1), j), lambda i: F.when(i < j, cut(cut(c, j), i)).otherwise(cut(c, j))))))


# Rewrites of a phrase before its head word is sought.
PHRASE_REWRITES = [(" wiki(pedia)?$", ""), ("^(type|name) of ", ""), (r" (episodes?) (season \d+)$", " $1 of $2")]


def hack_phrase(c: Column) -> Column:
    for pattern, to in PHRASE_REWRITES:
        c = F.regexp_replace(c, pattern, to)
    return c


def head_index(tags: Column, entities: Column) -> Column:
    """Place of the head word, from part-of-speech and entity tags; null for no tokens.

    Before the first preposition or question word that isn't at the start, if the token before is no named entity: the
    last noun, else that token. Otherwise the last token that is no number or date, else the last.
    """
    places = F.sequence(F.lit(0), F.size(tags) - 1)
    cut = F.get(F.filter(places, lambda i: (i > 0) & F.get(tags, i).isin("IN", "WP", "WDT", "TO")), F.lit(0))
    noun = F.array_max(F.filter(places, lambda i: (i < cut) & F.startswith(F.get(tags, i), F.lit("N"))))
    plain = F.array_max(F.filter(places, lambda i: (F.get(tags, i) != "CD") & (F.coalesce(F.get(entities, i), F.lit("O")) != "DATE")))
    return F.when(F.size(tags) > 0, F.when(F.get(entities, cut - 1) == "O", F.coalesce(noun, cut - 1)).otherwise(F.coalesce(plain, F.size(tags) - 1)))


def canonical_pos(tag: Column) -> Column:
    """Nouns, verbs and question words by their first letter."""
    return F.when(F.substring(tag, 1, 1).isin("N", "V", "W"), F.substring(tag, 1, 1)).otherwise(tag)


def cluster_prefixes(cluster: Column) -> Column:
    """Prefixes of a bit-string cluster by length; none for null."""
    lengths = F.array(*map(F.lit, (4, 6, 10, 20)))
    return F.transform(F.when(cluster.isNotNull(), lengths), lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"), F.substring(cluster, F.lit(1), n)))


def sampled(items: Column, limit: int = 30, width: int = 60) -> Column:
    """A list for display: items cut to ``width``; of a longer list the first limit - 3 and the last 4."""
    short = F.transform(items, lambda s: F.substring(s, 1, width))
    return F.when(F.size(items) <= limit, short).otherwise(F.concat(F.slice(short, 1, limit - 3), F.slice(short, -4, 4)))
