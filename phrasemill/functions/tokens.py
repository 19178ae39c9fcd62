"""Text cleaning and tokenising as column expressions.

All of it runs inside the JVM except ``ascii_fold``, for which Spark has no
built-in function.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# English names of the numbers 0 to 21.
SMALL_NUMBERS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen",
    "nineteen", "twenty", "twenty-one",
]
# What starts a new token wherever it stands.
MARKERS = ["http", "www", "@", "#"]
# A token that starts so is dropped.
DROPPED_PREFIXES = ["@", "&", "http", "www"]

# ASCII white space; Java's \s is the same set, RE2's lacks \x0B.
SPACE = r"[ \t\n\x0B\f\r]"
_MARKER = "|".join(MARKERS)
# A dropped token runs up to white space or up to the next marker. "&" counts only at a token's start.
_DROPPED = rf"(?:http|www|@|(?<!\S)&)(?:(?!{_MARKER})\S)*+"
_SMALL = "0*(?:1?[0-9]|2[01])"


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.

    ``lower`` would turn two non-ASCII letters into ASCII ones (Kelvin sign and
    dotted I); they become "_" first, a symbol like every other non-ASCII letter.
    """
    has_either = text.contains("K") | text.contains("İ")
    return F.when(has_either, F.lower(F.regexp_replace(text, "[Kİ]", "_"))).otherwise(F.lower(text))


def drop_marked(text: Column) -> Column:
    """Remove mentions, entities and links from lower-case text."""
    has_any = text.contains("http") | text.contains("www") | text.contains("@") | text.contains("&")
    return F.when(has_any, F.regexp_replace(text, _DROPPED, " ")).otherwise(text)


def number_words(words: Column) -> Column:
    """Replace whole-number tokens up to 21 by their English names."""
    names = F.array(*[F.lit(n) for n in SMALL_NUMBERS])
    return F.transform(words, lambda w: F.when(
        (w < ":") & w.rlike(f"^{_SMALL}$"), F.get(names, w.cast("int"))).otherwise(w))


def words_of(text: Column) -> Column:
    """Text to its array of words.

    The order of the steps matters: lower-case, split at markers, drop marked
    tokens, turn symbols into spaces, name small numbers. Splitting at markers
    and dropping are one regular expression; texts without a marker or a small
    number skip those steps.
    """
    def split(plain: Column) -> Column:
        has_small = plain.rlike("[0-9]") & plain.rlike(f"(?<![a-z0-9]){_SMALL}(?![a-z0-9])")
        return _bind(F.array_remove(F.split(plain, "[^a-z0-9]+"), ""),
                     lambda words: F.when(has_small, number_words(words)).otherwise(words))

    return _bind(ascii_lower(text), lambda low: _bind(drop_marked(low), split))


def raw_tokens(text: Column) -> Column:
    """White-space tokens of lower-case text after splitting at markers, none dropped."""
    spaced = F.regexp_replace(ascii_lower(text), f"({_MARKER})", " $1")
    return F.filter(F.split(spaced, SPACE + "+"), lambda w: w != "")


def is_dropped(token: Column) -> Column:
    return token.rlike("^(" + "|".join(DROPPED_PREFIXES) + ")")


@F.pandas_udf(T.StringType())
def ascii_fold(text: pd.Series) -> pd.Series:
    """Decompose letters (NFKD) and keep the ASCII ones: ``café`` gives ``cafe``."""
    return text.map(
        lambda s: s if s.isascii() else unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode(),
        na_action="ignore")


def one_line(text: Column) -> Column:
    """Trim ASCII white space and delete line breaks; the words around a break are joined."""
    return F.replace(F.btrim(text, F.lit(" \t\n\x0b\f\r")), F.lit("\n"), F.lit(""))


def has_tokens(text: Column, least: int) -> Column:
    """At least so many white-space tokens; reads no further than needed."""
    return text.rlike(rf"^\s*+\S++(?:\s++\S++){{{least - 1}}}")


def token_count(text: Column) -> Column:
    """Number of white-space tokens."""
    return F.regexp_count(text, F.lit(r"\S+"))
