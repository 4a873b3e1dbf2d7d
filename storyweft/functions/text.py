"""Text normalisation, tokens, n-gram sets and display cuts, as column expressions that stay in the JVM."""

from __future__ import annotations

import html
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Control characters that are no white space, and runs of white space; Java's \s knows ASCII only.
CONTROL = r"[\x00-\x08\x0e-\x1f\x7f\x{80}-\x{84}\x{86}-\x{9f}]"
BLANKS = r"[\t-\r \x{85}\p{Z}]+"
TOKEN = r"[\p{L}\p{N}]+"


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body of x, x evaluated once: a lambda's body is evaluated anew for each element, what it refers to included."""
    return F.element_at(F.transform(F.array(x), body), 1)


def normalize_text(x: Column) -> Column:
    """Lower case, no controls, each run of white space one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), CONTROL, ""), BLANKS, " "))


def tokens(x: Column) -> Column:
    """Runs of letters and digits of the normalised text."""
    return F.regexp_extract_all(normalize_text(x), F.lit(TOKEN), F.lit(0))


def fields(x: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(x, BLANKS), lambda w: w != "")


def count_tokens(title: Column, body: Column) -> Column:
    return F.size(fields(F.concat_ws(" ", title, body)))


def set_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def token_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(tokens(a), tokens(b))


def trigrams(x: Column) -> Column:
    """Distinct 3-grams of code points of the normalised text; a shorter text is its own only gram, an empty one has none."""
    return let(normalize_text(x), lambda n: F.filter(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(n) - 2, F.lit(1))), lambda i: F.substr(n, i, F.lit(3)))), lambda g: g != ""))


def trigram_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(trigrams(a), trigrams(b))


def clean_text(x: Column) -> Column:
    """Lines with single blanks, empty ones dropped, a blank line between the rest."""
    lines = F.transform(F.split(F.regexp_replace(x, "\r\n", "\n"), "\n"), lambda s: F.trim(F.regexp_replace(s, BLANKS, " ")))
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n\n")


def truncated(x: Column, limit: int) -> Column:
    """Whether truncate_text cuts."""
    return F.char_length(F.trim(x)) > limit


def truncate_text(x: Column, limit: int, ends: str = " ") -> Column:
    """At most limit code points; a cut text ends in an ellipsis. ends: characters that are left out before it."""
    t = F.trim(x)
    cut = F.concat(F.rtrim(F.substring(t, 1, limit - 1), F.lit(ends)), F.lit("…"))
    return F.when(truncated(x, limit), cut).otherwise(t)


def truncate_cell(x: Column, limit: int) -> Column:
    """For tables: three dots at the end, none if there is no room for them."""
    if limit <= 3:
        return F.substring(x, 1, limit)
    return F.when(F.char_length(x) > limit, F.concat(F.substring(x, 1, limit - 3), F.lit("..."))).otherwise(x)


def embedding_input(title: Column, body: Column) -> Column:
    """Title, body, or both with a blank line between; blank parts are left out."""
    part = lambda x: F.when(F.trim(x) != "", F.trim(x))
    return F.concat_ws("\n\n", part(title), part(body))


def strip_tags(x: Column) -> Column:
    return F.regexp_replace(x, "<[^>]+>", "")


@F.pandas_udf(T.StringType())
def unescape(x: pd.Series) -> pd.Series:
    """Character references of HTML as the characters they stand for."""
    return x.map(html.unescape, na_action="ignore")


def plain_text(x: Column, ampersands_only: bool = False) -> Column:
    """Markup without its tags and with its references resolved; rows without a reference stay out of Python. ampersands_only:
    of the references just whole &amp;, what a cut has left of one stays as it is."""
    bare = strip_tags(x)
    if ampersands_only:
        return F.replace(bare, F.lit("&amp;"), F.lit("&"))
    return F.when(F.contains(bare, F.lit("&")), unescape(bare)).otherwise(bare)


def substantive(text: Column, title: Column) -> Column:
    """Enough text to translate: over 50 bytes more than the title."""
    return F.octet_length(text) > F.octet_length(F.coalesce(title, F.lit(""))) + 50
