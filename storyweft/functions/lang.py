"""Language codes and a small stop-word detector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyweft.functions.text import BLANKS, let

#: Frequent words by language, for detection only.
STOPWORDS = {
    "de": "der die das und ist von mit ein eine zu den nicht auf für im sich des dem auch als",
    "en": "the of and to in is that for it with as was on are be this by at from or",
    "es": "el la de que y en los del se las por un para con no una su al lo como",
    "fr": "le la les de et des en un une du est que dans pour qui par sur au plus pas",
    "it": "il di che la e un in per non una sono del con si da alla le dei come più",
    "pt": "o de que e do da em um para com não uma os no se na por mais as dos",
    "nl": "de het een van en in is dat op te zijn voor met niet aan er om ook als bij",
}


ENDS = r"^[\t-\r \x{85}\p{Z}]+|[\t-\r \x{85}\p{Z}]+$"


def _bare(x: Column) -> Column:
    """Without white space at the ends, in lower case, `_` as `-`."""
    return F.regexp_replace(F.lower(F.regexp_replace(x, ENDS, "")), "_", "-")


def iso_code(x: Column) -> Column:
    """First subtag in lower case if it has two letters a-z, else empty."""
    first = F.regexp_extract(_bare(x), "^([^-]*)", 1)
    return F.when(first.rlike("^[a-z]{2}$"), first).otherwise(F.lit(""))


def language_tag(x: Column) -> Column:
    """Lower case, `_` as `-`, empty parts dropped; empty if a part holds anything but letters a-z."""
    parts = F.filter(F.transform(F.split(_bare(x), "-"), lambda p: F.regexp_replace(p, ENDS, "")), lambda p: p != "")
    return F.when(F.forall(parts, lambda p: p.rlike("^[a-z]+$")), F.array_join(parts, "-")).otherwise(F.lit(""))


def language_code(x: Column) -> Column:
    """First part of the tag."""
    return F.substring_index(language_tag(x), "-", 1)


def detect_language(x: Column) -> Column:
    """Two-letter code by stop words of the whole text, the first by name of equal counts; `und` below six letters or
    without a hit, and for null. One pass over the words for each language, all in the JVM."""
    names = sorted(STOPWORDS)

    def of(own: list[str]):
        return lambda w: w.isin(*own)

    def best(words: Column) -> Column:
        hits = F.array(*[F.size(F.filter(words, of(STOPWORDS[k].split()))) for k in names])
        return let(hits, lambda h: F.when(F.array_max(h) > 0, F.element_at(F.array(*[F.lit(k) for k in names]), F.array_position(h, F.array_max(h)).cast("int"))).otherwise("und"))

    found = let(F.split(F.lower(x), BLANKS), best)
    return F.when(F.coalesce(x.rlike(r"^(?:[^\p{L}]*+\p{L}){6}"), F.lit(False)), found).otherwise(F.lit("und"))
