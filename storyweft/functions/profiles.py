"""Language detection by rank-ordered profiles of character n-grams, trained on a table of labelled texts.

A text's grams are the pieces of one to three letters of its words, each word with a blank before and after it. A language's
profile is its TOP most frequent grams over all training texts, ties by code point; so is a text's. A text's distance from a
language is the sum, over the text's profile, of how far each gram's rank lies from its rank in the language's, TOP where the
language lacks it; the nearest language is detected, the first by name of equal ones. Only languages come into question of
whose training letters at least one in a hundred belongs to the script that most of the text's letters belong to.

Training counts partial sums in the tasks, then by (language, gram); only TOP grams of each two-letter code reach the
driver, 676 x TOP at most. Whole texts are read, in runs of CHUNK letters, so that a long text needs little memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyweft.functions.lang import iso_code

TOP = 300
CHUNK = 1 << 20
#: Where blocks of scripts begin; letters from one place to the next are of one script.
SCRIPTS = {
    "latin": 0x0, "greek": 0x370, "cyrillic": 0x400, "armenian": 0x530, "hebrew": 0x590, "arabic": 0x600, "syriac": 0x700, "devanagari": 0x900, "bengali": 0x980, "gurmukhi": 0xA00,
    "gujarati": 0xA80, "odia": 0xB00, "tamil": 0xB80, "telugu": 0xC00, "kannada": 0xC80, "malayalam": 0xD00, "sinhala": 0xD80, "thai": 0xE00, "lao": 0xE80, "tibetan": 0xF00,
    "burmese": 0x1000, "georgian": 0x10A0, "hangul": 0x1100, "ethiopic": 0x1200, "other": 0x13A0, "khmer": 0x1780, "mongolian": 0x1800, "latin+": 0x1E00, "greek+": 0x1F00, "other+": 0x2000,
    "kana": 0x3040, "han": 0x3100, "hangul+": 0xAC00, "han+": 0xF900, "other++": 0xFB00, "han++": 0x20000,
}
STARTS = np.array(list(SCRIPTS.values()), np.uint32)
NAMES = sorted({k.rstrip("+") for k in SCRIPTS})
SCRIPT_OF = np.array([NAMES.index(k.rstrip("+")) for k in SCRIPTS])
BLANK = 32


def spaced(x: Column) -> Column:
    """Words of letters and marks in lower case, a blank around each; one of nothing else has blanks alone."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{M}]+", " ")), F.lit(" "))


def has_letters(x: Column, n: int = 6) -> Column:
    return F.coalesce(x.rlike(rf"^(?:[^\p{{L}}]*+\p{{L}}){{{n}}}"), F.lit(False))


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    some, back = np.unique(np.concatenate(codes), return_inverse=True)
    return some, np.bincount(back, np.concatenate(counts), len(some)).astype(np.int64)


def _grams(words: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams of a spaced text as 21 bits a letter, their counts, and letters by script. The order of grams is that of strings."""
    points = np.frombuffer(words.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes, counts, scripts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(NAMES), np.int64)
    for start in range(0, len(points), CHUNK):
        c = points[start : start + CHUNK + 2].astype(np.int64)
        n = min(CHUNK, len(points) - start)
        one, two, three = c[:n], c[1 : n + 1], c[2 : n + 2]
        letters = one[one != BLANK]
        scripts += np.bincount(SCRIPT_OF[np.searchsorted(STARTS, letters, "right") - 1], minlength=len(NAMES))
        pair = one[: len(two)] << 42 | two << 21
        inner = two[: len(three)] != BLANK
        parts = [letters << 42, pair, (pair[: len(three)] | three)[inner]]
        some, n_each = np.unique(np.concatenate(parts), return_counts=True)
        codes.append(some)
        counts.append(n_each)
        if len(codes) > 8:
            merged = _summed(codes, counts)
            codes, counts = [merged[0]], [merged[1]]
    lone = (BLANK << 42) | (BLANK << 21)  # a text without a word
    some, n_each = (codes[1], counts[1]) if len(codes) == 2 else _summed(codes, counts)
    keep = some != lone
    return some[keep], n_each[keep], scripts


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """lang, code, n: partial sums of a task; scripts have codes below 0."""
    held: dict[str, tuple[list, list]] = {}
    size = 0

    def out():
        for name, (codes, counts) in held.items():
            some, n = _summed(codes, counts)
            yield pd.DataFrame({"lang": name, "code": some, "n": n})

    for batch in batches:
        for name, words in zip(batch["lang"], batch["words"], strict=True):
            codes, n, scripts = _grams(words)
            at = np.flatnonzero(scripts)
            own = held.setdefault(name, ([], []))
            own[0].extend((codes, -1 - at))
            own[1].extend((n, scripts[at]))
            size += len(codes) + len(at)
            if size > CHUNK:
                held = {k: tuple([x] for x in _summed(*v)) for k, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
                if size > CHUNK // 2:
                    yield from out()
                    held, size = {}, 0
    yield from out()


@dataclass(frozen=True)
class Profiles:
    """Languages by name, their grams sorted by code with the language's place and the gram's rank, and whether a script
    is a language's own."""

    names: tuple[str, ...]
    codes: np.ndarray
    of: np.ndarray
    ranks: np.ndarray
    scripts: np.ndarray

    def nearest(self, words: str) -> tuple[str | None, int | None]:
        codes, counts, scripts = _grams(words)
        if not len(codes) or not self.names:
            return None, None
        top = codes[np.lexsort((codes, -counts))[:TOP]]
        left, right = np.searchsorted(self.codes, top, "left"), np.searchsorted(self.codes, top, "right")
        n = right - left
        at = np.arange(n.sum()) + np.repeat(left - (np.cumsum(n) - n), n)
        near = TOP - np.abs(np.repeat(np.arange(1, len(top) + 1), n) - self.ranks[at])
        distance = TOP * len(top) - np.bincount(self.of[at], near, len(self.names)).astype(np.int64)
        fit = np.flatnonzero(self.scripts[:, scripts.argmax()])
        if not len(fit):
            return None, None
        best = fit[distance[fit].argmin()]
        return self.names[best], int(distance[best])


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of all rows that have a text and a two-letter code; without any, none is ever detected."""
    labelled = rows.select(iso_code(F.col(lang_col)).alias("lang"), spaced(F.col(text_col)).alias("words")).filter("lang <> '' AND words IS NOT NULL")
    counts = labelled.mapInPandas(_counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang", F.col("code") < 0).orderBy(F.desc("n"), "code")
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP)  # cut in every task before the shuffle
    p = top.toPandas().sort_values(["code", "lang"])
    names = tuple(sorted(p["lang"].unique()))
    place = p["lang"].map({k: i for i, k in enumerate(names)}).to_numpy(np.int64)
    code, n = p["code"].to_numpy(np.int64), p["n"].to_numpy(np.int64)
    gram = code >= 0
    letters = np.zeros((len(names), len(NAMES)), np.int64)
    letters[place[~gram], -1 - code[~gram]] = n[~gram]
    return Profiles(names, code[gram], place[gram], p["rank"].to_numpy(np.int64)[gram], (letters > 0) & (100 * letters >= letters.sum(1, keepdims=True)))


def detector(profiles: Profiles) -> Callable[[Column], Column]:
    """A function of a text column to (lang, distance): `und` and null below six letters, for null, and where no language
    comes into question."""

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("distance", T.LongType())]))
    def nearest(words: pd.Series) -> pd.DataFrame:
        found = [(None, None) if w is None else profiles.nearest(w) for w in words]
        return pd.DataFrame({"lang": pd.Series([f[0] for f in found], dtype="object"), "distance": pd.array([f[1] for f in found], dtype="Int64")})

    def detect(x: Column) -> Column:
        found = nearest(F.when(has_letters(x), spaced(x)))
        return F.struct(F.coalesce(found["lang"], F.lit("und")).alias("lang"), found["distance"].alias("distance"))

    return detect


def held_out(key: Column) -> Column:
    """3 of 16 keys, by their digest."""
    return F.substring(F.md5(key.cast("string")), 1, 1).isin("0", "1", "2")
