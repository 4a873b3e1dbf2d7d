"""Language profiles against plain counting, and on planted scripts."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from storyweft.functions import profiles
from storyweft.functions.profiles import TOP
from storyweft.operators.normalize import normalize

TRAINING = {
    "en": "The ferry was late for the tide, and that is why it is at the pier with all of its crew. There is nothing else to be said about this.",
    "de": "Die Fähre ist mit der Flut zu spät gekommen, und deshalb liegt sie nicht auf See. Mehr ist darüber nicht zu sagen, meint die Mannschaft.",
    "ru": "Паром опоздал к приливу и поэтому стоит у причала вместе со всей командой. Больше об этом сказать нечего.",
    "ja": "フェリーは潮に遅れたので、乗組員と一緒に桟橋にいます。これについて他に言うことはありません。",
    "el": "Το πλοίο άργησε στην παλίρροια και γι αυτό βρίσκεται στην προβλήτα με όλο το πλήρωμα.",
}


def plain_grams(text):
    count = Counter()
    for w in re.sub(r"[\W\d_]+", " ", text.lower()).split():
        p = f" {w} "
        for n in (1, 2, 3):
            count.update(g for g in (p[i : i + n] for i in range(len(p) - n + 1)) if g != " ")
    return count


def ranks(count):
    return {g: i for i, (g, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))[:TOP], 1)}


def plain_nearest(of, text):
    own = ranks(plain_grams(text))
    return min((sum(abs(r - p[g]) if g in p else TOP for g, r in own.items()), name) for name, p in of.items())


@pytest.fixture(scope="module")
def trained(spark):
    rows = [(t, k.upper() if k == "en" else k) for k, t in TRAINING.items()] + [(None, "en"), ("no label", None), ("not a code", "english"), ("", "de")]
    return profiles.fit(spark.createDataFrame(rows, "text string, lang string").repartition(3))


def test_profiles_are_those_of_plain_counting(spark, trained):
    of = {k: ranks(plain_grams(t)) for k, t in TRAINING.items()}
    assert trained.names == tuple(sorted(TRAINING))
    for at, name in enumerate(trained.names):
        unpacked = {"".join(chr(c >> s & 0x1FFFFF) for s in (42, 21, 0)).rstrip("\0"): r for c, r in zip(trained.codes[trained.of == at].tolist(), trained.ranks[trained.of == at].tolist(), strict=True)}
        assert unpacked == of[name]
    latin = {k: of[k] for k in ("de", "en")}
    rng = random.Random(3)
    texts = [" ".join(rng.choices((TRAINING["en"] + TRAINING["de"]).split(), k=rng.randrange(3, 60))) for _ in range(60)]
    detect = profiles.detector(trained)
    got = [tuple(r.f) for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(detect(F.col("t")).alias("f")).collect()]
    assert got == [plain_nearest(latin, t)[::-1] for t in texts]


def test_scripts_and_odd_texts(spark, trained):
    detect = profiles.detector(trained)
    found = lambda x: spark.range(1).select(detect(F.lit(x).cast("string")).alias("f")).first().f
    assert found("команда стоит у причала")["lang"] == "ru"
    assert found("το πλήρωμα στην προβλήτα")["lang"] == "el"
    assert found("乗組員と桟橋について")["lang"] == "ja"
    assert tuple(found("ქართული ენა არის")) == ("und", None)  # no language of that script was learned
    assert [tuple(found(x)) for x in (None, "", "a b c d e", "12 34 !?")] == [("und", None)] * 4
    assert found("4711 " * 20_000 + "die Fähre liegt nicht auf See")["lang"] == "de"
    none = profiles.detector(profiles.fit(spark.createDataFrame([], "text string, lang string")))
    assert spark.range(1).select(none(F.lit("the ferry was late")).alias("f")).first().f["lang"] == "und"


def test_long_texts_are_read_in_runs(monkeypatch):
    rng = random.Random(8)
    words = " " + " ".join("".join(rng.choices("abcdéñ", k=rng.randrange(1, 9))) for _ in range(4000)) + " "
    whole = profiles._grams(words)
    monkeypatch.setattr(profiles, "CHUNK", 37)
    for a, b in zip(whole, profiles._grams(words), strict=True):
        assert np.array_equal(a, b)
    parts = list(profiles._counted(iter([pd.DataFrame({"lang": ["x", "y"] * 5, "words": [words] * 10})])))
    total = Counter()
    for p in parts:
        for k, c, n in zip(p["lang"], p["code"], p["n"], strict=True):
            total[k, c] += n
    assert len(parts) > 2 and {c: n for (k, c), n in total.items() if k == "x" and c >= 0} == {c: 5 * n for c, n in zip(whole[0].tolist(), whole[1].tolist(), strict=True)}


def test_normalise_with_a_trained_detector(spark, trained):
    payload = '{"title": "Паром стоит", "body_text": "команда у причала"%s}'
    raw = spark.createDataFrame([(1, payload % ""), (2, payload % ', "language": "uk"')], "raw_arrival_id long, raw_payload string").selectExpr(
        "*", "'s' AS source", "'i' AS source_item_id", "'c' AS collection", "'https://example.com/a' AS url", "timestamp'2024-01-01' AS source_published_at", "timestamp'2024-01-01' AS fetched_at"
    )
    detect = profiles.detector(trained)
    got = normalize(raw, lambda x: detect(x)["lang"]).select("raw_arrival_id", "normalized_language").collect()
    assert dict(map(tuple, got)) == {1: "ru", 2: "uk"}
