"""Golden values of the function library."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from storyweft.functions import hashing, lang, scoring, text, timefn, url
from storyweft.sources.items import canonical_json
from storyweft.sources.reader import readable_of


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_url_golden(spark):
    raw = "http://Shop.Tideline.test:80//harbour/guide/?UTM_term=z&gclid=9&z=last&c=3&c=1#map"
    want = "http://shop.tideline.test/harbour/guide?c=1&c=3&z=last"
    assert one(spark, url.canonical_url(F.col("u")), u=raw) == want
    assert url.canonical_of(raw) == (want, "shop.tideline.test")
    for bad in ("harbour guide", "//no.scheme/x", "mailto:", ""):
        assert one(spark, url.canonical_url(F.col("u")), u=bad) == "" and url.canonical_of(bad) == ("", "")
    assert url.canonical_of(None) == ("", "")


@pytest.mark.parametrize("raw", ["http://a.b/", "http://a.b", "https://A.b:8443//x//y/?z#f", "http://u@h.c:80/p/?ref=1&x", "ftp://h/p?b=1&a=2&a=1", "http:///x", ""])
def test_url_forms_agree(spark, raw):
    assert one(spark, url.canonical_url(F.col("u")), u=raw) == url.canonical_of(raw)[0]


def test_url_escapes_are_escaped_again():
    assert url.canonical_of("http://a.b/x%20y?q=a b")[0] == "http://a.b/x%2520y?q=a+b"


def test_jaccards(spark):
    a, b = F.lit("Ferry to the old harbour"), F.lit("old ferry harbour closed")
    assert one(spark, text.token_jaccard(a, b)) == pytest.approx(3 / 6)
    x, y = "tide table", "tide tables"
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    assert one(spark, text.trigram_jaccard(F.lit(x), F.lit(y))) == pytest.approx(len(grams(x) & grams(y)) / len(grams(x) | grams(y)))
    assert one(spark, text.token_jaccard(F.lit(""), b)) == 0 and one(spark, text.trigram_jaccard(F.lit("ab"), F.lit("AB "))) == 1


def test_normalize(spark):
    assert one(spark, text.normalize_text(F.col("t")), t="  A \x07B\t\nÉ ") == "a b é"
    assert one(spark, text.tokens(F.col("t")), t="It's 5-ok_é") == ["it", "s", "5", "ok", "é"]


def test_hamming_and_simhash(spark):
    assert one(spark, hashing.hamming(F.lit(0b101010), F.lit(0b111000))) == 2
    assert one(spark, hashing.fnv1a64(F.lit("a"))) == 0xAF63DC4C8601EC8C - (1 << 64)
    assert one(spark, hashing.fnv1a64(F.lit(""))) == hashing.FNV_BASIS - (1 << 64)
    assert one(spark, hashing.simhash64(F.array(F.lit("a")))) == 0xAF63DC4C8601EC8C - (1 << 64)
    assert one(spark, hashing.simhash64(F.array().cast("array<string>"))) is None


def test_dates(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    now = at("2024-02-10 00:00:00")
    for then, want in ((None, 0.5), ("2024-02-09 00:00:00", 1.0), ("2024-02-05 00:00:00", 0.6), ("2024-01-21 00:00:00", 0.0)):
        assert one(spark, timefn.date_consistency(now, at(then))) == want
    assert one(spark, timefn.within_days(now, at("2024-02-03 00:00:00"), 14)) is True
    assert one(spark, timefn.within_days(now, at("2024-01-10 00:00:00"), 14)) is False
    assert one(spark, timefn.within_days(now, at(None), 14)) is False
    assert one(spark, timefn.parse_any(F.col("d")), d="Tue, 05 Mar 2024 10:00:00 +0100") == dt.datetime(2024, 3, 5, 9)
    assert one(spark, timefn.parse_any(F.col("d")), d="2024-03-05") == dt.datetime(2024, 3, 5)
    for text_, want in (("Tue, 5 Mar 2024 10:00:00 GMT", dt.datetime(2024, 3, 5, 10)), ("5 Mar 2024 10:00:00 +0000", dt.datetime(2024, 3, 5, 10)), ("2024-03-05T10:00:00Z", dt.datetime(2024, 3, 5, 10)), ("2024-03-05T10:00:00.250+02:00", dt.datetime(2024, 3, 5, 8, 0, 0, 250_000)), ("2024-03-05 10:00:00", dt.datetime(2024, 3, 5, 10))):
        assert one(spark, timefn.parse_any(F.col("d")), d=text_) == want, text_
    assert one(spark, timefn.parse_any(F.col("d")), d="soon") is None


def test_thresholds(spark):
    gray = lambda c: one(spark, scoring.gray_zone(F.lit(c)))
    assert (gray(0.90), gray(0.94), gray(0.75)) == (True, False, False)
    auto = lambda c, t: one(spark, scoring.auto_merge(F.lit(c), F.lit(t)))
    assert (auto(0.97, 0.05), auto(0.94, 0.35), auto(0.92, 0.50)) == (True, True, False)
    assert one(spark, scoring.valid_vector(F.array(F.lit(1.0), F.lit(2.0)), 4096)) is False


def test_language(spark):
    iso = lambda x: one(spark, lang.iso_code(F.lit(x)))
    assert [iso(x) for x in ("Pt_BR", " sr-Latn", "suomi", "d3", "")] == ["pt", "sr", "", "", ""]
    tag = lambda x: one(spark, lang.language_tag(F.lit(x)))
    assert [tag(x) for x in ("\tPt_BR", "sr_Latn-RS", "-nb--NO-", "es-419", "_")] == ["pt-br", "sr-latn-rs", "nb-no", "", ""]
    found = lambda x: one(spark, lang.detect_language(F.lit(x)))
    assert found("The ferry was late for the tide, and that is why it is at the pier") == "en"
    assert found("Die Fähre ist mit der Flut zu spät, und sie liegt nicht auf See") == "de"
    assert found("a b c") == "und"


def test_language_of_the_whole_text(spark):
    found = lambda x: one(spark, lang.detect_language(F.lit(x)))
    assert found("12 34 " * 2000 + "the launch of the drone") == "en"
    assert found("the " + "4711 " * 20_000 + "der Start der Drohne und die Firma") == "de"
    assert found("1 " * 5000 + "ab") == "und"


def test_clean_and_truncate(spark):
    raw = "\r\n high  tide\r\n\t\r\nat\u00a0noon \n\n\n  low tide\n"
    assert one(spark, text.clean_text(F.lit(raw))) == "high tide\n\nat noon\n\nlow tide"
    cut = lambda t, n: one(spark, text.truncate_text(F.lit(t), n))
    assert cut("harbour wall", 9) == "harbour…" and cut("harbour", 7) == "harbour" and cut(" pier ", 4) == "pier" and cut("ééééé", 3) == "éé…"
    assert one(spark, text.truncated(F.lit("harbour"), 6)) is True
    assert one(spark, text.embedding_input(F.lit(" "), F.lit("b"))) == "b"


def test_a_cut_at_a_paragraph_leaves_no_line_ends(spark):
    assert one(spark, text.truncate_text(F.lit("low tide\n\nhigh tide"), 11, " \n")) == "low tide…"
    assert one(spark, text.truncate_text(F.lit("low tide\n\nhigh tide"), 11)) == "low tide\n\n…"


def test_ampersands_only(spark):
    of = lambda t: one(spark, text.plain_text(F.col("t"), ampersands_only=True), t=t)
    assert of("a &amp;&amp; b &&amp") == "a && b &&amp" and of("&quot;x&quot;") == "&quot;x&quot;" and of("&amp;lt;") == "&lt;" and of(None) is None


def test_canonical_json():
    assert canonical_json('{"b": 1.10, "a": [1e3, "<&>", {"z": null, "y": true}]}') == '{"a":[1e3,"\\u003c\\u0026\\u003e",{"y":true,"z":null}],"b":1.10}'
    assert canonical_json("{} {}") is None


def test_unescape(spark):
    assert one(spark, text.plain_text(F.col("t")), t="<p>Fish &amp; chips &lt;3 &#39;x&#39;</p>") == "Fish & chips <3 'x'"
    assert one(spark, text.plain_text(F.col("t")), t=None) is None


def test_readable():
    assert readable_of("<html><nav>menu</nav><p>One &amp; two</p><script>x</script><div>three</div></html>") == "One & two\n\nthree"
    assert readable_of(None) is None


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=12), min_size=1, max_size=20))
def test_fnv_forms_agree(spark, words):
    words = [w.encode("utf-8", "ignore").decode() for w in words]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", hashing.fnv1a64(F.col("w")).alias("h")).collect()
    def plain(word):
        h = hashing.FNV_BASIS
        for b in word.encode():
            h = (h ^ b) * hashing.FNV_PRIME % (1 << 64)
        return h

    assert {r.w: r.h & (1 << 64) - 1 for r in got} == {w: plain(w) for w in words}
    assert hashing.fnv_words([w.encode() for w in words]).tolist() == [plain(w) for w in words]


def test_arguments(spark):
    from storyweft.plans import arguments as a

    assert a.bounded(None, a.PAGE) == 1 and a.bounded("200", a.SIZE) == 200 and a.bounded("", a.DAYS) == 30
    for bad, limits in ((0, a.PAGE), (201, a.SIZE), ("x", a.DAYS)):
        with pytest.raises(ValueError):
            a.bounded(bad, limits)
    assert a.time_filter(F.col("x")) is None and a.time_filter(F.col("x"), day="2024-01-01", text="q") is None
    assert a.time_filter(F.col("x"), day="2024-01-01") is not None and a.same(F.col("x"), "") is None


def test_labels(spark):
    assert one(spark, url.source_label(F.lit("https://www.Example.com/x"), F.lit(0))) == "example.com"
    assert one(spark, url.source_label(F.lit("https://example.com"), F.lit(2))) == "example.com and 2 others"
    day = lambda d: one(spark, timefn.relative_day(F.lit(d).cast("date"), F.lit("2024-02-10").cast("date")))
    assert [day(d) for d in ("2024-02-10", "2024-02-09", "2024-02-11", "2024-02-07", "2024-02-20", "2022-01-01")] == ["today", "yesterday", "tomorrow", "3 days ago", "in 1 week", "2 years ago"]
    assert one(spark, text.truncate_cell(F.lit("abcdef"), 5)) == "ab..." and one(spark, text.truncate_cell(F.lit("abcdef"), 3)) == "abc"
