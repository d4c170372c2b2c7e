"""Column builders on written-out cases."""

import pytest
from pyspark.sql import functions as F

from gazette.functions import dates, scores, text, urls


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame(list(enumerate(inputs)), f"k int, v {kind}")
    return [r.x for r in df.select("k", column(F.col("v")).alias("x")).orderBy("k").collect()]


def test_dates(spark):
    said = ["2026-05-30", "2026-05-30T10:00:00Z", "2026-05-30T12:00:00+0200", "Sat, 30 May 2026 10:00:00 GMT", "Sat, 30 May 2026 12:00:00 +0200", "May 30, 2026", "June 3, 2026", "5/30/2026", "30.5.2026", "not a date", "", None]
    got = values(spark, lambda v: F.date_format(dates.published(v), "yyyy-MM-dd HH"), said)
    assert got == ["2026-05-30 00", "2026-05-30 10", "2026-05-30 10", "2026-05-30 10", "2026-05-30 10", "2026-05-30 00", "2026-06-03 00", "2026-05-30 00", "2026-05-30 00", None, None, None]


def test_title_keys(spark):
    got = values(spark, text.title_key, ["Gemini 3:  Scaling  Up!", "gemini 3 - scaling up", "Straße", "  ", "a_b"])
    assert got == ["gemini 3 scaling up", "gemini 3 scaling up", "strasse", "", "a_b"]


def test_navigation(spark):
    said = ["Next", "Read more", "Next Generation Reasoning Models", "« Back", "2024", "", "PageRank", "the blog"]
    assert values(spark, text.is_nav_text, said) == [True, True, False, True, True, True, False, True]


def test_scores(spark):
    assert values(spark, scores.score_of, ["0.7", "8.5", "-1", "abc", None, "NaN"]) == [0.7, 1.0, 0.0, None, 0.0, 0.0]
    bands = values(spark, scores.band_of, [0.85, 0.72, 0.65, 0.25, 0.0, 0.55, 1.0], "double")
    assert bands == ["high", "strong", "moderate", "reject", "reject", "moderate", "high"]
    assert values(spark, scores.on_grid, [0.85, 0.83, 0.8505, 1.05, -0.05], "double") == [True, False, True, False, False]


def test_safe_urls(spark):
    said = ["https://a.example", "JAVASCRIPT:x", "mailto:a@b.example", "/x", "//x", None, " http://b.example"]
    assert values(spark, urls.is_safe_url, said) == [True, False, True, False, False, False, True]


def test_register_and_quantities(spark):
    assert values(spark, text.plain_register, ["이것은 빠르다. 좋습니다. 끝."]) == [["이것은 빠르다."]]
    assert sorted(values(spark, text.quantities, ["22% 빠르고 8,000토큰, 3.2배. Gemini 3.6, 2 pods"])[0]) == ["22%", "3.2배", "8,000토큰"]


def test_terminal_colons(spark):
    said = ["<p>합니다:</p>", "<p>다음과 같습니다: 첫째</p>", "<p>같습니다:</p>\n<ul><li>x</li></ul>"]
    assert values(spark, text.terminal_colons, said) == [1, 0, 0]
    assert values(spark, text.with_periods, said[:1]) == ["<p>합니다.</p>"]


def test_tight_html(spark):
    assert values(spark, text.tight_html, ["<p>a   b</p>\n   <pre>x\n   y</pre>\n\n<i>c</i>"]) == ["<p>a b</p> <pre>x\n   y</pre> <i>c</i>"]


@pytest.mark.parametrize(("said", "expected"), [("Read the paper", "the paper"), ("read", "read"), ("Blog post link to X", "X"), ("Reading list", "Reading list")])
def test_calls_to_action(spark, said, expected):
    assert values(spark, text.without_call_to_action, [said]) == [expected]


def test_reading_minutes(spark):
    assert values(spark, lambda v: scores.reading_minutes(v, "en"), ["", "word " * 500, "word " * 300]) == [1, 2, 2]
