"""T, F, D, M, H and URL queries: scalar functions over the provided tables and over written-out cases."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from gazette import fixed
from gazette.functions import dates, scores, text, urls
from gazette.operators import alerts, frames
from gazette.plans.ranking import TITLE_KEY
from gazette.plans.registry import query

P = f"WITH {frames.POSTS} "
S = f"WITH {frames.SCORED} "
STAMP = "yyyy-MM-dd HH:mm:ss"


def cases(*values: str) -> str:
    """A VALUES list of texts for an oracle."""
    return ", ".join("(" + str(k) + ", " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") + ")" for k, v in enumerate(values))


def case_frame(spark, values):
    return frames.literal(spark, list(enumerate(values)), "k int, v string")


@query("t01_title_key", P + f"SELECT post_id, {TITLE_KEY} AS title_key FROM posts")
def t01(spark, sf):
    return frames.posts(spark, sf).select("post_id", text.title_key(F.col("title")).alias("title_key"))


@query("t02_plain_spaces", P + "SELECT post_id, replace(replace(replace(title, ' ', chr(160)), chr(8239), ' '), chr(160), ' ') AS title FROM posts")
def t02(spark, sf):
    spaced = F.translate("title", " ", " ")
    return frames.posts(spark, sf).select("post_id", text.plain_spaces(spaced).alias("title"))


@query("t03_comma_tags", P + "SELECT post_id, array_to_string(list_filter(list_transform(string_split(content, ','), lambda x: trim(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), lambda x: x <> ''), '|') AS tags FROM posts")
def t03(spark, sf):
    return frames.posts(spark, sf).select("post_id", F.array_join(text.tags_of(F.col("content")), "|").alias("tags"))


@query(
    "t04_validated_tags",
    "WITH c(k, v) AS (VALUES " + cases("a, b, a", "", None, " , ,", "x,y,z,u,v,w", "b,a") + "), t AS (SELECT k, list_filter(list_transform(string_split(coalesce(v, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS tags FROM c), d AS (SELECT k, list_filter(list_transform(range(1, len(tags) + 1), lambda i: CASE WHEN list_position(tags, tags[i]) = i THEN tags[i] END), lambda x: x IS NOT NULL) AS tags FROM t) SELECT k, CASE WHEN len(tags) = 0 THEN 'uncategorized' ELSE array_to_string(tags[1:5], '|') END AS tags FROM d",
)
def t04(spark, sf):
    return case_frame(spark, ("a, b, a", "", None, " , ,", "x,y,z,u,v,w", "b,a")).select("k", F.array_join(text.first_tags(text.tags_of(F.col("v"))), "|").alias("tags"))


URL_CASES = ("https://a.example/x?y=1&z=2", "HTTP://B.example", "javascript:alert(1)", "mailto:me@c.example", "//d.example/x", "/e", "", " https://f.example/g ", "data:text/html,x", "ftp://h.example", "ht tp://i")


@query("f13_safe_url", "WITH c(k, v) AS (VALUES " + cases(*URL_CASES) + ") SELECT k, lower(regexp_extract(trim(v), '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('http', 'https', 'mailto') AS safe FROM c")
def f13(spark, sf):
    return case_frame(spark, URL_CASES).select("k", urls.is_safe_url(F.col("v")).alias("safe"))


@query(
    "t05_safe_links",
    P + "SELECT post_id, '<a href=\"' || link || '?a=1&amp;b=2\">' || replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;') || '</a>' AS anchor FROM (SELECT post_id, link, regexp_replace(title, '^\\s+|\\s+$', '', 'g') AS title FROM posts)",
)
def t05(spark, sf):
    return frames.posts(spark, sf).select("post_id", text.anchor(F.concat("link", F.lit("?a=1&b=2")), F.col("title")).alias("anchor"))


@query("t06_source_label", P + "SELECT DISTINCT source || '_blog' AS source, upper(left(source, 1)) || substr(source, 2) || ' Blog' AS label FROM posts UNION ALL SELECT 'unknown', ''")
def t06(spark, sf):
    named = frames.posts(spark, sf).select(F.concat("source", F.lit("_blog")).alias("source")).distinct().unionByName(frames.literal(spark, [("unknown",)], "source string"))
    return named.select("source", text.source_label(F.col("source")).alias("label"))


@query("t07_post_filename", P + "SELECT post_id, source || '-' || replace(regexp_replace(lower(title), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), ' ', '_') || '-' || left(sha1(link), 8) || '.json' AS file FROM posts")
def t07(spark, sf):
    return frames.posts(spark, sf).select("post_id", text.post_filename(F.col("title"), F.col("source"), F.col("link")).alias("file"))


@query("t12_phrase_counts", P + "SELECT post_id, (length(content) - length(replace(content, 'the ', ''))) // 4 AS n, contains(content, 'tion') AS has, starts_with(content, 'Th') AS opens FROM posts")
def t12(spark, sf):
    c = F.col("content")
    return frames.posts(spark, sf).select("post_id", text.occurrences(c, "the ").cast("long").alias("n"), c.contains("tion").alias("has"), c.startswith("Th").alias("opens"))


@query("t13_slug", P + "SELECT post_id, regexp_replace(regexp_replace(title, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM posts")
def t13(spark, sf):
    return frames.posts(spark, sf).select("post_id", text.slug(F.col("title")).alias("slug"))


@query("t14_ledger_keys", P + "SELECT DISTINCT ltrim('/ledger/dev/' || strftime(published, '%Y-%m-%d') || '/' || lang || '.json', '/') AS key FROM posts")
def t14(spark, sf):
    day = F.date_format("published", "yyyy-MM-dd")
    key = F.regexp_replace(F.concat(F.lit("/ledger/dev/"), day, F.lit("/"), "lang", F.lit(".json")), "^/+", "")
    return frames.posts(spark, sf).select(key.alias("key")).distinct()


@query("t15_greeting_measure", P + "SELECT post_id, length(regexp_replace(title, '^\\s+|\\s+$', '', 'g')) AS ko, len(list_filter(regexp_split_to_array(title, '\\s+'), lambda w: w <> '')) AS en FROM posts")
def t15(spark, sf):
    words = F.size(F.filter(F.split("title", r"(?U)\s+"), lambda w: w != ""))
    return frames.posts(spark, sf).select("post_id", F.length(text.trimmed(F.col("title"))).cast("long").alias("ko"), words.cast("long").alias("en"))


@query("t17_subject", P + "SELECT post_id, '[' || strftime(published, '%Y-%m-%d') || '] ' || title AS subject FROM posts")
def t17(spark, sf):
    return frames.posts(spark, sf).select("post_id", F.format_string("[%s] %s", F.date_format("published", "yyyy-MM-dd"), "title").alias("subject"))


@query(
    "f14_nav_text",
    P
    + r"""SELECT post_id, contains(lower(title), '«') OR contains(lower(title), '»') OR len(list_filter(regexp_extract_all(replace(lower(title), 'ß', 'ss'), '\p{L}+'), lambda w: NOT list_contains([NAV], w))) = 0 AS nav
FROM (SELECT post_id, CASE WHEN post_id % 5 = 0 THEN 'Read more ' || left(title, 3) WHEN post_id % 5 = 1 THEN '« ' || title WHEN post_id % 5 = 2 THEN 'Next 12' ELSE title END AS title FROM posts)""".replace("NAV", ", ".join(f"'{w}'" for w in fixed.NAV_WORDS + fixed.TITLE_STOPWORDS)),
)
def f14(spark, sf):
    k = F.col("post_id") % 5
    title = F.when(k == 0, F.concat(F.lit("Read more "), F.left("title", F.lit(3)))).when(k == 1, F.concat(F.lit("« "), "title")).when(k == 2, "Next 12").otherwise(F.col("title"))
    return frames.posts(spark, sf).select("post_id", text.is_nav_text(title).alias("nav"))


@query("f17_null_default", "SELECT item_id, coalesce(CASE WHEN item_id % 3 = 0 THEN NULL ELSE item_id END, -1) AS value, coalesce(CASE WHEN item_id % 2 = 0 THEN NULL ELSE text END, 'none') AS said FROM benchmark")
def f17(spark, sf):
    b = frames.table(spark, sf, "benchmark")
    return b.select("item_id", F.coalesce(F.when(F.col("item_id") % 3 != 0, F.col("item_id")), F.lit(-1)).alias("value"), F.coalesce(F.when(F.col("item_id") % 2 != 0, F.col("text")), F.lit("none")).alias("said"))


KOREAN = ("한국어 문장입니다", "plain English", "", "mostly English 한글", "a 가 b c d e f g h i j k", "가나다 GPU 3.2배")


@query("f18_is_korean", "WITH c(k, v) AS (VALUES " + cases(*KOREAN) + "), n AS (SELECT k, length(regexp_replace(v, '\\s', '', 'g')) AS d, len(regexp_extract_all(v, '[가-힣]')) AS h FROM c) SELECT k, CASE WHEN d = 0 THEN false ELSE h::double / d >= 0.1::double END AS korean FROM n")
def f18(spark, sf):
    return case_frame(spark, KOREAN).select("k", text.is_korean(F.col("v")).alias("korean"))


NULLS = ("null", "NULL", "Null", "a b", "", "x")


@query("f21_null_sentinel", "WITH c(k, v) AS (VALUES " + cases(*NULLS) + ") SELECT k, CASE WHEN lower(v) = 'null' THEN NULL ELSE replace(v, ' ', ',') END AS value FROM c")
def f21(spark, sf):
    v = F.col("v")
    return case_frame(spark, NULLS).select("k", F.when(F.lower(v) != "null", F.replace(v, F.lit(" "), F.lit(","))).alias("value"))


DAYS = ("2024-01-31", "2024-02-30", "2024-1-3", "", "null", "NULL", "today", "2024-02-29", "2023-02-29")


@query("f22_valid_day", "WITH c(k, v) AS (VALUES " + cases(*DAYS) + ") SELECT k, v = '' OR lower(v) = 'null' OR (regexp_full_match(v, '\\d{4}-\\d{2}-\\d{2}') AND try_strptime(v, '%Y-%m-%d') IS NOT NULL) AS valid FROM c")
def f22(spark, sf):
    return case_frame(spark, DAYS).select("k", dates.is_valid_day(F.col("v")).alias("valid"))


CRONS = ("cron(0 9 ? * MON *)", "cron(0 9 * *)", "rate(7 days)", "cron(0 0 1 1 ? 2024)", " cron(0 9 ? * MON *)")


@query("f24_cron", "WITH c(k, v) AS (VALUES " + cases(*CRONS) + ") SELECT k, regexp_full_match(v, 'cron\\((?:\\S+\\s+){5}\\S+\\)') AS valid FROM c")
def f24(spark, sf):
    return case_frame(spark, CRONS).select("k", F.col("v").rlike(r"^cron\((?:\S+\s+){5}\S+\)$").alias("valid"))


@query("url02_host", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', '') AS host FROM pages")
def url02(spark, sf):
    return frames.table(spark, sf, "pages").select("page_id", urls.host(F.col("url")).alias("host"))


@query("d10_parse_dates", P + "SELECT post_id, strftime(published, '%Y-%m-%d') || CASE post_id % 8 WHEN 5 THEN ' 00:00:00' WHEN 6 THEN ' 00:00:00' WHEN 7 THEN NULL ELSE ' ' || strftime(published, '%H:%M:%S') END AS parsed FROM posts")
def d10(spark, sf):
    k, at = F.col("post_id") % 8, F.col("published")
    said = (
        F.when(k == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 1, F.concat(F.lit("Tue, "), F.date_format(at, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
        .when(k == 2, F.concat(F.lit("Wed, "), F.date_format(at + F.expr("INTERVAL 2 HOURS"), "dd MMM yyyy HH:mm:ss"), F.lit(" +0200")))
        .when(k == 3, F.date_format(at, STAMP))
        .when(k == 4, F.date_format(at - F.expr("INTERVAL 5 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'-0500'"))
        .when(k == 5, F.date_format(at, "MMM d, yyyy"))
        .when(k == 6, F.date_format(at, "MMMM dd, yyyy"))
        .otherwise("some day")
    )
    return frames.posts(spark, sf).select("post_id", F.date_format(dates.published(said), STAMP).alias("parsed"))


@query("d12_entry_date", P + "SELECT post_id, CASE WHEN post_id % 3 <> 0 THEN 'p' || post_id WHEN post_id % 2 = 0 THEN 'u' || post_id ELSE '' END AS said FROM posts")
def d12(spark, sf):
    i = F.col("post_id")
    first = F.when(i % 3 != 0, F.concat(F.lit("p"), i)).when(i % 4 == 0, "")
    second = F.when(i % 2 == 0, F.concat(F.lit("u"), i))
    return frames.posts(spark, sf).select("post_id", dates.entry_date_text(first, second).alias("said"))


@query("d13_week_window", P + "SELECT post_id, strftime(date_trunc('day', published) + INTERVAL '23 hours 59 minutes 59 seconds', '%Y-%m-%d %H:%M:%S') AS last, strftime(date_trunc('day', published) + INTERVAL '23 hours 59 minutes 59 seconds' - INTERVAL 7 DAYS, '%Y-%m-%d %H:%M:%S') AS first FROM posts")
def d13(spark, sf):
    at = F.col("published")
    return frames.posts(spark, sf).select("post_id", F.date_format(dates.window_end(at), STAMP).alias("last"), F.date_format(dates.window_start(at, 7), STAMP).alias("first"))


@query("d14_day_text", P + "SELECT post_id, CASE WHEN post_id % 4 = 3 THEN NULL ELSE strftime(published, '%Y-%m-%d') END AS day FROM posts")
def d14(spark, sf):
    k, at = F.col("post_id") % 4, F.col("published")
    said = F.when(k == 0, F.date_format(at, "yyyy-MM-dd")).when(k == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+0000'")).when(k == 2, F.concat(F.lit("Fri, "), F.date_format(at, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise("?")
    return frames.posts(spark, sf).select("post_id", dates.day_text(said).alias("day"))


@query("d15_stamps", P + "SELECT post_id, strftime(published, '%Y%m%d%H%M%S') AS job, strftime(published, '%Y-%m-%d') AS day FROM posts")
def d15(spark, sf):
    return frames.posts(spark, sf).select("post_id", F.date_format("published", "yyyyMMddHHmmss").alias("job"), F.date_format("published", "yyyy-MM-dd").alias("day"))


RESPONSES = ("0.7", "8.5", "-1", "abc", None, "NaN", "1", "", "0.6999")


@query("m01_clamped_score", "WITH c(k, v) AS (VALUES " + cases(*RESPONSES) + ") SELECT k, CASE WHEN v IS NULL THEN 0.0::double WHEN isnan(try_cast(v AS double)) THEN 0.0::double ELSE least(1.0::double, greatest(0.0::double, try_cast(v AS double))) END + CASE WHEN v IS NOT NULL AND try_cast(v AS double) IS NULL THEN NULL ELSE 0 END AS score FROM c")
def m01(spark, sf):
    return case_frame(spark, RESPONSES).select("k", scores.score_of(F.col("v")).alias("score"))


ANCHORS = "[" + ", ".join(f"{{'a': {a}::double, 'b': '{b}'}}" for a, b in fixed.ANCHOR_BANDS) + "]"
BAND = f"list_sort(list_transform({ANCHORS}, lambda anchor: {{'d': round(abs(VALUE - anchor.a), 6), 'a': anchor.a, 'b': anchor.b}}))[1].b"


@query("m02_on_grid", S + "SELECT post_id, x BETWEEN 0 AND 1 AND abs(x - round_even(x / 0.05::double, 0) * 0.05::double) <= 0.001::double AS grid FROM (SELECT post_id, score + CASE WHEN post_id % 4 = 0 THEN 0.02::double WHEN post_id % 4 = 1 THEN 0.0005::double ELSE 0 END AS x FROM scored)")
def m02(spark, sf):
    k = F.col("post_id") % 4
    x = F.col("score") + F.when(k == 0, 0.02).when(k == 1, 0.0005).otherwise(0.0)
    return frames.scored(spark, sf).select("post_id", scores.on_grid(x).alias("grid"))


@query("m03_band", S + f"SELECT post_id, {BAND.replace('VALUE', 'score')} AS band FROM scored")
def m03(spark, sf):
    return frames.scored(spark, sf).select("post_id", scores.band_of(F.col("score")).alias("band"))


@query("m04_anchor_score", f"WITH g AS (SELECT i / 20.0::double AS x FROM range(21) AS t(i)), b AS (SELECT x, {BAND.replace('VALUE', 'x')} AS band FROM g) SELECT n.band, coalesce(max(x), 0.0::double) AS score FROM (VALUES ('high'), ('strong'), ('moderate'), ('weak'), ('reject'), ('odd')) AS n(band) LEFT JOIN b ON b.band = n.band GROUP BY n.band")
def m04(spark, sf):
    names = frames.literal(spark, [(b,) for b in ("high", "strong", "moderate", "weak", "reject", "odd")], "band string")
    return names.select("band", scores.anchor_score(F.col("band")).alias("score"))


@query("m05_reading_minutes", P + "SELECT post_id, greatest(1, round_even(len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) / 200.0::double, 0)::int) AS en, greatest(1, round_even(length(content) / 450.0::double, 0)::int) AS ko FROM posts")
def m05(spark, sf):
    c = F.col("content")
    return frames.posts(spark, sf).select("post_id", scores.reading_minutes(c, "en").alias("en"), scores.reading_minutes(c, "ko").alias("ko"))


MEASURES = f"""{frames.POSTS}, m AS (
  SELECT post_id, n_chars AS length, post_id % 3 AS required_sections, post_id % 2 AS subheads, post_id % 5 // 4 AS absence_filler, post_id % 7 AS plain_sentences, post_id % 9 // 8 AS terminal_colons,
         post_id % 4 AS repeated, post_id % 40 AS quantity_count, post_id % 3 AS code_blocks, post_id % 2 AS tables, post_id % 6 // 5 AS closings, length(title) AS lede_length, post_id % 3 AS lede_sentences,
         post_id % 10 = 0 AS lede_banned, post_id % 4 AS images, post_id % 4 // 2 AS captioned, post_id % 13 AS translationese_hits, post_id % 6 AS cliche_hits FROM posts)"""


def measures(spark, sf):
    i = F.col("post_id")
    rows = {
        "length": F.col("n_chars"), "required_sections": i % 3, "subheads": i % 2, "absence_filler": F.floor(i % 5 / 4), "plain_sentences": i % 7, "terminal_colons": F.floor(i % 9 / 8),
        "repeated": i % 4, "quantity_count": i % 40, "code_blocks": i % 3, "tables": i % 2, "closings": F.floor(i % 6 / 5), "lede_length": F.length("title"), "lede_sentences": i % 3,
        "lede_banned": i % 10 == 0, "images": i % 4, "captioned": F.floor(i % 4 / 2), "translationese_hits": i % 13, "cliche_hits": i % 6,
    }
    return frames.posts(spark, sf).select("post_id", *[c.alias(k) for k, c in rows.items()])


def density_sql(hits, band):
    return f"CASE WHEN length = 0 THEN 0.0::double WHEN 1000 * {hits} / length::double <= {band[0]} THEN 1.0::double ELSE greatest(0.0::double, 1 - (1000 * {hits} / length::double - {band[0]}) / ({band[1]} - {band[0]})::double) END"


RUBRIC = f"""SELECT post_id,
  CASE WHEN length BETWEEN 4000 AND 6000 THEN 1.0::double ELSE greatest(0.0::double, 1 - CASE WHEN length < 4000 THEN 4000 - length ELSE length - 6000 END / 4000.0::double) END AS length,
  greatest(0.0::double, required_sections / 2.0::double - 0.25::double * subheads - 0.25::double * absence_filler) AS structure,
  greatest(0.0::double, 1 - 0.2::double * plain_sentences) AS register,
  CASE WHEN terminal_colons = 0 THEN 1.0::double ELSE 0.0::double END AS terminal_colon,
  greatest(0.0::double, 1 - 0.2::double * repeated) AS distinctiveness,
  CASE WHEN length = 0 THEN 0.0::double ELSE least(1.0::double, 0.7::double * least(1.0::double, 1000 * quantity_count / length::double / 6.0::double) + 0.3::double * least(1.0::double, 0.5::double * (code_blocks + tables))) END AS specificity,
  CASE WHEN closings = 0 THEN 1.0::double ELSE 0.0::double END AS boilerplate,
  CASE WHEN lede_length = 0 THEN 0.0::double ELSE greatest(0.0::double, 1.0::double - CASE WHEN lede_length BETWEEN 40 AND 100 THEN 0.0::double ELSE 0.4::double END - CASE WHEN lede_sentences = 1 THEN 0.0::double ELSE 0.3::double END - CASE WHEN lede_banned THEN 0.3::double ELSE 0.0::double END) END AS lede,
  CASE WHEN images = 0 THEN 1.0::double ELSE captioned / images::double END AS caption,
  {density_sql("translationese_hits", fixed.TRANSLATIONESE_BAND)} AS translationese,
  {density_sql("cliche_hits", fixed.CLICHE_BAND)} AS cliche FROM m"""
ROUNDED = ", ".join(f"round({d}, 6) AS {d}" for d in fixed.DIMENSIONS)


@query("m06_rubric_scores", f"WITH {MEASURES}, r AS ({RUBRIC}) SELECT post_id, {ROUNDED} FROM r")
def m06(spark, sf):
    m = measures(spark, sf)
    found = scores.rubric({c: F.col(c) for c in m.columns if c != "post_id"})
    return m.select("post_id", *[F.round(x, 6).alias(k) for k, x in found.items()])


@query("m14_retry_delay", "WITH c(k, v) AS (VALUES " + cases("5", "100", None, "soon", "0") + ") SELECT k, CASE WHEN regexp_full_match(coalesce(v, ''), '\\d+') THEN least(30.0::double, v::double) ELSE pow(2.0::double, k) + 0.1::double * (k + 1) END AS delay, least(120.0::double, 30 * pow(2.0::double, k)) AS model FROM c")
def m14(spark, sf):
    return case_frame(spark, ("5", "100", None, "soon", "0")).select("k", scores.retry_delay(F.col("k"), F.col("v")).alias("delay"), scores.backoff(F.col("k")).alias("model"))


@query("m15_greeting_choice", P + "SELECT post_id, CASE WHEN d BETWEEN 100 AND 150 THEN 'draft' WHEN greatest(100 - r, r - 150, 0) < greatest(100 - d, d - 150, 0) THEN 'revision' ELSE 'draft' END AS choice FROM (SELECT post_id, n_chars % 300 AS d, n_chars % 170 AS r FROM posts)")
def m15(spark, sf):
    draft, revision = F.col("n_chars") % 300, F.col("n_chars") % 170
    better = scores.band_distance(revision, 100, 150) < scores.band_distance(draft, 100, 150)
    return frames.posts(spark, sf).select("post_id", F.when(draft.between(100, 150), "draft").when(better, "revision").otherwise("draft").alias("choice"))


@query("m16_cache_can_hit", "WITH c(k, v) AS (VALUES " + cases(None, "5", "10", "11", "40") + ") SELECT k, v IS NULL OR v::int > 10 AS can_hit FROM c")
def m16(spark, sf):
    return case_frame(spark, (None, "5", "10", "11", "40")).select("k", (F.col("v").isNull() | F.coalesce(F.col("v").cast("int") > 10, F.lit(False))).alias("can_hit"))


@query("a30_issue_size", "SELECT page_id, strlen(html) AS bytes, round(strlen(html) / 1024.0::double, 6) AS kb, round(100 * strlen(html) / 102400.0::double, 6) AS share, strlen(html) > 102400 AS clipped FROM pages")
def a30(spark, sf):
    size = F.octet_length("html")
    return frames.table(spark, sf, "pages").select("page_id", size.cast("long").alias("bytes"), F.round(size / 1024.0, 6).alias("kb"), F.round(scores.share_of_clip(size), 6).alias("share"), (size > fixed.CLIP_BYTES).alias("clipped"))


@query("h16_call_to_action", P + "SELECT post_id, regexp_replace(v, '^\\s*(?:read|view|see|open|go\\s+to|learn\\s+more\\s+about|(?:blog\\s+)?post\\s+link\\s+to)\\s+(\\S)', '\\1', 'i') AS name FROM (SELECT post_id, CASE post_id % 4 WHEN 0 THEN 'Read ' WHEN 1 THEN '  go  to ' WHEN 2 THEN 'Blog post link to ' ELSE '' END || title AS v FROM posts)")
def h16(spark, sf):
    k = F.col("post_id") % 4
    said = F.concat(F.when(k == 0, "Read ").when(k == 1, "  go  to ").when(k == 2, "Blog post link to ").otherwise(""), "title")
    return frames.posts(spark, sf).select("post_id", text.without_call_to_action(said).alias("name"))


@query("h19_escape", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;') AS safe FROM pages")
def h19(spark, sf):
    return frames.table(spark, sf, "pages").select("page_id", text.escaped(F.col("html")).alias("safe"))


@query("h13_tag_content", "SELECT page_id, nullif(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^\\s+|\\s+$', '', 'g'), '') AS title, nullif(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '^\\s+|\\s+$', '', 'g'), '') AS heading, nullif(regexp_extract(html, '(?is)<score[^>]*>(.*?)</score>', 1), '') AS score FROM pages")
def h13(spark, sf):
    html = F.col("html")
    return frames.table(spark, sf, "pages").select("page_id", text.tag_content(html, "title").alias("title"), text.tag_content(html, "h1").alias("heading"), text.tag_content(html, "score").alias("score"))


def regex_text_sql(html):
    out = f"regexp_replace({html}, '(?is)<(script|style)\\b[^>]*>.*?</(script|style)\\s*>', ' ', 'g')"
    out = f"regexp_replace(regexp_replace({out}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    for name, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{plain}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


@query("h01_regex_text", f"SELECT page_id, {regex_text_sql('html')} AS visible, length({regex_text_sql('html')}) AS chars FROM pages")
def h01(spark, sf):
    seen = frames.table(spark, sf, "pages").select("page_id", text.regex_text(F.col("html")).alias("visible"))
    return seen.withColumn("chars", F.length("visible").cast("long"))


@query("snk03_file_names", P + "SELECT DISTINCT 'newsletter-dev-' || strftime(published, '%Y-%m-%d') || '-' || lang || '.html' AS file FROM posts")
def snk03(spark, sf):
    return frames.posts(spark, sf).select(F.concat_ws("-", F.lit("newsletter-dev"), F.date_format("published", "yyyy-MM-dd"), F.concat("lang", F.lit(".html"))).alias("file")).distinct()


@query("snk09_page_offsets", "SELECT page_id, unnest(range(0, greatest(length(html), 1), 1950)) AS top FROM pages")
def snk09(spark, sf):
    height = F.greatest(F.length("html"), F.lit(1)).cast("long")
    return frames.table(spark, sf, "pages").select("page_id", F.explode(F.sequence(F.lit(0).cast("long"), height - 1, F.lit(fixed.PAGE_STEP).cast("long"))).alias("top"))


@query("f30_alarm_rows", P + "SELECT source AS event, '[gazette] ' || source || ' — ALERT' AS subject, source || ' ALERT' || chr(10) || chr(10) || 'Source: ' || source || chr(10) || 'Posts:  ' || count(*) || chr(10) || chr(10) || 'Titles:' || chr(10) || min(title) || chr(10) || max(title) || chr(10) || chr(10) || '— 2024-01-31 04:12:00 UTC' AS message FROM posts GROUP BY source")
def f30(spark, sf):
    n = frames.posts(spark, sf).groupBy("source").agg(F.count(F.lit(1)).cast("string").alias("n"), F.concat_ws("\n", F.min("title"), F.max("title"), F.lit("")).alias("titles"))
    said = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(name).alias("field"), F.col(c).alias("value")) for k, (name, c) in enumerate((("Source", "source"), ("Titles", "titles"), ("Posts", "n")))])
    fields = n.select(F.col("source").alias("event"), F.lit("ALERT").alias("status"), F.explode(said).alias("x")).select("event", "status", "x.*")
    return alerts.alarms(fields, "gazette", F.lit("2024-01-31 04:12:00").cast("timestamp")).drop("status")


@query("t08_sentences", P + "SELECT post_id, len(list_filter(string_split(regexp_replace(content, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13)) <> '')) AS sentences FROM posts")
def t08(spark, sf):
    return frames.posts(spark, sf).select("post_id", F.size(text.sentences(F.col("content"))).cast("long").alias("sentences"))


def once(values: str) -> str:
    """SQL for a list without repeats, in order of first places."""
    return f"list_filter(list_transform(range(1, len({values}) + 1), lambda i: CASE WHEN list_position({values}, {values}[i]) = i THEN {values}[i] END), lambda x: x IS NOT NULL)"


def consuming(pattern: str) -> str:
    """A pattern of the fixed values without looking around, as an SQL text: it matches where the other does."""
    return "'" + re.sub(r"\(\?<?=([^()]*)\)", r"(?:\1)", pattern).replace("'", "''") + "'"


def marked(markers: dict[str, str]) -> str:
    said = ", ".join(f"CASE WHEN regexp_matches(said, {consuming(x)}) THEN '{name}' END" for name, x in markers.items())
    return f"array_to_string(list_filter([{said}], lambda x: x IS NOT NULL), '|')"


@query("t10_quantities", P + f", q AS (SELECT post_id, list_transform(regexp_extract_all(content || ' 22% of ' || post_id || ' GB, ' || post_id % 7 || '.5x and 2 pods', {consuming(fixed.MEASURED)}), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))) AS v FROM posts) SELECT post_id, array_to_string({once('v')}, '|') AS found FROM q")
def t10(spark, sf):
    said = F.concat("content", F.lit(" 22% of "), "post_id", F.lit(" GB, "), F.col("post_id") % 7, F.lit(".5x and 2 pods"))
    return frames.posts(spark, sf).select("post_id", F.array_join(text.quantities(said), "|").alias("found"))


MARKED = (" 이 방법을 통해 다양한 것이", " 제공합니다, 개발자들이 보는 것은", " 단순히 도구가 아니라 결론적으로 인상적인", "")


@query("t11_marker_hits", P + ", m AS (SELECT post_id, content || [" + ", ".join(f"'{x}'" for x in MARKED) + f"][1 + post_id % 4] AS said FROM posts) SELECT post_id, {marked(fixed.TRANSLATIONESE)} AS translationese, {marked(fixed.CLICHES)} AS cliches FROM m")
def t11(spark, sf):
    said = F.concat("content", F.element_at(F.array(*map(F.lit, MARKED)), (1 + F.col("post_id") % 4).cast("int")))
    rows = frames.posts(spark, sf).select("post_id", text.marker_counts(said, fixed.TRANSLATIONESE).alias("translationese"), text.marker_counts(said, fixed.CLICHES).alias("cliches"))
    return rows.select("post_id", F.array_join(F.map_keys("translationese"), "|").alias("translationese"), F.array_join(F.map_keys("cliches"), "|").alias("cliches"))
