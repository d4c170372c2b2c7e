"""F and U queries: gates, filters with their rejections, set operations; streaming's batch parities."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette import fixed
from gazette.functions import dates, scores, text
from gazette.operators import frames, health, joins, model
from gazette.streaming import digest
from gazette.plans.registry import query

P = f"WITH {frames.POSTS} "
S = f"WITH {frames.SCORED} "


@query("f01_entry_projection", P + "SELECT post_id, CASE WHEN trim(regexp_replace(title, '^\\s+|\\s+$', '', 'g')) = '' THEN 'No Title' ELSE regexp_replace(title, '^\\s+|\\s+$', '', 'g') END AS title, link, source FROM posts")
def f01(spark, sf):
    title = F.coalesce(F.nullif(text.trimmed(F.col("title")), F.lit("")), F.lit("No Title"))
    return frames.posts(spark, sf).select("post_id", title.alias("title"), "link", "source")


@query("f02_content_choice", P + "SELECT post_id, CASE WHEN length(summary) < 3000 AND length(content) > length(summary) THEN 'page' ELSE 'feed' END AS chosen, CASE WHEN length(summary) < 3000 AND length(content) > length(summary) THEN length(content) ELSE length(summary) END AS chars FROM (SELECT *, CASE WHEN post_id % 3 = 0 THEN repeat(content, 2) WHEN post_id % 3 = 1 THEN title ELSE content END AS summary FROM posts)")
def f02(spark, sf):
    k, page = F.col("post_id") % 3, F.col("content")
    feed = F.when(k == 0, F.repeat("content", F.lit(2))).when(k == 1, F.col("title")).otherwise(page)
    better = (F.length(feed) < fixed.FULL_SCRAPE_THRESHOLD) & (F.length(page) > F.length(feed))
    return frames.posts(spark, sf).select("post_id", F.when(better, "page").otherwise("feed").alias("chosen"), F.length(F.when(better, page).otherwise(feed)).cast("long").alias("chars"))


@query("f03_date_window", P + "SELECT post_id, link FROM posts WHERE published BETWEEN TIMESTAMP '2024-01-08 23:59:59.999999' AND TIMESTAMP '2024-01-15 23:59:59.999999'")
def f03(spark, sf):
    end = F.lit("2024-01-15").cast("timestamp")
    inside = dates.in_window(F.col("published"), dates.window_start(end, 7), dates.window_end(end))
    return frames.posts(spark, sf).where(inside).select("post_id", "link")


@query("f03_event_window", "SELECT event_id, event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-14 23:59:59.999999'")
def f03_events(spark, sf):
    e = frames.table(spark, sf, "events")
    inside = dates.in_window(F.col("ts"), F.lit("2024-01-08").cast("timestamp"), F.lit("2024-01-14 23:59:59.999999").cast("timestamp"))
    return e.where(inside).select("event_id", "event_type")


@query("f04_fail_closed_dates", P + "SELECT post_id FROM posts WHERE post_id % 4 <> 3")
def f04(spark, sf):
    said = F.when(F.col("post_id") % 4 == 3, "next week").otherwise(F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return frames.posts(spark, sf).where(dates.published(said).isNotNull()).select("post_id")


@query("f05_length_gate", f"WITH {frames.POSTS}, v AS (SELECT post_id, length(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) AS n FROM posts) SELECT post_id, n >= 600 AS kept, CASE WHEN n < 600 THEN 'Insufficient content: ' || n || ' visible chars (minimum 600). Skipped before summarization.' END AS reason FROM v")
def f05(spark, sf):
    plain = frames.posts(spark, sf).withColumn("content", text.escaped(F.col("content")))
    kept, rejected = model.gate(plain)
    return kept.select("post_id", F.lit(True).alias("kept"), F.lit(None).cast("string").alias("reason")).unionByName(rejected.select("post_id", F.lit(False).alias("kept"), "reason"))


@query("f06_empty_content", "SELECT doc_id, 'No content available to evaluate.' AS reason FROM documents WHERE coalesce(text, '') = '' UNION ALL SELECT doc_id, NULL FROM documents WHERE coalesce(text, '') <> ''")
def f06(spark, sf):
    d = frames.table(spark, sf, "documents")
    return d.select("doc_id", F.when(F.coalesce("text", F.lit("")) == "", "No content available to evaluate.").alias("reason"))


RESPONSE = "CASE post_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'abc' WHEN 2 THEN '8.5' WHEN 3 THEN '-1' WHEN 4 THEN '0.7' ELSE '0.65' END"


def response():
    k = F.col("post_id") % 6
    return F.when(k == 1, "abc").when(k == 2, "8.5").when(k == 3, "-1").when(k == 4, "0.7").when(k == 5, "0.65")


@query(
    "f07_score_filter",
    P + f", r AS (SELECT post_id, {RESPONSE} AS said FROM posts), x AS (SELECT post_id, said, CASE WHEN try_cast(said AS double) IS NOT NULL THEN least(1.0::double, greatest(0.0::double, try_cast(said AS double))) END AS score FROM r) SELECT post_id, score, CASE WHEN said IS NULL THEN 'no response' WHEN score IS NULL THEN 'unparseable' WHEN score < 0.7::double THEN 'below' ELSE 'kept' END AS outcome FROM x",
)
def f07(spark, sf):
    said = response()
    score = F.when(said.isNotNull(), scores.score_of(said))
    outcome = F.when(said.isNull(), "no response").when(score.isNull(), "unparseable").when(score < fixed.MIN_SCORE, "below").otherwise("kept")
    return frames.posts(spark, sf).select("post_id", score.alias("score"), outcome.alias("outcome"))


@query("f08_null_responses", P + f"SELECT post_id, 'Filtering failed (no model response).' AS reason FROM posts WHERE {RESPONSE} IS NULL")
def f08(spark, sf):
    return frames.posts(spark, sf).where(response().isNull()).select("post_id", F.lit("Filtering failed (no model response).").alias("reason"))


@query("f09_title_overwrite", P + "SELECT post_id, CASE WHEN post_id % 3 = 0 THEN 'T' || post_id ELSE title END AS title FROM posts")
def f09(spark, sf):
    k = F.col("post_id") % 3
    said = F.when(k == 0, F.concat(F.lit("T"), "post_id")).when(k == 1, "")
    return frames.posts(spark, sf).select("post_id", F.coalesce(F.nullif(said, F.lit("")), "title").alias("title"))


@query("f11_unexpected_sources", f"WITH {frames.HEALTH} SELECT url FROM health WHERE (status = 'failed' OR (status = 'empty' AND candidates = 0)) AND NOT contains(url, 'moved.')")
def f11(spark, sf):
    h = frames.health(spark, sf)
    bad = h.where((F.col("status") == "failed") | health.likely_broken())
    return joins.without_flaky(bad, frames.literal(spark, [("moved.",)], "pattern string")).select("url")


@query("f19_filter_input", P + "SELECT post_id, length(content) AS chars FROM posts WHERE content <> ''")
def f19(spark, sf):
    return frames.posts(spark, sf).where("content <> ''").select("post_id", F.length("content").cast("long").alias("chars"))


@query("f23_summary_present", S + "SELECT source, count(*) FILTER (score >= 0.5::double) AS present, count(*) FILTER (score >= 0.5::double AND lang = 'en') AS other FROM scored GROUP BY source")
def f23(spark, sf):
    has = F.col("score") >= 0.5
    return frames.scored(spark, sf).groupBy("source").agg(F.count_if(has).alias("present"), F.count_if(has & (F.col("lang") == "en")).alias("other"))


@query("src16_run_dates", P + "SELECT strftime(published, '%Y-%m-%d') AS day, count(*) AS posts, max(strftime(published, '%Y-%m-%d')) OVER () = strftime(published, '%Y-%m-%d') AS newest FROM (SELECT date_trunc('day', published) AS published FROM posts) GROUP BY published")
def src16(spark, sf):
    days = frames.posts(spark, sf).groupBy(F.date_format("published", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("posts"))
    newest = days.agg(F.max("day").alias("last"))
    return days.crossJoin(newest).select("day", "posts", (F.col("day") == F.col("last")).alias("newest"))


@query("u01_union_of_sources", P + "SELECT post_id, ord FROM posts WHERE lang = 'en' UNION ALL SELECT post_id, ord FROM posts WHERE lang = 'de' UNION ALL SELECT post_id, ord FROM posts WHERE lang = 'en'")
def u01(spark, sf):
    p = frames.posts(spark, sf)
    part = lambda lang: p.where(F.col("lang") == lang).select("post_id", "ord")
    return part("en").unionByName(part("de")).unionByName(part("en"))


@query("u03_ordered_distinct", P + "SELECT post_id, string_agg(word, ' ' ORDER BY i) AS words FROM (SELECT post_id, word, min(i) AS i FROM (SELECT post_id, unnest(string_split(title, ' ')) AS word, generate_subscripts(string_split(title, ' '), 1) AS i FROM posts) GROUP BY ALL) GROUP BY post_id")
def u03(spark, sf):
    return frames.posts(spark, sf).select("post_id", F.array_join(F.array_distinct(F.split("title", " ")), " ").alias("words"))


@query("u05_missing_sections", P + "SELECT post_id, list_filter(['the', 'and', 'que', 'der'], lambda m: NOT contains(content, ' ' || m || ' ')) AS missing FROM posts")
def u05(spark, sf):
    wanted = F.array(*map(F.lit, ("the", "and", "que", "der")))
    present = F.filter(wanted, lambda m: F.contains(F.col("content"), F.concat(F.lit(" "), m, F.lit(" "))))
    return frames.posts(spark, sf).select("post_id", F.array_except(wanted, present).alias("missing"))


@query("u06_required_present", P + "SELECT post_id, (contains(content, ' the ')::int + contains(content, ' de ')::int) / 2.0::double AS share FROM posts")
def u06(spark, sf):
    wanted = F.array(F.lit("the"), F.lit("de"))
    present = F.filter(F.array(*map(F.lit, ("the", "and", "de"))), lambda m: F.contains(F.col("content"), F.concat(F.lit(" "), m, F.lit(" "))))
    return frames.posts(spark, sf).select("post_id", (F.size(F.array_intersect(wanted, present)) / 2.0).alias("share"))


@query("u07_suppressed_bag", f"WITH {frames.HEALTH} SELECT url FROM health WHERE status = 'failed' UNION ALL SELECT url FROM health WHERE status = 'empty' AND candidates = 0")
def u07(spark, sf):
    h = frames.health(spark, sf)
    return h.where("status = 'failed'").select("url").unionByName(h.where("status = 'empty' AND candidates = 0").select("url"))


@query("u08_rejections_of_stages", S + "SELECT post_id, 'gate' AS stage FROM scored WHERE length(content) < 600 UNION ALL SELECT post_id, 'score' FROM scored WHERE length(content) >= 600 AND score < 0.7::double")
def u08(spark, sf):
    s = frames.scored(spark, sf)
    long = F.length("content") >= fixed.MIN_CONTENT_LENGTH
    gate = s.where(~long).select("post_id", F.lit("gate").alias("stage"))
    return gate.unionByName(s.where(long & (F.col("score") < fixed.MIN_SCORE)).select("post_id", F.lit("score").alias("stage")))


@query("stream_weekly_counts", "SELECT strftime(DATE '2024-01-01' + CAST(7 * (date_diff('day', DATE '2024-01-01', ts::date) // 7) AS INT), '%Y-%m-%d') AS week, event_type, count(*) AS n FROM events GROUP BY ALL")
def weekly(spark, sf):
    e = frames.table(spark, sf, "events")
    weeks = digest.weekly_counts(e.select(F.col("ts").alias("published"), F.col("event_type").alias("source")))
    return weeks.select(F.date_format("week", "yyyy-MM-dd").alias("week"), F.col("source").alias("event_type"), "n")


@query("js01_event_props", "SELECT event_id, (props::json->>'k')::int AS k FROM events")
def js01(spark, sf):
    return frames.table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))
