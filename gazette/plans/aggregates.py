"""A, C, F-10, F-25, SNK-07/08 queries: health, evaluation, reports, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette import fixed
from gazette.functions import scores, text
from gazette.operators import alerts, evalmetrics, frames, health
from gazette.plans.registry import query
from gazette.plans.scalars import BAND, MEASURES, RUBRIC, measures

H = f"WITH {frames.HEALTH} "
COUNTS = H + ", c AS (SELECT count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'empty') AS empty, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'empty' AND candidates = 0) AS broken, sum(post_count)::bigint AS total_posts FROM health) "


@query("a01_source_counts", COUNTS + "SELECT * FROM c")
def a01(spark, sf):
    return health.counts(frames.health(spark, sf))


@query("a02_total_posts", H + "SELECT fetcher, sum(post_count)::bigint AS posts FROM health GROUP BY fetcher")
def a02(spark, sf):
    return frames.health(spark, sf).groupBy("fetcher").agg(F.sum("post_count").alias("posts"))


@query("f10_health_parts", H + "SELECT url, status, status = 'empty' AND coalesce(candidates, -1) = 0 AS broken FROM health")
def f10(spark, sf):
    return frames.health(spark, sf).select("url", "status", health.likely_broken().alias("broken"))


@query("a03_contributed", f"WITH {frames.POSTS}, k AS (SELECT source, ord, row_number() OVER (PARTITION BY content ORDER BY ord) AS n FROM posts) SELECT source, count(*) FILTER (n = 1) AS post_count, count(*) FILTER (n > 1) AS duplicates, 'ok' AS status FROM k GROUP BY source")
def a03(spark, sf):
    posts = frames.posts(spark, sf)
    return health.contributed(posts, posts.groupBy("content").agg(F.min("ord").alias("ord")))


REASON = "CASE WHEN length(content) < 600 THEN 'too short' WHEN score < 0.7::double THEN 'low score' WHEN lang = 'fr' THEN 'language' END"


def rejections(spark, sf):
    reason = F.when(F.length("content") < fixed.MIN_CONTENT_LENGTH, "too short").when(F.col("score") < fixed.MIN_SCORE, "low score").when(F.col("lang") == "fr", "language")
    return frames.scored(spark, sf).withColumn("reason", reason).where("reason IS NOT NULL")


@query("a04_reason_histogram", f"WITH {frames.SCORED}, r AS (SELECT *, {REASON} AS reason FROM scored) SELECT reason, count(*) AS n, min(ord) AS first_seen FROM r WHERE reason IS NOT NULL GROUP BY reason ORDER BY n DESC, first_seen")
def a04(spark, sf):
    return rejections(spark, sf).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_seen")).orderBy(F.desc("n"), "first_seen")


@query("a05_run_funnel", f"WITH {frames.SCORED} SELECT count(*) AS collected, count(*) FILTER ({REASON} IS NOT NULL) AS rejected, count(*) FILTER ({REASON} IS NULL) AS digest, round(coalesce(avg(score) FILTER ({REASON} IS NULL), 0), 6) AS mean_score FROM scored")
def a05(spark, sf):
    short, low, lang = F.length("content") < fixed.MIN_CONTENT_LENGTH, F.col("score") < fixed.MIN_SCORE, F.col("lang") == "fr"
    out = short | low | lang
    return frames.scored(spark, sf).agg(F.count(F.lit(1)).alias("collected"), F.count_if(out).alias("rejected"), F.count_if(~out).alias("digest"), F.round(F.coalesce(F.avg(F.when(~out, F.col("score"))), F.lit(0.0)), 6).alias("mean_score"))


STATS = f"""WITH {frames.REPEATS}, s AS (
  SELECT article_id, expected_band, avg(score) AS mean_score, coalesce(stddev_pop(score), 0) AS stdev, max(score) - min(score) AS spread,
         bool_and(score BETWEEN 0 AND 1 AND abs(score - round_even(score / 0.05::double, 0) * 0.05::double) <= 0.001::double) AS all_on_grid, bool_and({BAND.replace("VALUE", "score")} = expected_band) AS band_stable
  FROM repeats GROUP BY ALL),
e AS (SELECT *, spread = 0 AS is_deterministic, {BAND.replace("VALUE", "round(mean_score, 9)")} = expected_band AS band_matches FROM s) """


@query("a06_article_stats", STATS + "SELECT article_id, round(mean_score, 6) AS mean_score, round(stdev, 6) AS stdev, round(spread, 6) AS spread, all_on_grid, band_stable, is_deterministic, band_matches FROM e")
def a06(spark, sf):
    s = evalmetrics.article_stats(frames.repeats(spark, sf))
    rounded = [F.round(c, 6).alias(c) for c in ("mean_score", "stdev", "spread")]
    return s.select("article_id", *rounded, "all_on_grid", "band_stable", "is_deterministic", "band_matches")


@query(
    "a14_eval_report",
    STATS + ", r AS (SELECT avg(is_deterministic::int) AS determinism_rate, avg(all_on_grid::int) AS grid_rate, avg(band_matches::int) AS band_match_rate, avg(band_stable::int) AS band_stability_rate, avg(stdev) AS mean_stdev, max(spread) AS max_spread FROM e) SELECT round(determinism_rate, 6) AS determinism_rate, round(grid_rate, 6) AS grid_rate, round(band_match_rate, 6) AS band_match_rate, round(band_stability_rate, 6) AS band_stability_rate, round(mean_stdev, 6) AS mean_stdev, round(max_spread, 6) AS max_spread, grid_rate >= 0.99 AND band_match_rate >= 0.8 AS passed FROM r",
)
def a14(spark, sf):
    r = evalmetrics.report(evalmetrics.article_stats(frames.repeats(spark, sf)))
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns if c != "passed"], "passed")


DIMS = fixed.DIMENSIONS
UNPIVOT = " UNION ALL ".join(f"SELECT {k} AS k, '{d}' AS dimension, avg({d}) AS mean FROM r" for k, d in enumerate(DIMS))


def rubric_rows(spark, sf):
    m = measures(spark, sf)
    found = scores.rubric({c: F.col(c) for c in m.columns if c != "post_id"})
    return m.select("post_id", *[c.alias(k) for k, c in found.items()])


@query("a16_dimension_means", f"WITH {MEASURES}, r AS ({RUBRIC}) SELECT dimension, round(mean, 6) AS mean FROM ({UNPIVOT})")
def a16(spark, sf):
    r = rubric_rows(spark, sf)
    means = r.agg(*[F.avg(d).alias(d) for d in DIMS])
    return means.unpivot([], list(DIMS), "dimension", "mean").select("dimension", F.round("mean", 6).alias("mean"))


OVERALL = "(" + " + ".join(DIMS) + f") / {len(DIMS)}"


@query("a17_overall", f"WITH {MEASURES}, r AS ({RUBRIC}) SELECT round(avg({OVERALL}), 6) AS overall, avg({OVERALL}) < 0.7 AS failed FROM r")
def a17(spark, sf):
    total = sum((F.col(d) for d in DIMS[1:]), F.col(DIMS[0])) / len(DIMS)
    one = rubric_rows(spark, sf).agg(F.avg(total).alias("x"))
    return one.select(F.round("x", 6).alias("overall"), (F.col("x") < 0.7).alias("failed"))


MARKS = {"article": r"(?:the|der|die|das) ", "number": r"[0-9]+", "capital": r"[A-Z][a-z]+"}


@query("a18_marker_counts", f"WITH {frames.POSTS} SELECT post_id, " + ", ".join(f"len(regexp_extract_all(content, '{p}')) AS {k}" for k, p in MARKS.items()) + " FROM posts")
def a18(spark, sf):
    m = text.marker_counts(F.col("content"), MARKS)
    return frames.posts(spark, sf).withColumn("m", m).select("post_id", *[F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0)).cast("long").alias(k) for k in MARKS])


@query("a20_delivery_outcome", "SELECT count(*) AS resolved, count(*) FILTER (c_custkey % 4 = 0) AS skipped, count(*) FILTER (c_custkey % 4 <> 0) AS attempted, count(*) FILTER (c_custkey % 4 <> 0 AND c_custkey % 9 <> 0) AS succeeded, count(*) FILTER (c_custkey % 4 <> 0 AND c_custkey % 9 = 0) AS failed FROM customer")
def a20(spark, sf):
    k = F.col("c_custkey")
    skip, fail = k % 4 == 0, k % 9 == 0
    return frames.table(spark, sf, "customer").agg(F.count(F.lit(1)).alias("resolved"), F.count_if(skip).alias("skipped"), F.count_if(~skip).alias("attempted"), F.count_if(~skip & ~fail).alias("succeeded"), F.count_if(~skip & fail).alias("failed"))


@query("a21_longest_container", f"WITH {frames.POSTS} SELECT source, arg_max(post_id, length(content) * 1000000000::bigint - ord) AS post_id, max(length(content)) AS chars FROM posts GROUP BY source")
def a21(spark, sf):
    best = F.max_by("post_id", F.struct(F.length("content"), -F.col("ord")))
    return frames.posts(spark, sf).groupBy("source").agg(best.alias("post_id"), F.max(F.length("content")).cast("long").alias("chars"))


@query("a23_token_usage", "SELECT role, count(*) AS calls, sum(length(text)) AS characters, sum(CASE WHEN turn = 0 THEN length(text) ELSE 0 END) AS written FROM conversations GROUP BY role")
def a23(spark, sf):
    n = F.length("text").cast("long")
    return frames.table(spark, sf, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("calls"), F.sum(n).alias("characters"), F.sum(F.when(F.col("turn") == 0, n).otherwise(0)).alias("written"))


@query("c01_summary_line", COUNTS + "SELECT ok || ' ok, ' || empty || ' empty' || CASE WHEN broken > 0 THEN ' (' || broken || ' with nothing to filter)' ELSE '' END || ', ' || failed || ' failed (' || total_posts || ' posts)' AS line FROM c")
def c01(spark, sf):
    return health.summary_line(health.counts(frames.health(spark, sf)))


@query(
    "c01_report_lines",
    H + "SELECT url, status, '  - ' || url || CASE status WHEN 'failed' THEN ' [' || fetcher || ']: ' || coalesce(error, 'unknown error') WHEN 'empty' THEN ' [' || fetcher || ']: ' || CASE WHEN candidates IS NULL THEN 'no count reported' WHEN candidates = 0 THEN 'offered 0 items — LIKELY BROKEN (moved feed or stale selector)' ELSE 'offered ' || candidates || ' item(s), none in the date window' END ELSE ': ' || post_count || ' posts' || CASE WHEN duplicates > 0 THEN ' (' || duplicates || ' deduped)' ELSE '' END END AS line FROM health",
)
def c01_lines(spark, sf):
    return health.report_lines(frames.health(spark, sf))


@query(
    "f25_alerts",
    COUNTS + f", f AS (SELECT count(*) AS collected, count(*) FILTER ({REASON} IS NOT NULL) AS rejected FROM (SELECT *, ((post_id * 13 + n_chars) % 21) / 20.0::double AS score FROM posts)) SELECT event, fires FROM c, f, (VALUES ('crawl health'), ('empty digest'), ('partial delivery'), ('no recipients'), ('clipped issue'), ('run failure')) AS e(event), (SELECT CASE event WHEN 'crawl health' THEN failed + broken > 0 WHEN 'empty digest' THEN collected > 0 AND rejected > 0 WHEN 'partial delivery' THEN rejected % 7 > 0 WHEN 'clipped issue' THEN collected * 900 > 102400 WHEN 'run failure' THEN true ELSE false END AS fires) AS x",
)
def f25(spark, sf):
    c = health.counts(frames.health(spark, sf)).drop("total_posts")
    f = frames.scored(spark, sf).agg(F.count(F.lit(1)).alias("total_posts"))
    r = rejections(spark, sf).agg(F.count(F.lit(1)).alias("rejected"))
    run = c.crossJoin(f).crossJoin(r).withColumns({"chosen": F.lit(0), "failed_deliveries": F.col("rejected") % 7, "resolved": F.lit(3), "bytes": F.col("total_posts") * 900, "error": F.lit("it broke")})
    return alerts.due(run)


@query("snk08_funnel_json", COUNTS + "SELECT '{\"ok\":' || ok || ',\"empty\":' || empty || ',\"failed\":' || failed || ',\"broken\":' || broken || ',\"total_posts\":' || total_posts || '}' AS said FROM c")
def snk08(spark, sf):
    c = health.counts(frames.health(spark, sf))
    return c.select(F.to_json(F.struct("ok", "empty", "failed", "broken", "total_posts")).alias("said"))
