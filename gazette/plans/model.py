"""L queries: the model stages with deterministic offline models, and the whole composite."""

from __future__ import annotations

from pyspark.sql import functions as F

from gazette.operators import frames, model
from gazette.plans.registry import query

WORDS = "len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> ''))"


def posts(spark, sf):
    return frames.posts(spark, sf).withColumn("visible", F.col("content"))


@query("l01_scored_posts", f"WITH {frames.POSTS}, s AS (SELECT post_id, least(20, {WORDS} // 25) / 20.0::double AS score FROM posts WHERE content <> '') SELECT post_id, score FROM s WHERE score >= 0.7::double")
def l01(spark, sf):
    kept, _ = model.score_posts(posts(spark, sf), model.RuleScorer())
    return kept.select("post_id", "score")


@query("l01_rejections", f"WITH {frames.POSTS}, s AS (SELECT post_id, {WORDS} AS n FROM posts WHERE content <> '') SELECT post_id, 'score' AS stage, n || ' words' AS reason FROM s WHERE least(20, n // 25) / 20.0::double < 0.7::double UNION ALL SELECT post_id, 'score', 'No content available to evaluate.' FROM posts WHERE content = ''")
def l01_rejections(spark, sf):
    return model.score_posts(posts(spark, sf), model.RuleScorer())[1]


@query("l02_summaries")
def l02(spark, sf):
    done, _ = model.summarize_posts(posts(spark, sf), model.RuleSummarizer())
    return done.select("post_id", "summary", "one_liner", "tags")


@query("l07_process_posts")
def l07(spark, sf):
    done, _ = model.process_posts(frames.posts(spark, sf), model.RuleScorer(), model.RuleSummarizer(), max_posts=10, max_per_source=2)
    return done.select("post_id", "position", "score", "title", "summary", "one_liner", "tags")
