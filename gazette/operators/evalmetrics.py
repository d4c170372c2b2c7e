"""Metrics of repeated scores: per article, then over articles. Two levels of aggregation, no collecting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.functions import scores


def article_stats(repeats: DataFrame) -> DataFrame:
    """(article_id, expected_band) and the article's mean, spread, deviation and checks; an article without scores counts as 0."""
    s = F.col("score")
    band = scores.band_of(s) == F.col("expected_band")
    stats = repeats.groupBy("article_id", "expected_band").agg(
        F.coalesce(F.avg(s), F.lit(0.0)).alias("mean_score"),
        F.coalesce(F.stddev_pop(s), F.lit(0.0)).alias("stdev"),
        F.coalesce(F.max(s) - F.min(s), F.lit(0.0)).alias("spread"),
        F.coalesce(F.bool_and(scores.on_grid(s)), F.lit(True)).alias("all_on_grid"),
        F.coalesce(F.bool_and(band), F.lit(False)).alias("band_stable"),
    )
    return stats.withColumns({"is_deterministic": F.col("spread") == 0.0, "band_matches": scores.band_of(F.round("mean_score", 9)) == F.col("expected_band")})


def report(stats: DataFrame) -> DataFrame:
    """One row: rates over articles (0 without any) and the gate's decision."""
    rate = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    one = stats.agg(
        rate("is_deterministic").alias("determinism_rate"),
        rate("all_on_grid").alias("grid_rate"),
        rate("band_matches").alias("band_match_rate"),
        rate("band_stable").alias("band_stability_rate"),
        rate("stdev").alias("mean_stdev"),
        F.coalesce(F.max("spread"), F.lit(0.0)).alias("max_spread"),
    )
    return one.withColumn("passed", (F.col("grid_rate") >= 0.99) & (F.col("band_match_rate") >= 0.80))
