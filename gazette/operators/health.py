"""Source health: counts, the report's lines, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def likely_broken() -> Column:
    """Empty, and offered nothing to filter; an unknown count is not zero."""
    return (F.col("status") == "empty") & (F.coalesce(F.col("candidates"), F.lit(-1)) == 0)


def counts(health: DataFrame) -> DataFrame:
    """One row: sources by status, those likely broken, and posts."""
    status = lambda s: F.count_if(F.col("status") == s).alias(s)
    return health.agg(status("ok"), status("empty"), status("failed"), F.count_if(likely_broken()).alias("broken"), F.coalesce(F.sum("post_count"), F.lit(0)).alias("total_posts"))


def summary_line(row: DataFrame) -> DataFrame:
    """The counts as one line of text."""
    broken = F.when(F.col("broken") > 0, F.format_string(" (%d with nothing to filter)", "broken")).otherwise("")
    return row.select(F.concat(F.format_string("%d ok, %d empty", "ok", "empty"), broken, F.format_string(", %d failed (%d posts)", "failed", "total_posts")).alias("line"))


def empty_reason() -> Column:
    c = F.col("candidates")
    return F.when(c.isNull(), "no count reported").when(c == 0, "offered 0 items — LIKELY BROKEN (moved feed or stale selector)").otherwise(F.format_string("offered %d item(s), none in the date window", c))


def report_lines(health: DataFrame) -> DataFrame:
    """(url, status, line): a line of the report for each source."""
    failed = F.concat(F.lit("  - "), "url", F.lit(" ["), "fetcher", F.lit("]: "), F.coalesce("error", F.lit("unknown error")))
    empty = F.concat(F.lit("  - "), "url", F.lit(" ["), "fetcher", F.lit("]: "), empty_reason())
    ok = F.concat(F.lit("  - "), "url", F.format_string(": %d posts", "post_count"), F.when(F.col("duplicates") > 0, F.format_string(" (%d deduped)", "duplicates")).otherwise(""))
    return health.select("url", "status", F.when(F.col("status") == "failed", failed).when(F.col("status") == "empty", empty).otherwise(ok).alias("line"))


def contributed(fetched: DataFrame, survivors: DataFrame, key: str = "ord") -> DataFrame:
    """(source, post_count, duplicates, status): a source that brought rows is ok even if all were duplicates."""
    kept = survivors.select(key).withColumn("kept", F.lit(1))
    rows = fetched.select("source", key).join(kept, key, "left")
    sums = rows.groupBy("source").agg(F.count("kept").alias("post_count"), F.count_if(F.col("kept").isNull()).alias("duplicates"))
    return sums.withColumn("status", F.lit("ok"))
