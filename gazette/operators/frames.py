"""The domain's frames over the provided tables, and the same frames as SQL for the oracles.

posts: a document as a published article. scored: with a score on the grid. Integer arithmetic only, so
that both engines agree bit for bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """post_id, link, source, lang, title, content, n_chars, published (30 days from 2024-01-01), ord (order of arrival)."""
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    published = F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(CAST(doc_id * 7 % 30 AS INT), 0, 0, CAST(doc_id % 86400 AS DECIMAL(18, 6)))")
    return d.select(
        F.col("doc_id").alias("post_id"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/p/"), F.col("doc_id").cast("string")).alias("link"),
        "source",
        "lang",
        F.left(F.split_part(text, F.lit("\n"), F.lit(1)), F.lit(80)).alias("title"),
        text.alias("content"),
        "n_chars",
        published.alias("published"),
        F.col("doc_id").alias("ord"),
    )


POSTS = """posts AS (
  SELECT doc_id AS post_id, 'https://' || source || '.example.com/p/' || doc_id AS link, source, lang,
         left(split_part(coalesce(text, ''), chr(10), 1), 80) AS title, coalesce(text, '') AS content, n_chars,
         TIMESTAMP '2024-01-01' + to_days(CAST(doc_id * 7 % 30 AS INT)) + to_seconds(CAST(doc_id % 86400 AS INT)) AS published, doc_id AS ord
  FROM documents)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """posts with a deterministic score on the grid."""
    return posts(spark, sf_dir).withColumn("score", ((F.col("post_id") * 13 + F.col("n_chars")) % 21) / 20.0)


SCORED = f"{POSTS}, scored AS (SELECT *, ((post_id * 13 + n_chars) % 21) / 20.0::double AS score FROM posts)"


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scores of each labelled post, some off by a step, with the band expected of it."""
    labels = table(spark, sf_dir, "labels")
    band = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "high").when(F.col("quality") == 1, "moderate").when(F.col("toxic") == 0, "weak").otherwise("reject")
    rows = labels.select(F.col("doc_id").alias("article_id"), band.alias("expected_band"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("repeat"))
    off = F.when((F.col("article_id") + F.col("repeat")) % 7 == 0, 5).when(F.col("article_id") % 11 == 0, 2).otherwise(0)
    return rows.withColumn("score", (F.pmod(F.col("article_id") * 5, F.lit(19)) * 5 + off) / 100.0)


REPEATS = """repeats AS (
  SELECT doc_id AS article_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'high' WHEN quality = 1 THEN 'moderate' WHEN toxic = 0 THEN 'weak' ELSE 'reject' END AS expected_band,
         r AS repeat, (doc_id * 5 % 19 * 5 + CASE WHEN (doc_id + r) % 7 = 0 THEN 5 WHEN doc_id % 11 = 0 THEN 2 ELSE 0 END) / 100.0::double AS score
  FROM labels, range(1, 4) AS t(r))"""


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each source, and three that brought nothing."""
    seen = posts(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.dayofmonth("published") <= 7).alias("inside"))
    ok = seen.select(
        F.concat(F.lit("https://"), "source", F.lit(".example.com/feed")).alias("url"),
        F.lit("RssFetcher").alias("fetcher"),
        F.when(F.col("inside") > 0, "ok").otherwise("empty").alias("status"),
        F.col("inside").alias("post_count"),
        F.lit(0).cast("long").alias("duplicates"),
        F.col("n").alias("candidates"),
        F.lit(None).cast("string").alias("error"),
    )
    rows = [("https://gone.example.org/feed", "RssFetcher", "failed", 0, 0, None, "HTTP 503"), ("https://moved.example.org/blog", "PageFetcher", "empty", 0, 0, 0, None), ("https://quiet.example.org/blog", "PageFetcher", "empty", 0, 0, None, None)]
    schema = ", ".join(f"{c} {t}" for c, t in ok.dtypes)
    return ok.unionByName(spark.createDataFrame(rows, schema))


HEALTH = f"""{POSTS}, health AS (
  SELECT 'https://' || source || '.example.com/feed' AS url, 'RssFetcher' AS fetcher,
         CASE WHEN count(*) FILTER (day(published) <= 7) > 0 THEN 'ok' ELSE 'empty' END AS status,
         count(*) FILTER (day(published) <= 7) AS post_count, 0 AS duplicates, count(*) AS candidates, NULL::varchar AS error
  FROM posts GROUP BY source
  UNION ALL VALUES ('https://gone.example.org/feed', 'RssFetcher', 'failed', 0, 0, NULL, 'HTTP 503'),
    ('https://moved.example.org/blog', 'PageFetcher', 'empty', 0, 0, 0, NULL),
    ('https://quiet.example.org/blog', 'PageFetcher', 'empty', 0, 0, NULL, NULL))"""


def literal(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """Cases as a frame."""
    return spark.createDataFrame(rows, schema)
