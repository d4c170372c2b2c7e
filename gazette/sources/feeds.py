"""RSS and Atom feeds from files, with Spark's XML reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.functions import dates

RSS = "title string, link string, pubDate string, description string, encoded string, category array<string>, _bad string"
ATOM = "title string, link array<struct<_href:string,_rel:string,_VALUE:string>>, published string, updated string, summary string, content string, category array<struct<_term:string,_VALUE:string>>, _bad string"


def _read(spark: SparkSession, paths: list[str] | str, tag: str, schema: str) -> DataFrame:
    reader = spark.read.format("xml").options(rowTag=tag, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", ignoreNamespace="true")
    return reader.schema(schema).load(paths).withColumn("feed", F.col("_metadata.file_path"))


def entries(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """One row per entry: feed, title, link, published_text (publication, else last change), summary, content, tags, bad.

    An entry that isn't well-formed has ``bad`` and nothing else. Both kinds of feed may stand among the paths.
    """
    none = F.lit(None).cast("string")
    rss = _read(spark, paths, "item", RSS).select(
        "feed", "title", "link", dates.entry_date_text(F.col("pubDate"), none).alias("published_text"), F.col("description").alias("summary"), F.col("encoded").alias("content"), F.coalesce("category", F.array().cast("array<string>")).alias("tags"), F.col("_bad").alias("bad")
    )
    links = F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    terms = F.transform(F.filter("category", lambda c: c["_term"].isNotNull()), lambda c: c["_term"])
    atom = _read(spark, paths, "entry", ATOM).select(
        "feed", "title", F.get(links, F.lit(0))["_href"].alias("link"), dates.entry_date_text(F.col("published"), F.col("updated")).alias("published_text"), "summary", "content", F.coalesce(terms, F.array().cast("array<string>")).alias("tags"), F.col("_bad").alias("bad")
    )
    return rss.unionByName(atom).where(F.coalesce(F.length("title"), F.lit(0)) >= 0)


def posts_in_window(rows: DataFrame, start, end) -> DataFrame:
    """Well-formed entries dated within the window; an entry whose date can't be read is out."""
    dated = rows.where("bad IS NULL").withColumn("published", dates.published(F.col("published_text")))
    return dated.where(dates.in_window(F.col("published"), start, end)).withColumn("title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("No Title")))


def feed_health(spark: SparkSession, paths: list[str], rows: DataFrame, kept: DataFrame) -> DataFrame:
    """A health row for each feed: failed if it has no well-formed entry but a bad one; candidates count entries before the window."""
    feeds = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("url"))
    key = lambda c: F.regexp_replace(c, "^file:/+", "/")
    seen = rows.groupBy(key(F.col("feed")).alias("k")).agg(F.count_if(F.col("bad").isNull()).alias("candidates"), F.count_if(F.col("bad").isNotNull()).alias("bad"))
    inside = kept.groupBy(key(F.col("feed")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    all_ = feeds.withColumn("k", key(F.col("url"))).join(seen, "k", "left").join(inside, "k", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    failed = (zero("candidates") == 0) & (zero("bad") > 0)
    status = F.when(failed, "failed").when(zero("n") > 0, "ok").otherwise("empty")
    return all_.select("url", F.lit("RssFetcher").alias("fetcher"), status.alias("status"), zero("n").alias("post_count"), F.lit(0).cast("long").alias("duplicates"), zero("candidates").alias("candidates"), F.when(failed, "no entry can be read").alias("error"))
