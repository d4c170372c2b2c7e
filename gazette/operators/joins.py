"""The domain's joins, each as the equi- or theta join that it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette import fixed
from gazette.functions import urls


def source_map(spark: SparkSession, mapping: dict[str, str] | None = None) -> DataFrame:
    """(key, source): a written-out table, small enough that the optimizer broadcasts it by its size."""
    return spark.createDataFrame(sorted((fixed.SOURCE_OF if mapping is None else mapping).items()), "key string, mapped string")


def with_source(rows: DataFrame, mapping: DataFrame, link: str = "link") -> DataFrame:
    """With ``source`` by the link's publication handle, else by its host, else unknown."""
    by_handle, by_host = urls.source_keys(F.col(link))
    handles = mapping.select(F.col("key").alias("_handle"), F.col("mapped").alias("_by_handle"))
    hosts = mapping.select(F.col("key").alias("_host"), F.col("mapped").alias("_by_host"))
    keyed = rows.withColumns({"_handle": by_handle, "_host": by_host})
    found = keyed.join(handles, "_handle", "left").join(hosts, "_host", "left")
    return found.withColumn("source", F.coalesce("_by_handle", "_by_host", F.lit(fixed.UNKNOWN))).drop("_handle", "_host", "_by_handle", "_by_host")


def with_logo(rows: DataFrame, logos: DataFrame) -> DataFrame:
    """With ``logo`` of the source, else of the unknown source, else empty."""
    own = logos.select(F.col("source"), F.col("logo").alias("_own"))
    spare = logos.where(F.col("source") == fixed.UNKNOWN).agg(F.max("logo").alias("_spare"))
    return rows.join(own, "source", "left").crossJoin(spare).withColumn("logo", F.coalesce("_own", "_spare", F.lit(""))).drop("_own", "_spare")


def undelivered(recipients: DataFrame, ledger: DataFrame) -> DataFrame:
    """Recipients whose address isn't in the ledger, whatever its case; blanks at the ends don't count."""
    key = F.lower(F.trim("email"))
    done = ledger.select(key.alias("_key")).distinct()
    return recipients.withColumn("_key", key).join(done, "_key", "left_anti").drop("_key")


def without_flaky(sources: DataFrame, patterns: DataFrame) -> DataFrame:
    """Sources whose URL holds none of the non-empty patterns. Patterns are configuration: a handful."""
    wanted = patterns.where("pattern <> ''")
    return sources.join(wanted, sources["url"].contains(wanted["pattern"]), "left_anti")


def routed(urls_: DataFrame, registry: DataFrame) -> DataFrame:
    """(url, fetcher): the first of the registry whose fragment the URL holds, else the feed reader."""
    match = urls_.join(registry, urls_["url"].contains(registry["fragment"]), "left")
    return match.groupBy("url").agg(F.coalesce(F.min_by("fetcher", "rank"), F.lit("RssFetcher")).alias("fetcher"))


def unsourced(rows: DataFrame, urls_column: str, html: str) -> DataFrame:
    """With ``unsourced``: those of the array's URLs that the HTML doesn't hold."""
    return rows.withColumn("unsourced", F.filter(urls_column, lambda u: (u != "") & ~F.contains(F.col(html), u)))


def overridden(old, new):
    """A map column with the entries of another over it; a null there is a value too."""
    return F.map_zip_with(old, new, lambda k, a, b: F.when(F.map_contains_key(new, k), b).otherwise(a))


def merged_by_link(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``old`` that ``new`` has too, with the new values of ``columns``."""
    return old.drop(*columns).join(new.select("link", *columns), "link")
