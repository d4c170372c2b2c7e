"""The engine over streams: late events, weekly counts, and idempotent delivery by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gazette.functions import dates

ENTRY = "title string, link string, published string, summary string, source string"


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries from JSON files as they arrive, with a readable date only."""
    rows = spark.readStream.schema(ENTRY).json(path)
    return rows.withColumn("published", dates.published(F.col("published"))).where("published IS NOT NULL")


def weekly_counts(entries: DataFrame, late: str = "7 days") -> DataFrame:
    """Entries by week and source; those later than the watermark allows are dropped."""
    return entries.withWatermark("published", late).groupBy(F.window("published", "7 days", None, "4 days"), "source").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("week"), "source", "n")


def distinct_links(entries: DataFrame, late: str = "7 days") -> DataFrame:
    """The first entry of each link within the watermark. Not the batch's greedy rule, which titles take part in."""
    return entries.withWatermark("published", late).dropDuplicatesWithinWatermark(["link"])


def deliver_stream(rows: DataFrame, checkpoint: str, ledger: str, deliver: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand each micro-batch's rows that the ledger lacks to ``deliver``, then append them to the ledger.

    A batch that is repeated after a failure finds in the ledger what it had finished.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            done = spark.read.parquet(ledger).select("link").distinct()
        except Exception:
            done = spark.createDataFrame([], "link string")
        fresh = batch.dropDuplicates(["link"]).join(done, "link", "left_anti").persist()
        try:
            deliver(fresh, number)
            fresh.select("link").write.mode("append").parquet(ledger)
        finally:
            fresh.unpersist()

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
