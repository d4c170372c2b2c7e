"""File sources and sinks: posts by day, evaluation sets, recipients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.operators.guard import is_email_udf
from gazette.operators.joins import merged_by_link

POST = "title string, link string, published string, content string, images array<string>, source string, summary string, one_liner string, tags array<string>, urls array<string>, score double"
EVAL_SET = "description string, criteria string, included_topics array<string>, excluded_topics array<string>, articles array<struct<id:string,expected_band:string,title:string,content:string,note:string>>"


def write_posts(posts: DataFrame, path: str) -> None:
    """JSON lines by day; only the days that the frame has are replaced."""
    posts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").json(path)


def read_posts(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """Posts of one day or of all, with ``date`` and ``file``; malformed lines are left out, an absent path is empty."""
    schema = f"{POST}, _bad string, date string"
    reader = spark.read.schema(schema).options(mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    try:
        rows = reader.json(path)
        rows = rows if day is None else rows.where(F.col("date") == day)
        return well_formed(rows.withColumn("file", F.col("_metadata.file_name")), "title")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{POST}, date string, file string")


def list_posts(spark: SparkSession, path: str, day: str | None = None) -> DataFrame:
    """The posts of a day or of all, in order of their files' names, then of title and link."""
    return read_posts(spark, path, day).orderBy("file", "title", "link")


def write_regenerated(stored: DataFrame, new: DataFrame, path: str, suffix: str) -> None:
    """The stored posts with content that were summarized anew, matched by link, with the new values, as days of their own: the date with the suffix."""
    fresh = merged_by_link(stored.where(F.length("content") > 0), new, ["summary", "one_liner", "tags", "urls"])
    write_posts(fresh.drop("file").withColumn("date", F.concat(F.col("date").cast("string"), F.lit(suffix))), path)


def write_greeting(spark: SparkSession, path: str, day: str, greeting: str) -> str:
    """The greeting as a text file beside the day's posts, replaced if it was there; its path."""
    where = f"{path}/date={day}/_greeting.txt"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(greeting.encode()))
    finally:
        out.close()
    return where


def read_greeting(spark: SparkSession, path: str, day: str) -> str | None:
    """The day's greeting; None if there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/date={day}/_greeting.txt")
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        return None
    stream = system.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def well_formed(rows: DataFrame, column: str) -> DataFrame:
    """Rows that could be parsed. Spark takes the mark of the others only beside a column of the data, so one is named."""
    named = F.coalesce(F.length(F.col(column).cast("string")), F.lit(0)) >= 0
    return rows.where(F.col("_bad").isNull() & named).drop("_bad")


def run_days(posts: DataFrame) -> DataFrame:
    """Days whose name is one, newest last."""
    return posts.where(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$")).select("date").distinct().orderBy("date")


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL_SET).json(path, multiLine=True).select(F.explode("articles").alias("a")).select("a.*")


def read_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object as a row; no row if it is missing, can't be read or is no object."""
    try:
        rows = spark.read.schema(f"{schema}, _bad string").options(mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", multiLine=True).json(path)
        rows.limit(1).collect()
        return well_formed(rows, rows.columns[0])
    except Exception:
        return spark.createDataFrame([], schema)


def recipients(spark: SparkSession, path: str | None = None, listed: list[str] | None = None) -> DataFrame:
    """Valid addresses, as written but for blanks at the ends; a given list wins over the file."""
    rows = spark.createDataFrame([(x,) for x in listed], "email string") if listed else spark.read.text(path).select(F.col("value").alias("email"))
    return rows.select(F.trim("email").alias("email")).where(is_email_udf("email"))
