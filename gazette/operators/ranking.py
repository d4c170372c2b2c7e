"""Order-dependent operators: ranking, per-source caps with back-fill, greedy duplicate removal."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazette.operators.components import components
from gazette.shared import materialize, new_path


def by_relevance(posts: DataFrame) -> list[Column]:
    """Score, then date, both falling; ties in order of arrival."""
    return [F.desc("score"), F.desc("published"), F.asc("ord")]


def global_rank(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """With ``name`` from 1 over all rows in this order.

    Rows are dealt by ranges of the whole order, sorted within each part and written with their number
    there; a row's rank is the rows of the parts before and its own number. So neither a hot score nor a
    missing date brings more than a part to one task, and what the window orders is one row for each part.
    Select the columns that are needed before: all of them are written.
    """
    parted = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialize(parted.withColumns({"_part": F.spark_partition_id(), "_number": F.monotonically_increasing_id()}), "ranked")
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    # Spark numbers the rows of a part from 0, behind the part's own number in the upper bits.
    place = F.col("_before") + F.col("_number").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return numbered.join(F.broadcast(offsets), "_part").withColumn(name, place).drop("_part", "_number", "_before")


def ranked(posts: DataFrame, ties: tuple[str, ...] = ("ord",)) -> DataFrame:
    """With ``rank`` from 1 over all rows by score and date, both falling (nulls last), then by ``ties``."""
    return global_rank(posts, [F.desc("score"), F.desc("published"), *map(F.asc, ties)])


def select_for_digest(posts: DataFrame, max_posts: int | None, max_per_source: int | None) -> DataFrame:
    """The line-up with ``position`` from 1.

    The best of each source up to the cap, then as many of the rest as there is room for, all in order of
    rank; the result is ordered by score and date, and of equals those within the cap come first. No
    limit (null, or 0 and less) takes all. With a limit of n only the n best of a source can matter, without
    one only those within the cap are looked for, so a source that holds most rows is cut down before the
    shuffle.
    """
    limit = max_posts if max_posts is not None and max_posts > 0 else None
    order = by_relevance(posts)
    nth = F.row_number().over(Window.partitionBy("source").orderBy(*order))
    if limit is None:
        if max_per_source is None:
            return ranked(posts).withColumnRenamed("rank", "position")
        within = posts.withColumn("nth", nth).where(F.col("nth") <= max_per_source).select("ord", F.lit(0).alias("over"))
        marked = posts.join(within, "ord", "left").withColumn("over", F.coalesce("over", F.lit(1)))
        return ranked(marked, ("over", "ord")).withColumnRenamed("rank", "position").drop("over")
    own = posts.withColumn("nth", nth).where(F.col("nth") <= limit)
    over = F.lit(0) if max_per_source is None else (F.col("nth") > max_per_source).cast("int")
    chosen = own.withColumn("over", over).orderBy("over", *order).limit(limit)
    final = Window.orderBy(F.desc("score"), F.desc("published"), "over", "ord")
    return chosen.withColumn("position", F.row_number().over(final)).drop("nth", "over")


#: Rows of a component that one task walks through; larger ones go on in rounds.
FOLDED = 10_000
#: Rounds between two foldings.
ROUNDS = 2


def greedy_dedup(rows: DataFrame, link: str = "link", key: str = "title_key", ord: str = "ord", folded: int = FOLDED) -> DataFrame:
    """The rows that a first-come pass accepts: no earlier *accepted* row has the link or the (non-empty) key.

    In each round a row that is the first undecided one of both its groups is accepted, and the rest of
    its groups are rejected. Groups are met by their smallest ``ord`` only, so a group of any size costs one
    combined row for each task. What two rounds leave undecided are chains of rows that each wait for the
    one before: components of up to ``folded`` rows are walked through in order, each within a task, and the
    rows of larger ones go on in rounds. A null key is an empty one, a null link is a link; ``ord`` is unique.
    Accepted rows are appended to one table, so the plan doesn't grow with the rounds.
    """
    links, keys = F.coalesce(F.col(link), F.lit("")), F.coalesce(F.col(key), F.lit(""))
    path = new_path(rows.sparkSession, "accepted")
    left = materialize(rows.select(F.col(ord).cast("long").alias("o"), links.alias("l"), keys.alias("k")), "undecided")
    while True:
        for _ in range(ROUNDS):
            left = _round(left, path)
            if left.isEmpty():
                accepted = rows.sparkSession.read.schema("o long").parquet(path)
                return rows.join(accepted, F.col(ord) == F.col("o"), "left_semi")
        left = _folded(left, path, folded)


def _firsts(left: DataFrame) -> DataFrame:
    """With the first undecided row of each row's link and key; no key, no first."""
    by_link = left.groupBy("l").agg(F.min("o").alias("first_l"))
    by_key = left.where("k <> ''").groupBy("k").agg(F.min("o").alias("first_k"))
    return materialize(left.join(by_link, "l").join(by_key, "k", "left").select("o", "l", "k", "first_l", "first_k"), "round")


def _round(left: DataFrame, path: str) -> DataFrame:
    """Accept the rows that are first of both groups; what is undecided then."""
    seen = _firsts(left)
    taken = seen.where("o = first_l AND (first_k IS NULL OR o = first_k)").select("o")
    taken.write.mode("append").parquet(path)
    won = taken.select(F.col("o").alias("won"))
    rest = seen.join(won, F.col("first_l") == F.col("won"), "left_anti").join(won, F.col("first_k") == F.col("won"), "left_anti")
    return materialize(rest.select("o", "l", "k"), "undecided")


def _folded(left: DataFrame, path: str, most: int) -> DataFrame:
    """Accept rows of components of ``most`` rows at most, each walked through in a task; the rows of larger ones."""
    seen = _firsts(left)
    met = seen.select(F.col("o").alias("a"), F.col("first_l").alias("b")).unionByName(seen.where("first_k IS NOT NULL").select(F.col("o").alias("a"), F.col("first_k").alias("b")))
    labelled = left.join(components(met).withColumnRenamed("node", "o"), "o")
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    labelled = materialize(labelled.join(sizes, "label"), "components")

    def walk(part: pa.Table) -> pa.Table:
        links, keys, out = set(), set(), []
        for x in part.sort_by("o").to_pylist():
            if x["l"] not in links and (not x["k"] or x["k"] not in keys):
                links.add(x["l"])
                keys.add(x["k"])
                out.append(x["o"])
        return pa.table({"o": pa.array(out, pa.int64())})

    small = labelled.where(F.col("n") <= most)
    small.select("label", "o", "l", "k").groupBy("label").applyInArrow(walk, "o long").write.mode("append").parquet(path)
    return materialize(labelled.where(F.col("n") > most).select("o", "l", "k"), "undecided")
