"""Exact duplicates by skew-safe combining.

Texts are combined three times: within a task (Spark's partial aggregation), within a salt of the
digest, and over the salts of a digest. Each time the key holds the digest *and the text*, so two
texts that share a digest are never taken for one. A group of copies that holds a third of all rows
is one row for each task after the first step and one row for each salt after the second, so no task
ever gets the group.

Rows find their group by digest alone unless a digest has several texts (which a cryptographic
digest never showed, but the operator takes any): then the rows of that digest compare texts again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.rows import without
from gazette.shared import materialize

#: Parts into which the rows of one digest are dealt before the last step.
SALTS = 16


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def combine(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(digest, text, doc_id) -> one row (digest, text, keep_id, group_size) for each distinct text.

    The last exchange is by digest alone, so that what follows by digest needs none.
    """
    salted = rows.groupBy("digest", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"), "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    return salted.repartition("digest").groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_groups(docs: DataFrame, digest=sha256, salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. The row with the largest doc_id stays.
    Rows that repeat a doc_id count each for themselves, and all of them are kept if the id is;
    a null doc_id never wins over another and is not kept.
    An empty table gives an empty result. Columns other than doc_id and text are not read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", digest(F.col("text")).alias("digest"))
    groups = combine(rows, salts).groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    groups = materialize(groups, "exact-groups")
    sha = F.col("digest") if digest is sha256 else sha256(F.col("text"))
    found = rows.select("doc_id", "digest", sha.alias("text_sha256")).join(groups.where("texts = 1").drop("texts"), "digest")
    clashes = groups.where("texts > 1").select("digest")
    if not clashes.isEmpty():
        clashing = rows.join(clashes, "digest", "left_semi")
        shared = materialize(combine(clashing, salts), "exact-clashes")
        found = found.unionByName(clashing.select("doc_id", "digest", "text", sha.alias("text_sha256")).join(shared, ["digest", "text"]).drop("text"))
    return found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The documents without copies: of equal texts one row with the largest doc_id, all columns kept.

    Rows are told apart by doc_id and text together, so a row that repeats another's id with a text of its
    own stays. Of rows that repeat both, the one whose other columns come first as JSON stays; a row
    without an id goes if one with an id has its text, and of equal texts without any id one stays.
    """
    groups = materialize(exact_groups(docs, salts=salts).where("group_size > 1").select("doc_id", "keep_id", "text_sha256"), "exact-copies")
    rows = {"doc_id": F.col("doc_id"), "text_sha256": sha256(F.coalesce("text", F.lit("")))}
    best = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    kept = without(docs, groups.where(~best), rows)
    again = groups.where(best).groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if again.isEmpty():
        return kept
    again = materialize(again, "repeated-rows")
    single = without(kept, again, rows)
    own = [F.col(f"`{c}`") for c in docs.columns]
    same = (F.col("r.doc_id").eqNullSafe(F.col("g.doc_id"))) & (F.col("sha") == F.col("g.text_sha256"))
    packed = kept.select(F.struct(*own).alias("r"), rows["text_sha256"].alias("sha"))
    twice = packed.join(again.alias("g"), same, "left_semi").groupBy("r.doc_id", "sha").agg(F.min_by("r", F.to_json("r")).alias("r"))
    return single.unionByName(twice.select("r.*"))
