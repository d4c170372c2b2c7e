"""Taking rows out of documents without moving the rest."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.shared import materialize

#: Keys that may be broadcast (8 bytes each, some tens in a hash table); more are joined by shuffle.
FEW = 1_000_000


def without(rows: DataFrame, gone: DataFrame, keys: dict[str, Column] | None = None) -> DataFrame:
    """The rows whose key isn't among ``gone``, every column as it is, whatever its name.

    ``keys`` says for each column of ``gone`` what stands for it in the rows (doc_id unless given); nulls
    equal nulls. The keys are written and counted first: while they are few the rows, texts and all, stay
    where they are.
    """
    keys = keys or {"doc_id": F.col("doc_id")}
    spare = "gone"
    while any(c.startswith(spare) for c in rows.columns):
        spare += "_"
    named = gone.select(*[F.col(k).alias(f"{spare}{n}") for n, k in enumerate(keys)]).distinct()
    named = materialize(named, "gone")
    if named.count() <= FEW:
        named = F.broadcast(named)
    same = reduce(and_, [own.eqNullSafe(F.col(f"{spare}{n}")) for n, own in enumerate(keys.values())])
    return rows.join(named, same, "left_anti")


def without_found(docs: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The documents whose doc_id isn't among those that ``find`` names; all columns kept.

    Rows that repeat an id go together. Rows without one are looked at by themselves, each under a hash of
    its text, so none of them goes for another's sake.
    """
    named = docs.where("doc_id IS NOT NULL")
    kept = without(named, find(named).select("doc_id"))
    bare = docs.where("doc_id IS NULL")
    if bare.isEmpty():
        return kept
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    found = find(bare.withColumn("doc_id", own)).select("doc_id")
    return kept.unionByName(without(bare, found, {"doc_id": own}))
