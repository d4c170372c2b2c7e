"""Near duplicates by HyperMinHash, with no link lost.

1. A text's set of word shingles is hashed into registers: the hash space has 128 equal parts, and of the
   smallest hash in each the register keeps the number of leading zeros and ten mantissa bits.
2. Texts with the same set are one node. Four registers are a band; nodes that share a band share a
   bucket. A pair at 0.8 is in no common bucket with a probability of 5e-8 (0.59 to the power of 32).
3. In each bucket every node is paired with the bucket's head only, the node that meets most others. Pairs whose Jaccard similarity,
   estimated from the registers and corrected for collisions, is far below the threshold are left out;
   the others are verified on full sets. Links give components.
4. A link that step 3 did not see joins two components. Its ends share several bands: in a bucket of few
   nodes of about their size each node is held against the others, which is a bounded number for each;
   a node that is in several larger ones with nodes of other components counts without looking. These
   *open* nodes are joined on the rarest shingles of their sets: of two linked sets the larger has one of
   its first ``n - least overlap + 1`` among the smaller's first ``m - least overlap with larger ones + 1``,
   at positions that leave room for the overlap. A shingle that many open nodes hold is dealt over
   several tasks. What is found is verified on full sets, and components are made again.

So no bucket, however large, becomes all pairs or one task's work, and shingles that many texts share are
never join keys unless a node has no rarer ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.operators.components import components
from gazette.shared import materialize
from gazette.llm.rows import FEW, without
from gazette.llm.textvec import NOT_SPACE, U64, lower_ascii, mix, ngrams, slices, tidy, utf8, words_of, written

REGISTERS, BAND = 128, 4
BANDS = REGISTERS // BAND
MANTISSA = 10
#: Chance that registers of different hashes are equal: a third for the zeros, one in 1024 for the mantissa.
COLLISION = 1 / 3 / (1 << MANTISSA)
#: Standard errors by which an estimate may fall short of the threshold.
ERRORS = 5.0
#: Chance that two linked nodes share fewer bands than step 4 looks for.
MISSED = 2e-6
#: Nodes of a bucket that are held against each other; in larger buckets none are.
SMALL = 64
#: Open nodes with a shingle that one task joins; more are dealt over several.
DEALT = 1000


@dataclass(frozen=True)
class Rule:
    """Shingle length in words, and the similarity of a link in hundredths."""

    words: int = 5
    percent: int = 80

    @property
    def shared(self) -> int:
        """Bands that linked nodes share at least, but for a chance of ``MISSED``: 4 at 0.85, 2 at 0.8."""
        one, k, below = (self.percent / 100) ** BAND, 0, 0.0
        while below + (next_ := math.comb(BANDS, k) * one**k * (1 - one) ** (BANDS - k)) <= MISSED:
            below, k = below + next_, k + 1
        return max(1, k)


def shingles_of(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than n are one shingle, none are none."""
    if len(words) >= n:
        return np.unique(ngrams(words, n))
    return ngrams(words, len(words), len(words)) if len(words) else np.zeros(0, U64)


def registers_of(hashes: np.ndarray) -> np.ndarray:
    """Registers of a sorted set of hashes; 0 for an empty part."""
    out = np.zeros(REGISTERS, np.uint16)
    part = (hashes >> U64(57)).astype(np.int64)
    first = np.flatnonzero(np.diff(part, prepend=-1))
    rest = hashes[first] << U64(7)
    zeros = 64 - np.frexp(rest.astype(np.float64))[1]
    zeros = np.minimum(np.where(rest == 0, 57, zeros), 57)
    mantissa = (rest << (zeros + 1).astype(U64)) >> U64(64 - MANTISSA)
    out[part[first]] = ((zeros.astype(U64) << U64(MANTISSA)) | mantissa).astype(np.uint16) + np.uint16(1)
    return out


_FINGERPRINT = "doc_id long, n long, digest binary, registers array<long>, bands array<long>"


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, size of the set, its digest, registers (four to a long) and band keys; no bands for an empty set."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("registers", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])
    salts = mix(np.arange(1, BANDS + 1, dtype=U64) * U64(0x2545F4914F6CDD1D))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                o = offsets[a : b + 1]
                hashes, _, bounds = words_of(lower_ascii(data[o[0] : o[-1]]), o - o[0], NOT_SPACE)
                sizes, digests, packed, bands = [], [], [], []
                for k in range(b - a):
                    own = shingles_of(hashes[bounds[k] : bounds[k + 1]], words)
                    four = registers_of(own).view(U64)
                    sizes.append(len(own))
                    digests.append(blake2b(own.tobytes(), digest_size=16).digest())
                    packed.append(four.view(np.int64))
                    bands.append(mix(four + salts)[four != 0].view(np.int64))
                lists = [pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)]).astype(np.int32), np.concatenate(x)) for x in (packed, bands)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), *lists], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), _FINGERPRINT)


def sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the texts whose ids are given, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                o = offsets[a : b + 1]
                hashes, _, bounds = words_of(lower_ascii(data[o[0] : o[-1]]), o - o[0], NOT_SPACE)
                own = [shingles_of(hashes[x:y], words).view(np.int64) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, own)]).astype(np.int32), np.concatenate(own))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], lists], names=["node", "shingles"])

    wanted = ids.select(F.col("node").alias("wanted")).distinct()
    if wanted.count() <= FEW:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, F.col("doc_id") == F.col("wanted")).select("doc_id", "text")
    return written(texts.mapInArrow(tidy(run), "node long, shingles array<long>"), "shingles")


def equal_registers(a: Column, b: Column) -> Column:
    """Number of registers that are equal and not empty in both, of packed arrays."""

    def same(x: Column, y: Column) -> Column:
        total = F.lit(0)
        for k in range(BAND):
            p, q = (F.shiftrightunsigned(v, 16 * k).bitwiseAND(F.lit(0xFFFF)) for v in (x, y))
            total += F.when((p == q) & (p != 0), 1).otherwise(0)
        return total

    return F.aggregate(F.zip_with(a, b, same), F.lit(0), lambda s, x: s + x)


def used_registers(a: Column, b: Column) -> Column:
    """Number of registers that are not empty in one of the two."""

    def used(x: Column, y: Column) -> Column:
        either = x.bitwiseOR(y)
        total = F.lit(0)
        for k in range(BAND):
            total += F.when(F.shiftrightunsigned(either, 16 * k).bitwiseAND(F.lit(0xFFFF)) != 0, 1).otherwise(0)
        return total

    return F.aggregate(F.zip_with(a, b, used), F.lit(0), lambda s, x: s + x)


def likely(a: Column, b: Column, rule: Rule) -> Column:
    """Whether the estimated similarity of two packed register arrays may be that of a link."""
    t = rule.percent / 100
    used = F.greatest(used_registers(a, b), F.lit(1))
    estimate = (equal_registers(a, b) / used - COLLISION) / (1 - COLLISION)
    return estimate >= t - ERRORS * F.sqrt(F.lit(t * (1 - t)) / used)


def verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Those of the (a, b) pairs that are links, by full sets."""
    left, right = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"{k}_set")) for k in "ab")
    both = F.size(F.array_intersect("a_set", "b_set"))
    full = pairs.join(left, "a").join(right, "b")
    return full.where(100 * both >= rule.percent * (F.size("a_set") + F.size("b_set") - both)).select("a", "b")


def fits(a: Column, b: Column, rule: Rule) -> Column:
    """Sizes that a link allows."""
    return 100 * F.least(a, b) >= rule.percent * F.greatest(a, b)


def buckets(rows: DataFrame) -> DataFrame:
    """(key, node, head) of the buckets with several nodes; the head is the node that shares most buckets with most others.

    A text from which many were copied meets them all, its copies meet each other less; so heads are
    mostly originals, and most links are links with a head. What is joined here is the shared buckets only.
    """
    members = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = materialize(rows.join(members, "key"), "shared-buckets")
    degrees = shared.groupBy("node").agg(F.sum("members").alias("degree"))
    heads = shared.join(degrees, "node").groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("least"))).alias("top"))
    return materialize(shared.select("key", "node").join(heads.select("key", (-F.col("top.least")).alias("head")), "key"), "buckets")


def star_links(nodes: DataFrame, shared: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """Links between a bucket's head and its other nodes."""
    pairs = shared.where("node <> head").select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct()
    left, right = (nodes.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("registers").alias(f"r_{k}")) for k in "ab")
    close = pairs.join(left, "a").join(right, "b").where(fits(F.col("n_a"), F.col("n_b"), rule)).where(likely(F.col("r_a"), F.col("r_b"), rule))
    close = materialize(close.select("a", "b"), "star-pairs")
    ids = close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node")))
    return materialize(verified(close, sets_of(docs, ids, rule.words), rule), "star-links")


def open_nodes(nodes: DataFrame, shared: DataFrame, labels: DataFrame, rule: Rule) -> DataFrame:
    """(node, label, n) of the nodes that may be linked with a node of another component.

    Buckets are split into cells by size, two for each node, so that nodes whose sizes fit share one.
    """
    labelled = nodes.join(labels, "node", "left").select("node", "n", "bands", F.coalesce("label", "node").alias("label"))
    size = F.floor(F.log("n") / math.log(100 / rule.percent)) if rule.percent < 100 else F.col("n")
    cells = shared.select("key", "node").join(labelled.drop("bands"), "node").withColumn("cell", F.explode(F.array(size, size + 1)))
    mixed = cells.groupBy("key", "cell").agg(F.count(F.lit(1)).alias("members"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    among = materialize(cells.join(mixed.select("key", "cell", "members"), ["key", "cell"]), "mixed-cells")
    small = materialize(among.where(F.col("members") <= SMALL).join(nodes.select("node", "bands"), "node").drop("members"), "small-cells")
    other = small.select(*[F.col(c).alias(f"{c}_o") for c in small.columns])
    few = F.least(F.lit(rule.shared), F.ceil(0.2 * F.least(F.size("bands"), F.size("bands_o"))))
    meets = (F.col("key") == F.col("key_o")) & (F.col("cell") == F.col("cell_o")) & (F.col("label") != F.col("label_o")) & fits(F.col("n"), F.col("n_o"), rule) & (F.size(F.array_intersect("bands", "bands_o")) >= few)
    met = small.join(other, meets, "left_semi").select("node", "label", "n")
    # Whoever shares enough bands, but none in a small cell, is in that many large cells.
    crowded = among.where(F.col("members") > SMALL).select("node", "label", "n", "key").distinct().groupBy("node", "label", "n").agg(F.count(F.lit(1)).alias("keys"))
    several = crowded.join(nodes.select("node", F.size("bands").alias("own")), "node").where(F.col("keys") >= F.least(F.lit(rule.shared), F.ceil(0.1 * F.col("own"))))
    return materialize(met.unionByName(several.select("node", "label", "n")).distinct(), "open-nodes")


def prefix_links(opened: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """Links between open nodes of different components, by their rarest shingles."""
    sets = sets_of(docs, opened, rule.words)
    tokens = sets.select("node", F.explode("shingles").alias("token"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = tokens.join(often, "token", "left").groupBy("node").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "token"))).alias("ranked"))
    sized = ranked.join(opened, "node")
    # Of the larger set percent% are shared at least; of the smaller one 2 * percent / (100 + percent).
    longer = F.col("n") - F.ceil(F.col("n") * rule.percent / 100) + 1
    shorter = F.col("n") - F.ceil(F.col("n") * (2 * rule.percent) / (100 + rule.percent)) + 1
    short = sized.select("node", "label", "n", shorter.alias("indexed"), F.posexplode(F.slice("ranked", F.lit(1), longer.cast("int"))).alias("at", "x"))
    short = short.where("x.df > 1").select("node", "label", "n", "at", "indexed", F.col("x.token").alias("token"), F.ceil(F.col("x.df") / DEALT).cast("int").alias("parts"))
    short = materialize(short, "prefixes")
    larger = short.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    smaller = short.where("at < indexed").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    smaller = smaller.select(*[F.col(c).alias(f"{c}_o") for c in ("node", "label", "n", "at", "token", "part")])
    room = (100 + rule.percent) * F.least(F.col("n") - F.col("at"), F.col("n_o") - F.col("at_o")) >= rule.percent * (F.col("n") + F.col("n_o"))
    order = F.struct("n", "node") > F.struct("n_o", "node_o")
    meets = (F.col("token") == F.col("token_o")) & (F.col("part") == F.col("part_o")) & order & (F.col("label") != F.col("label_o")) & fits(F.col("n"), F.col("n_o"), rule) & room
    pairs = materialize(larger.join(smaller, meets).select(F.col("node").alias("a"), F.col("node_o").alias("b")).distinct(), "prefix-pairs")
    return materialize(verified(pairs, sets, rule), "prefix-links")


def near_groups(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are what stands between ASCII white space, ASCII letters in either case being equal.
    component_id is the smallest doc_id that links reach; a document without words (also null and
    empty text) has an empty set and is alone. Texts of equal sets are one component. doc_id is a key:
    rows that repeat one with different texts are one node, their links count together. A null doc_id
    stands for no node and is its own row with a null component, kept. An empty table gives an empty
    result; columns other than doc_id and text are not read.
    """
    prints = written(fingerprints(docs, rule.words), "fingerprints")
    nodes = prints.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest", "n", "registers", "bands").agg(F.min("doc_id").alias("node"))
    nodes = materialize(nodes, "nodes")
    shared = buckets(nodes.select("node", F.explode("bands").alias("key")))
    links = star_links(nodes, shared, docs, rule)
    labels = components(links)
    opened = open_nodes(nodes, shared, labels, rule)
    more = prefix_links(opened, docs, rule)
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    place = nodes.select("digest", "node").join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("label"))
    found = prints.select("doc_id", "n", "digest").join(place, "digest", "left")
    component = F.when(F.col("n") > 0, F.coalesce("label", "doc_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """The documents with one of each group of near copies, that with the smallest id; all columns kept.

    Rows that repeat an id stay or go together, rows without an id stay.
    """
    dropped = near_groups(docs, rule).where(~F.col("kept")).select("doc_id")
    return without(docs, dropped)
