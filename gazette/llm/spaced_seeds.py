"""Benchmark decontamination with spaced seeds.

A mask of ones and zeros, laid over consecutive words, hashes the words under ones and ignores the
others, so a hit survives substitutions under zeros. Hits of document words on benchmark words give
diagonals; along each the words are compared one by one, and an overlap counts if a stretch of at least
``least`` words (or of the whole item, if that is shorter) has ``share`` of its words equal.

With the masks below no such overlap is missed at a share of 0.8: a stretch of 16 words or more, or one
of fewer that is not 111x111x111x111 or a part of it, has four equal words in a row (mask 1111); the rest has
a hit of one of the others.

A document and an item meet by the seeds that they share, each counted once with its places. Where
repeated words give more hits than the two have diagonals, all diagonals are taken instead of hits; a
diagonal that is no longer than the best overlap so far is not looked at. So neither time nor memory
goes with the product of places, however often a word stands in a row.

The benchmark is a query set in blocks of bounded bytes: each block's seeds are sent to the executors,
every document is read once for it, and what is found is written before the next block is made.
Documents are never joined with each other or shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.rows import without_found
from gazette.llm.textvec import ALNUM, U64, gathered, lower_latin, mix, slices, small_batches, tidy, utf8, words_of
from gazette.shared import new_path

MASKS = ("1111", "11101", "10111", "11011")
#: Words that an overlap must span; equal words for each ten.
LEAST, SHARE_OF_TEN = 13, 8
#: Items of fewer words have no seed and are not looked for.
SHORTEST = 4
#: Pairs of a document and an item that are held at once.
PAIRS = 1 << 18
#: Bytes of benchmark text whose seeds are held by an executor at once.
BLOCK = 4 << 20

RESULT = "doc_id long, item_id long, doc_word long, item_word long, words long, equal_words long"


def seeds(hashes: np.ndarray, mask: str, k: int) -> np.ndarray:
    """Hash of the words under the mask at each position where it fits."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.full(n, U64(k * 0x632BE59BD9B4E019 % (1 << 64)), U64)
    for i, bit in enumerate(mask):
        if bit == "1":
            total += hashes[i : i + n] * U64((2 * i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    return mix(total)


def overlap(equal: np.ndarray, least: int, share: int = SHARE_OF_TEN) -> tuple[int, int] | None:
    """The longest stretch of at least ``least`` positions of which ``share`` in ten are equal; the first of several."""
    n = len(equal)
    if n < least or not least:
        return None
    sums = np.concatenate([[0], np.cumsum(equal * 10 - share)])
    low = np.minimum.accumulate(sums)
    ends = np.flatnonzero(sums[least:] >= low[: n + 1 - least]) + least
    if not len(ends):
        return None
    # low falls, so the first start that is no higher than an end is found by bisection.
    begins = np.searchsorted(-low, -sums[ends], "left")
    best = int(np.argmax(ends - begins))
    return int(begins[best]), int(ends[best])


def longest(doc: np.ndarray, own: np.ndarray, shifts: np.ndarray, least: int) -> tuple[int, int, int, int] | None:
    """(word in doc, word in own, words, equal words) of the longest overlap on the given diagonals, the first of several by diagonal."""
    best, most = None, 0
    begin, end = np.maximum(0, -shifts), np.minimum(len(own), len(doc) - shifts)
    for shift, a, b in zip(shifts.tolist(), begin.tolist(), end.tolist(), strict=True):
        if b - a <= most or b - a < least:
            continue
        equal = doc[a + shift : b + shift] == own[a:b]
        if (found := overlap(equal, least)) and found[1] - found[0] > most:
            most = found[1] - found[0]
            best = a + shift + found[0], a + found[0], most, int(equal[slice(*found)].sum())
    return best


@dataclass
class Block:
    """Benchmark items with the sorted table of their seeds: for each seed the items that have it, and how often."""

    ids: list[int]
    words: np.ndarray
    offsets: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    often: np.ndarray
    bloom: np.ndarray

    @classmethod
    def of(cls, ids: list[int], texts: list[str], masks: tuple[str, ...]) -> Block:
        data, offsets = utf8(pa.array(texts, pa.string()))
        words, _, bounds = words_of(lower_latin(data), offsets, ALNUM)
        keys, items, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for j, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if b - a >= SHORTEST:
                found, n = np.unique(np.concatenate([seeds(words[a:b], mask, k) for k, mask in enumerate(masks)]), return_counts=True)
                keys.append(found)
                items.append(np.full(len(found), j))
                counts.append(n)
        key, item, often = np.concatenate(keys), np.concatenate(items), np.concatenate(counts)
        order = np.argsort(key, kind="stable")
        unique, first = np.unique(key[order], return_index=True)
        bloom = np.zeros(1 << 22, bool)
        bloom[(unique & U64((1 << 22) - 1)).astype(np.int64)] = True
        return cls(ids, words, bounds, unique, np.append(first, len(key)), item[order], often[order], bloom)

    def find(self, words: np.ndarray, bounds: np.ndarray, masks: tuple[str, ...], least: int) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(row, item, word in row, word in item, words, equal words): the longest overlap of each row and item."""
        hits, rows, places = [], [], []
        for k, mask in enumerate(masks):
            found = seeds(words, mask, k)
            maybe = np.flatnonzero(self.bloom[(found & U64((1 << 22) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, found[maybe]), max(0, len(self.keys) - 1))
            true = self.keys[at] == found[maybe] if len(self.keys) else np.zeros(len(maybe), bool)
            where, at = maybe[true], at[true]
            row = np.searchsorted(bounds, where, "right") - 1
            inside = where + len(mask) <= bounds[row + 1]
            hits.append(at[inside])
            rows.append(row[inside])
            places.append(where[inside])
        hit, row, place = (np.concatenate(x) for x in (hits, rows, places))
        order = np.lexsort((place, hit, row))
        hit, row, place = hit[order], row[order], place[order]
        # One entry for each row and seed; its places are the hits from there to the next.
        starts = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1]) | (row[1:] != row[:-1])])) if len(hit) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(hit)) if len(hit) else starts
        sizes = (self.first[1:] - self.first[:-1])[hit[starts]]
        total, a = np.cumsum(sizes), 0
        while a < len(starts):
            # Whole rows, as many as have about so many pairs of a seed and an item.
            b = int(np.searchsorted(total, total[a] + PAIRS, "right"))
            b = max(b, a + 1)
            b = int(np.searchsorted(row[starts], row[starts[b - 1]], "right"))
            yield from self._pairs(words, bounds, masks, least, row, place, starts[a:b], ends[a:b], hit[starts[a:b]])
            a = b

    def _pairs(self, words, bounds, masks, least, row, place, starts, ends, hit) -> Iterator[tuple[int, int, int, int, int, int]]:
        """The longest overlaps of rows, given by their seeds and the places of each."""
        sizes = self.first[hit + 1] - self.first[hit]
        entry = gathered(self.first[hit], sizes)
        group = np.repeat(np.arange(len(hit)), sizes)
        order = np.lexsort((group, self.item[entry], row[starts[group]]))
        entry, group = entry[order], group[order]
        of_row, of_item = row[starts[group]], self.item[entry]
        edges = np.flatnonzero(np.concatenate([[True], (of_row[1:] != of_row[:-1]) | (of_item[1:] != of_item[:-1]), [True]])) if len(entry) else []
        expected = self.often[entry] * (ends - starts)[group]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            r, j = int(of_row[x]), int(of_item[x])
            doc, own = words[bounds[r] : bounds[r + 1]], self.words[self.offsets[j] : self.offsets[j + 1]]
            if expected[x:y].sum() >= len(doc) + len(own):
                shifts = np.arange(-len(own) + 1, len(doc))
            else:
                shifts = self._diagonals(doc, own, masks, np.concatenate([place[starts[g] : ends[g]] for g in group[x:y].tolist()]) - bounds[r])
            if best := longest(doc, own, shifts, min(least, len(own))):
                yield r, j, *best

    @staticmethod
    def _diagonals(doc: np.ndarray, own: np.ndarray, masks: tuple[str, ...], places: np.ndarray) -> np.ndarray:
        """Place in the document less place in the item of each seed that both have, sorted."""
        places, out = np.unique(places), []
        for k, mask in enumerate(masks):
            theirs = seeds(own, mask, k)
            order = np.argsort(theirs, kind="stable")
            here = places[places + len(mask) <= len(doc)]
            mine = np.full(len(here), U64(k * 0x632BE59BD9B4E019 % (1 << 64)), U64)
            for i, bit in enumerate(mask):
                if bit == "1":
                    mine += doc[here + i] * U64((2 * i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            mine = mix(mine)
            lo, hi = (np.searchsorted(theirs[order], mine, side) for side in ("left", "right"))
            out.append(np.repeat(here, hi - lo) - order[gathered(lo, hi - lo)])
        return np.unique(np.concatenate(out))


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """One row for each document and benchmark item that overlap, with the longest overlap.

    Words are runs of ASCII letters, digits and any non-ASCII characters; ASCII and Latin-1 letters in
    either case are equal. Null and empty texts and items of fewer than four words overlap with
    nothing; an empty benchmark or table gives an empty result. Rows that repeat give rows that repeat
    on the document side, a null doc_id stays null; benchmark rows count once for each item_id and text.
    Of overlaps of one length the one on the lowest diagonal is given, there the first. Other columns are not read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    path, blocks = new_path(spark, "overlaps"), -(-total // block)
    spark.createDataFrame([], RESULT).write.parquet(path)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        if rows:
            search(docs, Block.of([r.item_id for r in rows], [r.text for r in rows], masks), masks, least, path)
    return spark.read.schema(RESULT).parquet(path)


def search(docs: DataFrame, queries: Block, masks: tuple[str, ...], least: int, path: str) -> None:
    """Append the overlaps of one block under the path. The broadcast, whose size follows ``BLOCK`` and not the tables, goes when they are written."""
    schema = pa.schema([(x.split()[0], pa.int64()) for x in RESULT.split(", ")])
    sent = docs.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            doc_ids, rows = batch.column(0).to_pylist(), []
            for a, b in slices(offsets):
                o = offsets[a : b + 1]
                words, _, bounds = words_of(lower_latin(data[o[0] : o[-1]]), o - o[0], ALNUM)
                for row, item, *rest in table.find(words, bounds, masks, least):
                    rows.append(dict(zip(schema.names, (doc_ids[a + row], table.ids[item], *rest), strict=True)))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    with small_batches(docs.sparkSession):
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), RESULT).write.mode("append").parquet(path)
    sent.destroy()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap with no benchmark item, all columns kept; rows that repeat an id go together, those without one each for its own text."""
    return without_found(docs, lambda rows: contaminated(rows, benchmark))
