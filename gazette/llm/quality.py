"""Quality scores: logistic regression over hashed word n-grams, fitted with FTRL, scored as sparse dot products.

Tokens are runs of letters and digits and runs of other printing characters. Features are hashed token
uni- and bigrams, and n-grams of token shapes (case, digits, the symbols themselves, and whether a token
repeats one of the two before it), which carry over to words never seen. A feature's value is its share
of the text's tokens, so texts of any length compare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.ftrl import fit, hash_of, held_out, sample_ids, sigmoid
from gazette.llm.textvec import ALNUM, NOT_SPACE, U64, lower_ascii, mix, slices, span_hashes, tidy, utf8, written

#: Columns of the model; column 0 is the constant. Half the number of labelled texts taken of each class at most.
COLUMNS, SAMPLE = 1 << 20, 1500
#: A feature that every token has gets this value.
SCALE = 4.0

_KIND = np.where(ALNUM, 1, np.where(NOT_SPACE, 2, 0)).astype(np.int8)
_UPPER, _LOWER, _DIGIT = (np.zeros(256, np.int64) for _ in range(3))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column of each feature that occurs, its row, and each row's number of tokens."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(rows, np.int64)
    kind = _KIND[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    at = np.flatnonzero(change)
    token = kind[at[:-1]] > 0
    starts, ends = at[:-1][token], at[1:][token]
    symbol = kind[starts] == 2
    words = span_hashes(lower_ascii(data), starts, ends)
    sums = [np.concatenate([[0], np.cumsum(x[data])]) for x in (_UPPER, _LOWER, _DIGIT)]
    upper, lower, digit = (s[ends] - s[starts] for s in sums)
    shape = ((upper > 0) + 2 * (lower > 0) + 4 * (digit > 0) + 8 * (upper > 1)).astype(U64)
    shape = np.where(symbol, words, shape)
    row = np.searchsorted(offsets, starts, "right") - 1
    again = np.zeros(len(words), U64)
    for k in (1, 2):
        again[k:] |= ((words[k:] == words[:-k]) & (row[k:] == row[:-k]) & ~symbol[k:]).astype(U64) << U64(k - 1)
    shape = mix(shape + (again << U64(60)) + U64(7))
    out, where = [], []
    for hashes, n in ((words, 1), (words, 2), (shape, 1), (shape, 2), (shape, 3)):
        m = len(hashes) - n + 1
        if m <= 0:
            continue
        total = np.full(m, U64(n + 10 * (hashes is shape)), U64)
        for k in range(n):
            total += hashes[k : m + k] * U64((2 * k + 3) * 0x9E3779B97F4A7C15 % (1 << 64))
        same = row[:m] == row[n - 1 :]
        out.append((mix(total)[same] % U64(COLUMNS - 1)).astype(np.int64) + 1)
        where.append(row[:m][same])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out]), np.concatenate([none, *where]), np.bincount(row, minlength=rows)


def collect(docs: DataFrame, ids: DataFrame) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Features of the sampled texts in a fixed order, one text for each id. The sample is bounded, so its ids are broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                o = offsets[a : b + 1]
                column, row, tokens = features(data[o[0] : o[-1]], o - o[0])
                packed = []
                for k in range(b - a):
                    c, n = np.unique(column[row == k], return_counts=True)
                    packed.append(c.astype(np.int32).tobytes() + (n * (SCALE / max(1, tokens[k]))).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], pa.array(packed, pa.binary())], names=["doc_id", "label", "shares"])

    sampled = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "label")
    found = written(sampled.mapInArrow(tidy(run), "doc_id long, label int, shares binary"), "quality-sample")
    rows = found.groupBy("doc_id", "label").agg(F.min("shares").alias("shares")).collect()
    rows.sort(key=lambda r: (hash_of(r.doc_id), r.label))
    halves = [(r.shares, len(r.shares) // 8, float(r.label)) for r in rows]
    return [(np.frombuffer(x, np.int32, n).astype(np.int64), np.frombuffer(x, np.float32, n, 4 * n).astype(np.float64), y) for x, n, y in halves]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", size: int = SAMPLE) -> np.ndarray:
    """Weights, from at most twice ``size`` whole labelled texts of each class that aren't held out; zeros without any."""
    return fit(collect(docs, sample_ids(labels, label, size)), COLUMNS).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score of every whole text; null and empty texts have no features and get the constant's score."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value.astype(np.float64)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                o = offsets[a : b + 1]
                column, row, tokens = features(data[o[0] : o[-1]], o - o[0])
                total = np.bincount(row, own[column], b - a) * (SCALE / np.maximum(1, tokens)) + own[0]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(sigmoid(total), pa.float64())], schema=schema)

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, score double"), "quality")


def score_documents(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every document, learned from the labels that aren't held out.

    Null and empty texts have no features and get the constant's score. Rows that repeat give rows that
    repeat; of rows that repeat a sampled id one takes part in training. A null doc_id stays null and
    counts as held out. An id with both labels takes part with each. Without labels every score is 0.5,
    which predicts 1; an empty table of documents gives an empty result. Other columns are not read.
    """
    scored = score(docs, train(docs, labels, size=size))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
