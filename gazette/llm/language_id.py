"""Language identification with string kernels.

A text is the set of byte n-grams (n of 1 to 3, blended) of its letters, with other characters as blanks,
ASCII and Latin-1 letters in lower case. The kernel of two texts is the number of n-grams present in
both, over the root of the product of their own numbers. Landmarks are texts of a bounded labelled
sample; kernel ridge regression in their span (Nystroem) gives a function per language, one against
the rest. Presence sets are hashed into a fixed number of columns, so a batch of texts is scored by two
matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.textvec import ALNUM, U64, lower_latin, mix, slices, tidy, utf8, written

COLUMNS = 1 << 13
#: Texts whose presence rows are held at once.
ROWS = 128
ORDERS = (1, 2, 3)
#: Labelled texts taken for each language, landmarks among them, and the ridge.
SAMPLE, LANDMARKS, RIDGE = 300, 16, 1e-3
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[~ALNUM] = 0x20
_FOLD[48:58] = 0x20
_FOLD[65:91] += 32


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ones and zeros per text: which hashed n-grams it has."""
    n = len(offsets) - 1
    out = np.zeros((n, COLUMNS), np.float32)
    if not len(data):
        return out
    x = _FOLD[lower_latin(data)]
    row = np.repeat(np.arange(n), np.diff(offsets))
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    blank = x == 0x20
    keep = np.ones(len(x), bool)
    keep[1:] = ~(blank[1:] & blank[:-1]) | first[1:-1]
    x, row = x[keep].astype(U64), row[keep]
    flat = out.reshape(-1)
    for k in ORDERS:
        if len(x) < k:
            break
        gram = x[: len(x) - k + 1].copy()
        for i in range(1, k):
            gram = gram << U64(8) | x[i : len(x) - k + 1 + i]
        column = (mix(gram + U64(k << 40)) >> U64(40)).astype(np.int64) % COLUMNS
        same = row[: len(x) - k + 1] == row[k - 1 :]
        flat[(row[: len(x) - k + 1] * COLUMNS + column)[same]] = 1
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Shared n-grams over the root of the product of own numbers; 0 where a text has none."""
    own = np.sqrt(np.maximum(x.sum(1), 1)[:, None] * np.maximum(y.sum(1), 1)[None, :])
    return (x @ y.T) / own


class Model:
    """Landmarks with coefficients per language."""

    def __init__(self, langs: list[str], landmarks: np.ndarray, weights: np.ndarray) -> None:
        self.langs, self.landmarks, self.weights = langs, landmarks, weights

    @classmethod
    def fit(cls, langs: list[str], sets: np.ndarray, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
        """Languages and presence rows of a sample in a fixed order; the first rows of a language are landmarks."""
        names = sorted(set(langs))
        own = np.array([names.index(x) for x in langs])
        chosen = np.concatenate([np.flatnonzero(own == c)[:landmarks] for c in range(len(names))])
        gram = kernel(sets, sets[chosen]).astype(np.float64)
        target = np.where(own[:, None] == np.arange(len(names)), 1.0, -1.0)
        weight = (len(own) / (len(names) * np.bincount(own)))[own][:, None]
        left = gram.T @ (gram * weight) + ridge * len(own) * kernel(sets[chosen], sets[chosen]) + 1e-9 * np.eye(len(chosen))
        return cls(names, sets[chosen].astype(np.uint8), np.linalg.solve(left, gram.T @ (target * weight)).astype(np.float32))

    def predict(self, sets: np.ndarray, known: np.ndarray) -> tuple[list[str], np.ndarray]:
        values = kernel(sets, self.landmarks.astype(np.float32)) @ self.weights
        best = values.argmax(1)
        score = np.clip((values[np.arange(len(best)), best] + 1) / 2, 0, 1).astype(np.float64)
        return [self.langs[c] if k else UNKNOWN for c, k in zip(best, known, strict=True)], np.where(known, score, 0.0)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def sample(rows: DataFrame, label: str, size: int) -> DataFrame:
    """About ``size`` to twice ``size`` rows of each label (all, if fewer), by a hash of their ids: (label, hash, text)."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return rows.select(F.col(label).alias("label"), F.xxhash64("doc_id").alias("hash"), "text").limit(0)
    space = 1 << 30
    part = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(space, 2 * size * space // n))]), F.col(label))
    hashed = F.xxhash64("doc_id")
    return rows.where(F.pmod(hashed, F.lit(space)) < part).select(F.col(label).alias("label"), hashed.alias("hash"), "text")


def train(labelled: DataFrame, size: int = SAMPLE) -> Model | None:
    """Fit on a bounded sample of (doc_id, text, lang): ``size`` texts at most of each language, whole; None if there is none.

    Only presence bits reach the driver: a kilobyte for each text of the sample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for a, b in slices(offsets, rows=ROWS):
                o = offsets[a : b + 1]
                bits = np.packbits(presence(data[o[0] : o[-1]], o - o[0]).astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array([x.tobytes() for x in bits], pa.binary())], names=["label", "hash", "bits"])

    sampled = sample(labelled.where("lang IS NOT NULL AND text RLIKE '\\\\p{L}'"), "lang", size).mapInArrow(tidy(run), "label string, hash long, bits binary")
    # One text for each id, so rows that repeat one don't outgrow the sample.
    rows = written(sampled, "language-sample").groupBy("label", "hash").agg(F.min("bits").alias("bits")).collect()
    taken: dict[str, int] = {}
    kept = []
    for r in sorted(rows, key=lambda r: (r.label, r.hash, r.bits)):
        taken[r.label] = taken.get(r.label, 0) + 1
        if taken[r.label] <= size:
            kept.append(r)
    if not kept:
        return None
    sets = np.unpackbits(np.array([np.frombuffer(r.bits, np.uint8) for r in kept]), axis=1).astype(np.float32)
    return Model.fit([r.label for r in kept], sets)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every whole text. Texts that are null or have no letter are ``und`` with score 0, all texts if nothing was learned."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, rows=ROWS):
                o = offsets[a : b + 1]
                part = data[o[0] : o[-1]]
                sums = np.concatenate([[0], np.cumsum(ALNUM[part] & ~((part >= 48) & (part < 58)) & (part < 128))])[o - o[0]]
                known = np.diff(sums) > 0
                for k in np.flatnonzero(~known):
                    known[k] = has_letter(batch.column(1)[a + int(k)].as_py())
                if fitted is None:
                    langs, scores = [UNKNOWN] * (b - a), np.zeros(b - a)
                else:
                    langs, scores = fitted.predict(presence(part, o - o[0]), known)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double"), "languages")


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees; a null id is among them."""
    return F.coalesce(fold(doc_id, 4) == 2, F.lit(True))


def predict_documents(docs: DataFrame, size: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learned from the rows that aren't held out.

    Texts that are null, empty or without a letter are ``und``. Rows that repeat give rows that repeat; of
    rows that repeat a sampled id one takes part in training. A null doc_id stays null and counts as held
    out. Of equal values the language first by name is taken. Where no row says its language every text is
    ``und``; an empty table gives an empty result. Columns other than doc_id, text and lang are not read.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), size)
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
