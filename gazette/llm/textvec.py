"""Words, hashes and shingles of whole Arrow batches with numpy, without a Python object per word.

A batch's UTF-8 buffer is cut into slices of whole documents of about ``SLICE`` bytes, so the
working set of a task does not depend on how many rows Arrow puts in a batch.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from gazette.shared import materialize

#: Bytes of text handled at once (a longer document is a slice of its own).
SLICE = 1 << 20
#: Bytes of an Arrow batch.
BATCH = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"

U64 = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15


def release() -> None:
    """Give memory that is free back to the system; workers live on between tasks and share a limit with their executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """A function of batches that releases memory when its task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def byte_setting(said: str) -> int:
    """Bytes of a setting, with or without a unit (b, k, m, g, t, a second b allowed)."""
    number, unit = said.strip().lower(), 1
    if number.endswith("b"):
        number = number[:-1]
    if number and number[-1] in "kmgt":
        unit = 1 << 10 * ("kmgt".index(number[-1]) + 1)
        number = number[:-1]
    return int(number) * unit


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``BATCH`` bytes at most for what runs inside; the session's own setting comes back afterwards.

    Both the JVM, outside its heap, and the worker hold a batch whole, and long texts make the default of 64 MB.
    """
    said = spark.conf.get(_BATCH_KEY)
    if 0 < byte_setting(said) <= BATCH:
        yield
        return
    spark.conf.set(_BATCH_KEY, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_KEY, said)


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows of a frame that runs Python, computed once in small batches and read from the shared folder from now on."""
    with small_batches(rows.sparkSession):
        return materialize(rows, name)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values, so that close inputs have unrelated outputs."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(29))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


#: Word bytes: anything but the six ASCII white-space characters.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Word bytes: ASCII letters and digits, and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """Bytes with A to Z in lower case."""
    return _LOWER[data]


def lower_latin(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A to Z and U+00C0 to U+00DE (but the sign among them) in lower case, as long as before."""
    out = _LOWER[data]
    if len(data) > 1:
        wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[wide] += 0x20
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (from 0) of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE, rows: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about ``limit`` bytes each and ``rows`` rows at most, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n, a + rows)
        yield a, b
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of word bytes; runs end where a row ends."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = word[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[:-1][np.diff(offsets) > 0]
    first[edge] = inside[edge]
    edge = offsets[1:][np.diff(offsets) > 0] - 1
    last[edge] = inside[edge]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Spans of more bytes are hashed one by one with a cryptographic digest.
_LONG = 256


def eights(data: np.ndarray) -> np.ndarray:
    """A view: at each position the eight bytes from there on as one number, zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes.

    Spans are taken eight bytes at a time, each step a bijection of the state and of the block, so spans
    of equal length up to eight bytes never share a hash and longer ones only by chance: no sum or
    polynomial that repeated letters could make collide. Long spans get a BLAKE2b digest.
    """
    sizes = ends - starts
    out = mix(sizes.astype(U64) * U64(_MULTIPLIER))
    if not len(starts):
        return out
    view = eights(data)
    short = sizes <= _LONG
    live = np.flatnonzero(short & (sizes > 0))
    at = 0
    while len(live):
        left = sizes[live] - at
        block = view[starts[live] + at] & _MASKS[np.minimum(left, 8)]
        out[live] = mix(out[live] * U64(_MULTIPLIER) + block)
        at += 8
        live = live[left > 8]
    for k in np.flatnonzero(~short).tolist():
        out[k] = int.from_bytes(blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def words_of(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and start byte of each word, and the offsets of the rows' words."""
    starts, ends = word_spans(data, offsets, word)
    return span_hashes(data, starts, ends), starts, np.searchsorted(starts, offsets, "left")


def ngrams(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of n consecutive word hashes (of one row, if the input is)."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    total = np.full(len(hashes) - n + 1, U64(salt), U64)
    for k in range(n):
        total = mix(total * U64(_MULTIPLIER) + hashes[k : len(hashes) - n + 1 + k])
    return total


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of all elements of spans, span by span."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    return np.repeat(starts - total[:-1], sizes) + np.arange(total[-1])
