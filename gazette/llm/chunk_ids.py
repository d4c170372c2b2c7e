"""Byte-level BPE ids of whole batches: distinct pre-token chunks are encoded once by the tokenizers library.

A text is cut into runs of Latin letters (ASCII, and U+00C0 to U+00FF but the two signs) with the one
space before them, and what lies between. The byte-level pre-tokenizer starts a token at each of these
cuts, except where a contraction may begin the run (behind an apostrophe), where the neighbour is no
ASCII character and may be a letter too, or behind several white space characters; those cuts are left out. So the ids of a text are those of its
chunks in order. Special tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import json
import sys
import types

import numpy as np

from gazette.llm.textvec import _MASKS, eights, gathered, mix, span_hashes

#: Distinct chunks that a worker process remembers.
TABLE = 3_000_000

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PRINTED = np.zeros(256, bool)
_PRINTED[0x21:0x7F] = True
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


def process_cache(key, make):
    """One object per worker process, which survives from task to task."""
    module = sys.modules.setdefault("_gazette_process_cache", types.ModuleType("_gazette_process_cache"))
    if key not in module.__dict__:
        module.__dict__[key] = make()
    return module.__dict__[key]


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted byte positions at which chunks start, with the end of the data behind them; and which bytes are of Latin letters."""
    letter = _LETTER[data]
    wide = np.flatnonzero((data[:-1] == 0xC3) & _LATIN[data[1:]]) if len(data) > 1 else np.zeros(0, np.int64)
    letter[wide] = letter[wide + 1] = True
    mark = np.zeros(len(data) + 1, bool)
    begin = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
    end = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
    before = data[begin - 1]
    space = before == 0x20
    # One white space character alone is a token of its own; of several the last may be another token.
    alone = (before < 0x20) & _PRINTED[data[np.maximum(begin - 2, 0)]] & (begin >= 2)
    mark[(begin - space)[space | alone | ((before != 0x27) & _PRINTED[before])]] = True
    mark[end[data[end] < 0x80]] = True
    mark[offsets] = True
    mark[len(data)] = True
    return np.flatnonzero(mark), letter


class Slots:
    """Sorted hashes with their slots: a large table, and a small one that is merged into it now and then."""

    SMALL = 1 << 17

    def __init__(self) -> None:
        self.large = self.small = (np.zeros(0, np.uint64), np.zeros(0, np.int32))

    def __len__(self) -> int:
        return len(self.large[0]) + len(self.small[0])

    @staticmethod
    def _merged(a, b):
        at = np.searchsorted(a[0], b[0])
        return np.insert(a[0], at, b[0]), np.insert(a[1], at, b[1])

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Slots of sorted hashes, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        for known, slots in (self.large, self.small):
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                same = known[at] == keys
                out[same] = slots[at[same]]
        return out

    def add(self, keys: np.ndarray, slots: np.ndarray) -> None:
        """New sorted hashes."""
        self.small = self._merged(self.small, (keys, slots.astype(np.int32)))
        if len(self.small[0]) > self.SMALL:
            self.large = self._merged(self.large, self.small)
            self.small = (np.zeros(0, np.uint64), np.zeros(0, np.int32))


class Chunks:
    """Spans of a slice's bytes with their hashes; ``flag`` is a bit that tells equal spans apart."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, flag: np.ndarray | None = None) -> None:
        self.data, self.starts, self.ends = data, starts, ends
        self.marks = (ends - starts) * 2 + (0 if flag is None else flag)
        self.hashes = span_hashes(data, starts, ends)
        if flag is not None:
            self.hashes = mix(self.hashes + flag.astype(np.uint64))
        self.heads = eights(data)[starts] & _MASKS[np.minimum(ends - starts, 8)]

    def tails(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes beyond the eighth of some spans, and how many each has."""
        sizes = np.maximum(self.ends[which] - self.starts[which] - 8, 0)
        return self.data[gathered(self.starts[which] + 8, sizes)], sizes


class Arena:
    """Ids of distinct chunks: hash -> slot -> a span of one array, with the chunk's bytes to compare."""

    def __init__(self, kind: type, limit: int) -> None:
        self.kind, self.limit = kind, limit
        self.clear()

    def clear(self) -> None:
        self.slots, rows = Slots(), 1 << 16
        self.begin, self.length, self.tail = (np.zeros(rows, np.int32) for _ in range(3))
        self.mark, self.head = np.zeros(rows, np.int64), np.zeros(rows, np.uint64)
        self.arena, self.used = np.zeros(1 << 18, self.kind), 0
        self.text, self.written = np.zeros(1 << 18, np.uint8), 0

    def put(self, chunks: Chunks, which: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Slots of new chunks; their ids come one after another."""
        a, n = len(self.slots), len(which)
        while a + n > len(self.begin):
            self.begin, self.length, self.tail, self.mark, self.head = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length, self.tail, self.mark, self.head))
        while self.used + len(flat) > len(self.arena):
            self.arena = np.concatenate([self.arena, np.zeros_like(self.arena)])
        rest, long = chunks.tails(which)
        while self.written + len(rest) > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        self.begin[a : a + n] = self.used + np.cumsum(sizes) - sizes
        self.length[a : a + n] = sizes
        self.tail[a : a + n] = self.written + np.cumsum(long) - long
        self.mark[a : a + n], self.head[a : a + n] = chunks.marks[which], chunks.heads[which]
        self.arena[self.used : self.used + len(flat)] = flat
        self.text[self.written : self.written + len(rest)] = rest
        self.used, self.written = self.used + len(flat), self.written + len(rest)
        slots, order = np.arange(a, a + n), np.argsort(chunks.hashes[which])
        self.slots.add(chunks.hashes[which][order], slots[order])
        return slots

    def same(self, chunks: Chunks, slot: np.ndarray) -> bool:
        """Whether every chunk is, byte for byte, the one that its slot was made for."""
        if not ((self.mark[slot] == chunks.marks).all() and (self.head[slot] == chunks.heads).all()):
            return False
        rest, long = chunks.tails(more := np.flatnonzero(chunks.ends - chunks.starts > 8))
        return bool((self.text[gathered(self.tail[slot[more]].astype(np.int64), long)] == rest).all())

    def ids_of(self, chunks: Chunks, learn) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of all chunks in one array, and where each chunk's start; ``learn(which)`` gives ids and sizes of unknown ones.

        None if two different chunks share a hash: then the table can't speak for them.
        """
        keys, first, back = np.unique(chunks.hashes, return_index=True, return_inverse=True)
        if len(self.slots) > self.limit:
            self.clear()
        slot = self.slots.get(keys)
        new = np.flatnonzero(slot < 0)
        if len(new):
            which, flat, sizes = learn(first[new])
            where = np.empty(len(chunks.hashes), np.int64)
            where[which] = self.put(chunks, which, flat, sizes)
            slot[new] = where[first[new]]
        slot = slot[back]
        if not self.same(chunks, slot):
            return None
        sizes = self.length[slot].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(sizes)])
        return self.arena[gathered(self.begin[slot].astype(np.int64), sizes)], total


class ChunkIds:
    """The tokenizer with its table of distinct chunks."""

    def __init__(self, tokenizer_file: str, table: int = TABLE) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = True
        with open(tokenizer_file, encoding="utf-8") as f:
            said = json.load(f)
        pre = said.get("pre_tokenizer") or {}
        self.by_chunk = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not said.get("normalizer") and said["model"]["type"] == "BPE"
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0]
        self.by_chunk &= len(feed) == 1
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.arena = Arena(self.kind, table)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for y in ids for x in y), self.kind, int(sizes.sum())), sizes

    def _runs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs of letters, with or without a space before them, in one call of the library.

        A line feed between two of them is a token of its own, so its id marks where a run ends.
        """
        sizes = ends - starts
        said = np.full(int(sizes.sum()) + len(sizes), 0x0A, np.uint8)
        said[gathered(np.cumsum(sizes + 1) - sizes - 1, sizes)] = data[gathered(starts, sizes)]
        flat = np.array(self.tokenizer.encode_batch_fast([said[:-1].tobytes().decode()], add_special_tokens=False)[0].ids, self.kind)
        stops = np.concatenate([np.flatnonzero(flat == self.feed), [len(flat)]])
        return flat[flat != self.feed], np.diff(stops, prepend=-1) - 1

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in one array, and the offsets of the rows' ids."""
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(offsets), np.int64)
        found = self._by_chunk(data, offsets) if self.by_chunk else None
        if found is not None:
            return found
        raw = data.tobytes()
        ids, sizes = self._ids([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        return ids, np.concatenate([[0], np.cumsum(sizes)])

    def _by_chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The same from the table; None if it can't tell two chunks apart."""
        at, letter = cuts(data, offsets)
        chunks, letters = Chunks(data, at[:-1], at[1:]), np.concatenate([[0], np.cumsum(letter)])

        def learn(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            a, b = chunks.starts[which], chunks.ends[which]
            run = (letters[b] - letters[a] == b - a - (data[a] == 0x20)) & (letters[b] > letters[a])
            parts = []
            if run.any():
                parts.append((which[run], *self._runs(data, a[run], b[run])))
            if not run.all():
                other = ~run
                parts.append((which[other], *self._ids([data[x:y].tobytes().decode() for x, y in zip(a[other].tolist(), b[other].tolist(), strict=True)])))
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

        found = self.arena.ids_of(chunks, learn)
        return None if found is None else (found[0], found[1][np.searchsorted(at, offsets)])
