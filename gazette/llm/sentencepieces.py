"""SentencePiece encoding and decoding over a table of distinct marked words.

Where no piece of a model has a whitespace marker behind another character, no merge crosses the start
of a marked word (markers, then other characters). Each distinct marked word is then segmented once,
by the library, and a text's ids are those of its marked words in order. For any other model, or one
whose normalizer changes characters, whole texts go to the library.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.llm.chunk_ids import Arena, Chunks, process_cache
from gazette.llm.textvec import slices, tidy, utf8, written

MARK = "▁"
#: Distinct words that a worker process remembers.
TABLE = 1_000_000


class Codec:
    """A model with its table of distinct marked words."""

    def __init__(self, model_file: str, table: int = TABLE) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model_file)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        plain, normal, user = proto.trainer_spec, proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece.USER_DEFINED
        crossing = any(re.search(f"[^{MARK}]{MARK}", p.piece) or p.type == user for p in proto.pieces)
        self.by_word = not crossing and not plain.treat_whitespace_as_suffix and plain.byte_fallback and normal.name == "identity" and normal.add_dummy_prefix and normal.escape_whitespaces and not normal.remove_extra_whitespaces
        self.mark = [self.processor.piece_to_id(MARK)]
        self.names = [str(k) for k in range(self.processor.get_piece_size())]
        self.kind = np.uint16 if len(self.names) <= 1 << 16 else np.int32
        self.arena = Arena(self.kind, table)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in one array, and the offsets of the rows' ids."""
        found = self._by_word(data, offsets) if self.by_word else None
        if found is not None:
            return found
        raw = data.tobytes()
        rows = self.processor.encode([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], num_threads=1)
        return np.fromiter(chain.from_iterable(rows), self.kind), np.cumsum([0, *map(len, rows)])

    def _by_word(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The same from the table; None if it can't tell two words apart."""
        raw = data.tobytes()
        if MARK.encode() in raw:
            rows = [raw[a:b].replace(MARK.encode(), b" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            raw, offsets = b"".join(rows), np.cumsum([0, *map(len, rows)])
            data = np.frombuffer(raw, np.uint8)
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(offsets), np.int64)
        space = data == 0x20
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        mark = np.concatenate([begins, [True]])
        mark[offsets] = True
        at = np.flatnonzero(mark)
        # A row's first word has the library's own marker before whatever markers it starts with; another gives its first one up for that.
        leads = np.zeros(len(data) + 1, bool)
        leads[offsets[:-1][np.diff(offsets) > 0]] = True
        whole = leads[at[:-1]]
        chunks = Chunks(data, at[:-1], at[1:], whole)

        def learn(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            a = chunks.starts[which] + ~whole[which]
            words = [raw[x:y].decode() for x, y in zip(a.tolist(), chunks.ends[which].tolist(), strict=True)]
            found = [ids if w else self.mark for w, ids in zip(words, self.processor.encode(words, num_threads=1), strict=True)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            return which, np.fromiter(chain.from_iterable(found), self.kind, int(sizes.sum())), sizes

        found = self.arena.ids_of(chunks, learn)
        return None if found is None else (found[0], found[1][np.searchsorted(at, offsets)])


def encode_documents(docs: DataFrame, model_file: str, table: int = TABLE, extra: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``extra`` ids and decoded.

    Null counts as empty, which has no ids. Rows that repeat give rows that repeat, a null doc_id stays
    null, an empty table gives an empty result; columns other than doc_id and text are not read. Words
    are compared byte for byte with the table's, so texts whose words share a hash get the library's ids too.
    """
    columns = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    columns += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if extra else []
    schema = pa.schema(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = process_cache(("pieces", model_file, table), lambda: Codec(model_file, table))
        name, decode = codec.names.__getitem__, codec.processor.decode
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets):
                o = offsets[a : b + 1]
                flat, bounds = codec.encode(data[o[0] : o[-1]], o - o[0])
                rows = []
                for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    ids = flat[x:y].tolist()
                    text = decode(ids)
                    rows.append((len(ids), sha(",".join(map(name, ids))), sha(text), *((ids, text) if extra else ())))
                arrays = [batch.column(0)[a:b], *(pa.array(list(x), t) for x, (_, t) in zip(zip(*rows, strict=True), columns[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    said = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * extra
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), said), "pieces")
