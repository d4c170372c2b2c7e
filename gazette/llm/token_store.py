"""Token ids in a content-addressed store.

Layout under a path: ``packs/`` holds blocks of ids (zstd) written by tasks; ``index`` says for each
chunk digest where its one copy is; ``recipes`` holds, in ascending order of doc_id, each document's
chunk digests, its first position in the whole id stream and the Merkle root of its chunks;
``manifest`` holds the Merkle root of each part of the recipes.

A rolling hash over ids cuts streams where its low bits are zero, so equal passages give equal chunks
wherever they stand. A chunk's digest is of its ids as little-endian 32-bit integers.

Recipes come in parts of about ``PART`` ids, and a part's root is made of the roots of its groups of
``GROUP`` documents, so neither a task nor a list of leaves grows with the store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gazette.llm.chunk_ids import ChunkIds, process_cache
from gazette.llm.files import attempt_name, open_fs
from gazette.shared import materialize, new_path, remove
from gazette.llm.textvec import U64, mix, slices, small_batches, tidy, utf8, written

#: Ids that the rolling hash sees; bits that are zero at a cut; least and most ids of a chunk.
WINDOW, BITS, LEAST, MOST = 8, 9, 128, 2048
#: Ids of a part of the recipes; documents whose roots are leaves of one tree in the manifest.
PART, GROUP = 1 << 26, 4096
#: Bytes of ids in a block before compression.
BLOCK = 128 << 10
DIGEST = 16

PLACE = "file string, block long, size int, at int, n int"
_PLACE = [("file", pa.string()), ("block", pa.int64()), ("size", pa.int32()), ("at", pa.int32()), ("n", pa.int32())]
_INDEX = pa.schema([("digest", pa.binary()), *_PLACE])
_ODD = 0xD1342543DE82EF95
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


class StoreError(ValueError):
    """A store whose contents differ from its recipes."""


def digest_of(ids: np.ndarray) -> bytes:
    return hashlib.blake2b(ids.astype("<u4").tobytes(), digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over the leaves; an odd one moves up as it is, no leaves give the digest of nothing."""
    if not leaves:
        return hashlib.blake2b(b"", digest_size=DIGEST).digest()
    while len(leaves) > 1:
        pairs = [hashlib.blake2b(b"\1" + a + b, digest_size=DIGEST).digest() for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves = pairs + leaves[-1:] * (len(leaves) % 2)
    return leaves[0]


def cut(ids: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Iterator[list[int]]:
    """For each row of ids the ends of its chunks; each depends on that row's ids alone."""
    n = len(ids)
    up, down = (np.cumprod(np.concatenate([np.ones(1, U64), np.full(n, U64(x), U64)])) for x in (_ODD, _ODD_INVERSE))
    sums = np.zeros(n + 1, U64)
    np.cumsum(table[ids] * up[:-1], out=sums[1:])
    rolled = mix((sums[WINDOW:] - sums[: max(0, n + 1 - WINDOW)]) * down[: max(0, n + 1 - WINDOW)])
    ends = np.flatnonzero(rolled & U64((1 << BITS) - 1) == 0) + WINDOW
    bounds = np.searchsorted(ends, offsets[:-1] + WINDOW), np.searchsorted(ends, offsets[1:])
    for a, b, x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), bounds[0].tolist(), bounds[1].tolist(), strict=True):
        found, last = [], a
        for e in [*ends[x:y].tolist(), b]:
            while e - last > MOST:
                last += MOST
                found.append(last)
            if e - last >= LEAST or e == b and e > last:
                found.append(e)
                last = e
        yield found


class Packer:
    """Writes chunks into blocks of a pack and says where each went."""

    def __init__(self, path: str, kind: str) -> None:
        self.system, self.base = open_fs(f"{path}/packs")
        self.system.create_dir(self.base, recursive=True)
        self.name, self.kind = attempt_name("pack", f".{kind}.zst"), kind
        self.out, self.offset, self.held, self.bytes, self.placed = None, 0, [], 0, []

    def add(self, digest: bytes, ids: np.ndarray) -> None:
        raw = ids.astype(self.kind).tobytes()
        self.held.append((digest, raw, len(ids)))
        self.bytes += len(raw)
        if self.bytes >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        import zstandard

        if self.out is None:
            self.out = self.system.open_output_stream(f"{self.base}/{self.name}", compression=None)
        packed, at = zstandard.ZstdCompressor(level=3).compress(b"".join(x[1] for x in self.held)), 0
        for digest, raw, n in self.held:
            self.placed.append((digest, self.name, self.offset, len(packed), at, n))
            at += len(raw)
        self.out.write(packed)
        self.offset += len(packed)
        self.held, self.bytes = [], 0

    def close(self) -> None:
        self.flush()
        if self.out is not None:
            self.out.close()

    def take(self) -> list[dict]:
        rows = [dict(zip(("digest", "file", "block", "size", "at", "n"), x, strict=True)) for x in self.placed]
        self.placed = []
        return rows


class Blocks:
    """Reads blocks of packs, and keeps the last few."""

    def __init__(self, path: str, keep: int = 32) -> None:
        self.system, self.base = open_fs(f"{path}/packs")
        self.files: OrderedDict = OrderedDict()
        self.blocks: OrderedDict = OrderedDict()
        self.keep = keep

    def get(self, file: str, block: int, size: int, at: int, n: int) -> np.ndarray:
        import zstandard

        key = (file, block)
        if key in self.blocks:
            self.blocks.move_to_end(key)
        else:
            if file not in self.files:
                self.files[file] = self.system.open_input_file(f"{self.base}/{file}")
                if len(self.files) > self.keep:
                    self.files.popitem(last=False)[1].close()
            self.blocks[key] = zstandard.ZstdDecompressor().decompress(self.files[file].read_at(size, block))
            if len(self.blocks) > self.keep:
                self.blocks.popitem(last=False)
        return np.frombuffer(self.blocks[key], file.split(".")[-2], n, at)


_ENTRY = "array<struct<digest:binary,file:string,block:long,size:int,at:int,n:int>>"
_INGEST = f"doc_id long, n_tokens long, root binary, chunks array<binary>, stored {_ENTRY}"


def ingest(docs: DataFrame, path: str, tokenizer_file: str, end_id: int) -> DataFrame:
    """Encode, cut and pack. Rows of documents (doc_id, n_tokens, root, chunks) and rows of index entries (stored).

    A task writes each chunk that it meets once.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("chunks", pa.list_(pa.binary())), ("stored", pa.list_(pa.struct(list(_INDEX))))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = process_cache(("ids", tokenizer_file), lambda: ChunkIds(tokenizer_file))
        table = mix(np.arange(1, coder.size + 2, dtype=U64) * U64(_ODD))
        packer, seen = Packer(path, "u2" if coder.kind == np.uint16 else "u4"), set()
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            doc_ids = batch.column(0).to_pylist()
            for a, b in slices(offsets):
                o = offsets[a : b + 1]
                found, bounds = coder.encode(data[o[0] : o[-1]], o - o[0])
                ids = np.insert(found, bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
                rows = []
                for k, ends in enumerate(cut(ids, bounds, table)):
                    leaves, last = [], int(bounds[k])
                    for e in ends:
                        chunk = ids[last:e]
                        last, digest = e, digest_of(chunk)
                        leaves.append(digest)
                        if digest not in seen:
                            seen.add(digest)
                            packer.add(digest, chunk)
                    rows.append({"doc_id": doc_ids[a + k], "n_tokens": int(bounds[k + 1] - bounds[k]), "root": merkle(leaves), "chunks": leaves, "stored": None})
                rows.append(dict.fromkeys(schema.names) | {"stored": packer.take()})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
        packer.close()
        yield pa.RecordBatch.from_pylist([dict.fromkeys(schema.names) | {"stored": packer.take()}], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), _INGEST)


def compact(entries: DataFrame, path: str) -> DataFrame:
    """One place for each digest: packs that hold a chunk which another pack keeps are written anew without it."""
    spark = entries.sparkSession
    place = F.struct("file", "block", "size", "at", "n").alias("place")
    chosen = entries.groupBy("digest").agg(F.min(place).alias("place")).select("digest", "place.*")
    entries_of = F.count(F.lit(1)).alias("had")
    had = entries.groupBy("file").agg(entries_of)
    kept = chosen.groupBy("file").agg(F.collect_list(F.struct("block", "at", "size", "n", "digest")).alias("kept"))
    packs = had.join(kept, "file", "left")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(path)
        for batch in batches:
            for x in batch.to_pylist():
                kept = sorted(x["kept"] or (), key=lambda e: (e["block"], e["at"]))
                if len(kept) == x["had"]:
                    rows = [e | {"file": x["file"]} for e in kept]
                    yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)
                    continue
                packer = Packer(path, x["file"].split(".")[-2])
                for e in kept:
                    packer.add(e["digest"], blocks.get(x["file"], e["block"], e["size"], e["at"], e["n"]))
                packer.close()
                yield pa.RecordBatch.from_pylist(packer.take(), schema=_INDEX)

    with small_batches(spark):
        packs.mapInArrow(tidy(rewrite), f"digest binary, {PLACE}").write.parquet(f"{path}/index")
    return spark.read.schema(f"digest binary, {PLACE}").parquet(f"{path}/index")


def sweep(path: str, entries: DataFrame, index: DataFrame) -> None:
    """Delete the packs that the index no longer names, each by the task that meets its name."""
    dead = entries.select("file").distinct().join(index.select("file").distinct(), "file", "left_anti")

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_fs(f"{path}/packs")
        for batch in batches:
            for name in batch.column(0).to_pylist():
                if system.get_file_info(f"{base}/{name}").type.name == "File":
                    system.delete_file(f"{base}/{name}")
            yield batch

    dead.mapInArrow(tidy(delete), "file string").write.format("noop").mode("overwrite").save()


def write_store(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 0) -> None:
    """Write the ids of every whole text, ``end_id`` behind each, in ascending doc_id order.

    Null text counts as empty and has the end id alone. Rows that repeat a doc_id stand side by side,
    in order of their roots; a null doc_id comes first. An empty table gives an empty store. Columns other
    than doc_id and text are not read.
    """
    spark = docs.sparkSession
    staged = f"{path}/ingest"
    with small_batches(spark):
        ingest(docs, path, tokenizer_file, end_id).write.parquet(staged)
    rows = spark.read.schema(_INGEST).parquet(staged)
    entries = rows.where("stored IS NOT NULL").select(F.explode("stored").alias("x")).select("x.*")
    index = compact(entries, path)
    sweep(path, entries, index)
    recipes = rows.where("stored IS NULL").select("doc_id", "n_tokens", "root", "chunks")
    parts = max(1, -(-(recipes.agg(F.sum("n_tokens")).first()[0] or 0) // PART))
    ordered = recipes.repartitionByRange(parts, "doc_id", "root").sortWithinPartitions("doc_id", "root")
    ordered = materialize(ordered.withColumns({"part": F.spark_partition_id(), "pos": F.monotonically_increasing_id()}), "recipes")
    sums = ordered.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # One row for each partition: what this window orders is the plan's size, not the data's.
    before = sums.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start")
    ordered.join(before, "part").select("part", "pos", "doc_id", start, "n_tokens", "root", "chunks").write.parquet(f"{path}/recipes")
    remove(spark, staged)
    manifest_of(read_recipes(spark, path)).write.parquet(f"{path}/manifest")


RECIPE = "part int, pos long, doc_id long, start long, n_tokens long, root binary, chunks array<binary>"


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECIPE).parquet(f"{path}/recipes")


def manifest_of(recipes: DataFrame) -> DataFrame:
    """(part, documents, n_tokens, root): Merkle root of each part of the recipes, over the roots of its groups of documents in order."""
    # Rows are numbered from 0 within a part, behind the part's own number.
    group = F.shiftright(F.col("pos").bitwiseAND(F.lit((1 << 33) - 1)), GROUP.bit_length() - 1).alias("group")
    leaves = recipes.select("part", group, "pos", "n_tokens", "root").groupBy("part", "group").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("pos", "root"))).alias("leaves"))
    groups = rooted(leaves, "part int, group long, documents long, n_tokens long")
    parts = groups.groupBy("part").agg(F.sum("documents").alias("documents"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct(F.col("group").alias("pos"), "root"))).alias("leaves"))
    return rooted(parts, "part int, documents long, n_tokens long")


def rooted(rows: DataFrame, columns: str) -> DataFrame:
    """The rows with the Merkle root of their leaves in place of them."""
    names = [x.split()[0] for x in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [merkle([x["root"] for x in leaves]) for leaves in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(roots, pa.binary())], names=[*names, "root"])

    return rows.select(*names, "leaves").mapInArrow(tidy(run), f"{columns}, root binary")


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Read every document back: doc_id, start, n_tokens, ids_crc32, and ids if asked for.

    Verified on the way: each chunk against its digest, each document against its Merkle root and its
    length, each part of the recipes against the manifest.
    """
    recipes = read_recipes(spark, path)
    index = spark.read.schema(f"digest binary, {PLACE}").parquet(f"{path}/index")
    stale = manifest_of(recipes).join(spark.read.schema("part int, documents long, n_tokens long, root binary").parquet(f"{path}/manifest"), ["part", "documents", "n_tokens", "root"], "full_outer")
    if stale.count() != recipes.select("part").distinct().count():
        raise StoreError("the manifest differs from the recipes")
    chunk = recipes.select("pos", "doc_id", "start", "n_tokens", "root", F.posexplode("chunks").alias("k", "digest"))
    placed = chunk.join(index, "digest", "left").groupBy("pos", "doc_id", "start", "n_tokens", "root").agg(F.array_sort(F.collect_list(F.struct("k", "file", "block", "size", "at", "n", "digest"))).alias("places"))
    near = placed.withColumn("first", F.col("places")[0]).repartitionByRange("first.file", "first.block", "pos").sortWithinPartitions("first.file", "first.block", "pos").drop("first")
    columns = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids
    schema = pa.schema(columns)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                rows = []
                for x in batch.slice(a, 500).to_pylist():
                    chunks, leaves = [], []
                    for p in x["places"]:
                        if p["file"] is None:
                            raise StoreError(f"document {x['doc_id']}: a chunk is missing")
                        ids = blocks.get(p["file"], p["block"], p["size"], p["at"], p["n"])
                        leaves.append(digest_of(ids))
                        chunks.append(ids)
                    ids = np.concatenate(chunks)
                    if merkle(leaves) != x["root"] or len(ids) != x["n_tokens"]:
                        raise StoreError(f"document {x['doc_id']}: its chunks differ from its recipe")
                    row = {"doc_id": x["doc_id"], "start": x["start"], "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}
                    rows.append(row | ({"ids": ids.tolist()} if with_ids else {}))
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return written(near.mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids), "token-rows")


def round_trip(docs: DataFrame, tokenizer_file: str, end_id: int = 0, path: str | None = None, with_ids: bool = False) -> DataFrame:
    path = path or new_path(docs.sparkSession, "token-store")
    write_store(docs, path, tokenizer_file, end_id)
    return read_store(docs.sparkSession, path, with_ids)
