"""WARC archives: writing with segmentation and revisits, reading with reassembly.

Writing turns each page into an HTTP response in chunked transfer framing. A block longer than a
segment becomes a first record and ``continuation`` records. Of pages with equal payloads one is
written whole and the others as ``revisit`` records that refer to it.

Reading parses archives file by file, joins the segments of a record by origin identifier in order of
segment number, verifies their total length, decodes the chunked framing, verifies payload digests and
takes the payload of a revisit from the response it refers to.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm.files import attempt_name, open_fs
from gazette.shared import new_path
from gazette.llm.textvec import small_batches, tidy, utf8, written

#: Bytes of a block in one record; longer blocks are segmented.
SEGMENT = 16 << 10
#: Bytes of a chunk of the transfer framing.
CHUNK = 4 << 10
#: Payloads of fewer bytes are never revisited.
REVISIT_LEAST = 1000
#: Bytes of an archive after which the next one begins.
ARCHIVE = 256 << 20

_EOL = b"\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_NAMELESS = "urn:page:"


class ArchiveError(ValueError):
    """An archive that can't be read back whole."""


def framed(payload: bytes, chunk: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    out = []
    for a in range(0, len(payload), chunk):
        part = payload[a : a + chunk]
        out += (b"%x\r\n" % len(part), part, _EOL)
    out.append(b"0\r\n\r\n")
    return b"".join(out)


def unframed(body: bytes) -> bytes:
    """What chunked transfer framing carries; chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(_EOL, at)
        if end < 0:
            raise ArchiveError("chunk size is missing")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            if body[at : at + 2] != _EOL and body.find(b"\r\n\r\n", at) < 0:
                raise ArchiveError("the end of the last chunk is cut off")
            return b"".join(out)
        if body[at + size : at + size + 2] != _EOL:
            raise ArchiveError("chunk is cut off")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    end = block.find(b"\r\n\r\n")
    if end < 0:
        raise ArchiveError("HTTP headers are cut off")
    chunked = b"transfer-encoding: chunked" in block[: end + 2].lower()
    return unframed(block[end + 4 :]) if chunked else block[end + 4 :]


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"".join((f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode(), block, b"\r\n\r\n"))


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ArchiveError("record headers are cut off")
        lines = data[at:end].decode().split("\r\n")[1:]
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        if data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ArchiveError("record block is cut off")
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 8 + size


@dataclass(frozen=True)
class Page:
    """What the records of a page say; ``refers`` is the record, page and address that a revisit refers to."""

    ident: str
    page_id: int | None
    url: str | None
    payload: bytes
    refers: tuple[str | None, int, str | None] | None = None


def target(url: str | None, page_id: int | None) -> str:
    """A page's address without blanks and control characters; a page without one gets a name."""
    return "".join(c if " " < c else f"%{ord(c):02X}" for c in url) if url else f"{_NAMELESS}{'' if page_id is None else page_id}"


def records_of_page(page: Page, segment: int, chunk: int) -> Iterator[bytes]:
    """The records of one page: a revisit, a response, or a response and its continuations."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(page.payload).digest()).decode()
    uri = ("WARC-Target-URI", target(page.url, page.page_id))
    shared = [("WARC-Date", _DATE), uri, ("WARC-Payload-Digest", digest), ("Content-Type", "application/http;msgtype=response")]
    shared += [] if page.page_id is None else [("X-Page-ID", str(page.page_id))]
    first = [("WARC-Record-ID", f"<{page.ident}>"), *shared]
    if page.refers is not None:
        ident, other, url = page.refers
        refers = [("WARC-Profile", _PROFILE), ("WARC-Refers-To-Target-URI", target(url, other)), ("WARC-Refers-To-Date", _DATE), ("X-Refers-To-Page-ID", str(other))]
        refers += [] if ident is None else [("WARC-Refers-To", f"<{ident}>")]
        yield record([("WARC-Type", "revisit"), *first, *refers], _HTTP)
        return
    block = _HTTP + framed(page.payload, chunk)
    if len(block) <= segment:
        yield record([("WARC-Type", "response"), *first], block)
        return
    yield record([("WARC-Type", "response"), *first, ("WARC-Segment-Number", "1")], block[:segment])
    count = -(-len(block) // segment)
    for n in range(2, count + 1):
        more = [("WARC-Segment-Total-Length", str(len(block)))] if n == count else []
        headers = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{page.ident}:{n}>"), ("WARC-Date", _DATE), uri, ("WARC-Segment-Origin-ID", f"<{page.ident}>"), ("WARC-Segment-Number", str(n)), *more]
        yield record(headers, block[(n - 1) * segment : n * segment])


def mark_revisits(pages: DataFrame, least: int = REVISIT_LEAST) -> DataFrame:
    """page_id, url, html, refers_to and to_url: the largest page_id with the same payload and its address, null for that page itself.

    ``single`` says whether that page is one row, so that its record can be named beforehand. Only payloads
    of ``least`` bytes or more that occur under several ids take part. The winners are few and unique by
    payload; a hot payload is only on the other side, which adaptive execution splits.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.when((F.octet_length("html") >= least), F.sha2("html", 256)))
    each = rows.where(F.col("key").isNotNull()).groupBy("key", "page_id").agg(F.max("url").alias("url"), F.count(F.lit(1)).alias("n"))
    ids = each.groupBy("key").agg(F.max("page_id").alias("last"), F.min("page_id").alias("least"), F.max_by(F.struct("url", "n"), "page_id").alias("x"))
    winners = ids.where("last > least").select("key", "last", F.col("x.url").alias("to_url"), (F.col("x.n") == 1).alias("single"))
    marked = rows.join(winners, "key", "left")
    return marked.select("page_id", "url", "html", F.when(F.col("last") > F.col("page_id"), F.col("last")).alias("refers_to"), "to_url", F.when(F.col("page_id").isNotNull(), F.col("single")).alias("single"))


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, chunk: int = CHUNK, least: int = REVISIT_LEAST) -> DataFrame:
    """Write the pages as gzipped WARC files (a member per record) under ``path``; returns the manifest (file, records, bytes).

    Null html is an empty payload; a page without an address gets a name. Repeated rows are records of
    their own, also pages without a page_id. A response that others refer to has a record id made of its
    page_id and payload, unless several rows share both: revisits then refer to it by address and page alone.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_fs(path)
        system.create_dir(base, recursive=True)
        out, name, count, size, rows = None, "", 0, 0, 0
        done: list[tuple[str, int, int]] = []
        for batch in batches:
            ids, urls, refers, to_urls, singles = (batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5))
            data, offsets = utf8(batch.column(2))
            view = memoryview(data)
            for i, (page_id, url, to, to_url, single) in enumerate(zip(ids, urls, refers, to_urls, singles, strict=True)):
                if out is None:
                    name, count, size = attempt_name("pages", ".warc.gz"), 0, 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                payload = bytes(view[offsets[i] : offsets[i + 1]])
                named = f"{path}/{page_id if to is None else to}/{hashlib.sha1(payload).hexdigest()}" if single else None
                own, rows = f"{name}/{rows}", rows + 1
                ident, other = (None if x is None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, x)}" for x in (named if single and to is None else own, named))
                page = Page(ident, page_id, url, payload, None if to is None else (other, to, to_url))
                for x in records_of_page(page, segment, chunk):
                    packed = zlib.compress(x, 1, 31)
                    out.write(packed)
                    count, size = count + 1, size + len(packed)
                if size >= ARCHIVE:
                    out.close()
                    done, out = [*done, (name, count, size)], None
        if out is not None:
            out.close()
            done.append((name, count, size))
        for x in done:
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "records", "bytes"), x, strict=True))], schema=manifest)

    manifest = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
    files = mark_revisits(pages, least).mapInArrow(tidy(write), "file string, records long, bytes long")
    with small_batches(pages.sparkSession):
        files.write.parquet(f"{path}/manifest")
    return pages.sparkSession.read.schema("file string, records long, bytes long").parquet(f"{path}/manifest")


RECORD = "page_id long, url string, record_type string, refers_to long, digest string, origin string, segment int, total long, block binary, payload binary, payload_bytes long"


def parse_archives(spark: SparkSession, path: str, payloads: bool) -> DataFrame:
    """One row per record. Of records in one segment the payload is decoded at once; others keep their block."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_fs(path)
        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held, count = [], 0, 0
                with system.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for headers, block in read_members(stream):
                        row = row_of(headers, block, payloads)
                        rows.append(row)
                        held, count = held + len(row["block"] or b"") + len(row["payload"] or b"") + 300, count + 1
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if count != expected:
                    raise ArchiveError(f"{name} has {count} records; {expected} were written")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(k, kinds[t]) for k, t in (x.split() for x in RECORD.split(", "))])
    files = spark.read.schema("file string, records long, bytes long").parquet(f"{path}/manifest")
    tasks = max(1, min(files.count(), 100_000))
    return files.repartition(tasks, "file").mapInArrow(tidy(parse), RECORD)


def read_members(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a gzip file with a member per record, a member in memory at a time."""
    rest, ended = b"", False
    while not ended or rest:
        member, out = zlib.decompressobj(31), []
        while not member.eof:
            if not rest:
                rest = stream.read(1 << 18)
                if not rest:
                    ended = True
                    break
            out.append(member.decompress(rest))
            rest = member.unused_data
        if member.eof:
            yield from parsed(b"".join(out))
        elif out:
            raise ArchiveError("gzip member is cut off")


def row_of(headers: dict[str, str], block: bytes, payloads: bool) -> dict:
    number = lambda k: int(headers[k]) if k in headers else None
    kind, segment = headers["warc-type"], number("warc-segment-number")
    uri = headers.get("warc-target-uri", _NAMELESS)
    row = {"page_id": number("x-page-id"), "url": None if uri.startswith(_NAMELESS) else uri, "record_type": kind, "refers_to": number("x-refers-to-page-id"), "digest": hex_digest(headers.get("warc-payload-digest")), "origin": None, "segment": segment, "total": number("warc-segment-total-length"), "block": None, "payload": None, "payload_bytes": None}
    if segment is not None:
        row |= {"origin": headers.get("warc-segment-origin-id", headers["warc-record-id"]), "block": block}
    elif kind == "response":
        row |= checked(payload_of(block), row["digest"], payloads)
    return row


def hex_digest(said: str | None) -> str | None:
    return None if said is None else base64.b32decode(said.partition(":")[2]).hex()


def checked(payload: bytes, digest: str | None, payloads: bool) -> dict:
    own = hashlib.sha1(payload).hexdigest()
    if digest is not None and digest != own:
        raise ArchiveError("payload digest differs")
    return {"digest": own, "payload": payload if payloads else None, "payload_bytes": len(payload)}


def reassemble(segments: DataFrame, payloads: bool) -> DataFrame:
    """Whole responses of segment rows, grouped by origin and put in order of segment number.

    A group is one record's segments, which its length bounds. A gap in the numbers, a missing total or
    a total that differs from the length is an error.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                numbers, block = [s["segment"] for s in x["parts"]], b"".join(s["block"] for s in x["parts"])
                if numbers != list(range(1, len(numbers) + 1)):
                    raise ArchiveError(f"{x['origin']}: segments {numbers}")
                if x["total"] != len(block):
                    raise ArchiveError(f"{x['origin']}: {len(block)} bytes; total length is {x['total']}")
                rows.append({"page_id": x["page_id"], "url": x["url"]} | checked(payload_of(block), x["digest"], payloads))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64())])
    parts = F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts")
    groups = segments.groupBy("origin").agg(parts, F.max("total").alias("total"), F.max("page_id").alias("page_id"), F.max("url").alias("url"), F.max("digest").alias("digest"))
    return written(groups.mapInArrow(tidy(decode), "page_id long, url string, digest string, payload binary, payload_bytes long"), "warc-whole")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per page: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and payload if asked for.

    An empty archive gives no row.
    """
    records = written(parse_archives(spark, path, payloads), "warc-records")
    columns = ["page_id", "url", "digest", "payload", "payload_bytes"]
    whole = records.where("origin IS NULL AND record_type = 'response'").select(columns)
    responses = whole.unionByName(reassemble(records.where("origin IS NOT NULL"), payloads))
    revisits = records.where("record_type = 'revisit'").select("page_id", "url", "refers_to", "digest")
    found = responses.select(F.col("page_id").alias("refers_to"), "digest", "payload", "payload_bytes").dropDuplicates(["refers_to", "digest"])
    revisits = revisits.join(found, ["refers_to", "digest"], "left")
    shape = ["page_id", "url", F.coalesce("payload_bytes", F.raise_error(F.lit("a revisit refers to a response that is missing"))).alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", "payload"]
    out = responses.withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("long")}).select(shape).unionByName(revisits.withColumn("record_type", F.lit("revisit")).select(shape))
    return out if payloads else out.drop("payload")


def round_trip(pages: DataFrame, path: str | None = None, payloads: bool = False) -> DataFrame:
    """Write the pages and read them back: a row for each page, as ``read_archives`` gives it.

    Null html is an empty payload, a null or empty url comes back as null. Rows that repeat give rows that
    repeat; of equal payloads all with the largest page_id are responses. A null page_id stays null and is
    never a revisit's target. An empty table gives an empty result; other columns are not read.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path, payloads)
