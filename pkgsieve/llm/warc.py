"""WARC archives by way of a chunked record table.

1. ``chunk_table``: each payload becomes rows (record, chunk_no, data) of at
   most ``CHUNK`` bytes, cut as the rows are made, so a payload is never
   copied whole; a digest is carried from chunk to chunk and stands, with the
   payload's size, on the record's last row.  The table is written once; it
   gives every record its number.
2. ``record_plan``: of records with equal digests (payloads of ``min_bytes``
   or more) the one with the smallest page_id is the response, the others
   revisit it.  Only ids and digests move.
3. ``write_archives``: the chunks of a record, in order, go through the gzip
   stream of the record; archives roll over at ``ARCHIVE_BYTES``.
4. ``read_archives``: the files are read as streams; sizes and digests come
   from the payloads and are compared with the headers.

Defined cases: a null payload is empty; a null page_id names no record, sorts
last and cannot be told apart from another one in the result; repeated rows
are records of their own, the first number among equal page_ids is the
response; an empty table writes no archive.  Extra columns are ignored.
"""
from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .common import cut, cut_packed

CHUNK = 1 << 16
ARCHIVE_BYTES = 1 << 30
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _digest(state) -> str:
    return base64.b32encode(state.digest()).decode()


def chunk_table(pages: DataFrame, payload: str = "html", chunk: int = CHUNK) -> DataFrame:
    """(record, page_id, url, chunk_no, data, payload_bytes, digest), written;
    the last two are null but on a record's last chunk."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.monotonically_increasing_id().alias("record"), F.col("page_id").cast("long"), "url",
                        body.alias("body"))
    last = F.greatest(F.floor((F.octet_length("body") - 1) / chunk), F.lit(0)).cast("int")
    rows = rows.withColumn("last", last).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("last"))))
    rows = rows.select("record", "page_id", F.when(F.col("chunk_no") == 0, F.col("url")).alias("url"), "chunk_no",
                       F.substr("body", F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("data"),
                       (F.col("chunk_no") == F.col("last")).alias("end"))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, size = hashlib.sha1(), 0
        for batch in batches:
            sizes, digests = [], []
            for data, end in zip(batch.column("data"), batch.column("end").to_pylist()):
                state.update(data.as_buffer())
                size += len(data.as_buffer())
                sizes.append(size if end else None)
                digests.append(_digest(state) if end else None)
                if end:
                    state, size = hashlib.sha1(), 0
            cols = [batch.column(c) for c in ("record", "page_id", "url", "chunk_no", "data")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
                                             names=[*batch.schema.names[:5], "payload_bytes", "digest"])

    return cut_packed(rows.mapInArrow(carry, "record long, page_id long, url string, chunk_no int, data binary, "
                                      "payload_bytes long, digest string"))


def record_plan(chunks: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(record, payload_bytes, digest, refers_to, revisit) per record."""
    records = chunks.where(F.col("digest").isNotNull()).select("record", "page_id", "payload_bytes", "digest")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record")
    first = (records.where(F.col("payload_bytes") >= min_bytes).groupBy("digest")
                    .agg(F.min(order).alias("first")).select("digest", "first.page_id", "first.record"))
    first = first.withColumnsRenamed({"page_id": "first_page", "record": "first_record"})
    plan = records.join(first, "digest", "left")
    revisit = (F.col("payload_bytes") >= min_bytes) & (F.col("record") != F.col("first_record"))
    return plan.select("record", "payload_bytes", "digest", revisit.alias("revisit"),
                       F.when(revisit, F.col("first_page")).alias("refers_to"),
                       F.when(revisit, F.col("first_record")).alias("refers_record"))


def _header(row: dict) -> tuple[bytes, bytes]:
    """The WARC header and the HTTP header of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    revisit = row["revisit"]
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
             f"WARC-Record-ID: <urn:record:{row['record']}>", f"WARC-Date: {DATE}"]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in row["url"]))
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {row['page_id']}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:record:{row['refers_record']}>"]
        if row["refers_to"] is not None:
            lines.append(f"X-Refers-To-Page-ID: {row['refers_to']}")
    lines += [f"WARC-Payload-Digest: sha1:{row['digest']}", f"X-Payload-Bytes: {row['payload_bytes']}",
              "Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(http) + (0 if revisit else row['payload_bytes'])}", "", ""]
    return "\r\n".join(lines).encode(), http


def write_archives(chunks: DataFrame, plan: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives and return the written table (uri, records) of them."""
    folder = store.new_folder(chunks.sparkSession, "warc")
    rows = chunks.drop("payload_bytes", "digest").repartition("record").join(plan, "record")
    rows = rows.where(~F.col("revisit") | (F.col("chunk_no") == 0)).sortWithinPartitions("record", "chunk_no")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, uri, records, held, gz = None, "", 0, 0, None
        heads = [n for n in rows_names if n != "data"]

        def put(data) -> None:
            nonlocal held
            packed = gz.compress(data)
            held += len(packed)
            out.write(packed)

        def close_record() -> None:
            nonlocal held
            put(b"\r\n\r\n")
            packed = gz.flush()
            held += len(packed)
            out.write(packed)

        for batch in batches:
            data = batch.column("data")
            for i, row in enumerate(batch.select(heads).to_pylist()):
                if row["chunk_no"] == 0:
                    if gz is not None:
                        close_record()
                    if out is not None and held >= archive_bytes:
                        out.close()
                        yield pa.RecordBatch.from_pydict({"uri": [uri], "records": [records]})
                        out, records, held = None, 0, 0
                    if out is None:
                        uri, out = store.create(folder, "pages.warc.gz")
                    gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    records += 1
                    for part in _header(row):
                        put(part)
                if not row["revisit"]:
                    put(data[i].as_buffer())
        if out is not None:
            close_record()
            out.close()
            yield pa.RecordBatch.from_pydict({"uri": [uri], "records": [records]})

    rows_names = rows.columns
    return cut(rows.mapInArrow(write, "uri string, records long"))


def _members(file) -> Iterator[Iterator[bytes]]:
    """The gzip members of a file, each as a stream of pieces."""
    rest = file.read(CHUNK)
    while rest:
        member = zlib.decompressobj(31)

        def pieces() -> Iterator[bytes]:
            nonlocal rest
            while True:
                piece = member.decompress(rest, CHUNK)
                rest = member.unconsumed_tail or member.unused_data
                if piece:
                    yield piece
                if member.eof:
                    rest = rest or file.read(CHUNK)
                    return
                rest = rest or file.read(CHUNK)
                if not rest:
                    raise ValueError("archive ends within a record")

        yield pieces()


def _record(pieces: Iterator[bytes]) -> dict:
    """One record, read as a stream: header fields, size and digest of its payload."""
    buffered = b""

    def head() -> bytes:
        nonlocal buffered
        while (end := buffered.find(b"\r\n\r\n")) < 0:
            buffered += next(pieces)
        block, buffered = buffered[:end], buffered[end + 4:]
        return block

    fields = dict(line.split(": ", 1) for line in head().decode().split("\r\n")[1:])
    http = head()
    left = want = int(fields["Content-Length"]) - len(http) - 4
    state = hashlib.sha1()
    while left:
        piece = buffered or next(pieces)
        state.update(piece[:left])
        buffered, left = piece[left:], left - len(piece[:left])
    tail = buffered + b"".join(pieces)
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if tail != b"\r\n\r\n" or kind == "response" and (digest, str(want)) != (_digest(state), fields["X-Payload-Bytes"]):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"page_id": number("X-Page-ID"), "payload_bytes": number("X-Payload-Bytes"), "payload_digest": digest,
            "record_type": kind, "refers_to": number("X-Refers-To-Page-ID")}


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) per record."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                found = []
                with store.open_input(uri) as file:
                    for member in _members(file):
                        found.append(_record(member))
                        if len(found) == 10_000:
                            yield pa.RecordBatch.from_pylist(found, schema=schema)
                            found = []
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=schema)

    return store.spread(archives.select("uri")).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, payload) to archives and read them back."""
    chunks = chunk_table(pages, payload)
    plan = record_plan(chunks, min_bytes)
    return read_archives(write_archives(chunks, plan))
