"""WARC archives of individually compressed records that share a Zstandard dictionary.

Each archive opens with a skippable frame (magic 0x184D2A5D) that holds the dictionary, built from records
of that archive; every record follows as a frame of its own, so each can be read alone. Writers name
archives at random and report them in a table that Spark commits, so what a lost or repeated task leaves
behind is never read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import attach, scratch, written

#: Fixed values of the format.
DICT_FRAME = 0x184D2A5D
#: Raw bytes of the records of one archive, about; bytes of its dictionary and of the records it is built from.
ARCHIVE_BYTES, DICT_BYTES, SAMPLE_BYTES = 16 << 20, 48 << 10, 2 << 20
LEVEL = 3
#: Payloads under this length are never revisits.
REVISIT_BYTES = 100


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    name = "null" if page_id is None else page_id
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary from records spread evenly over an archive; empty when they are too few to build one."""
    size = sum(map(len, records))
    step = max(1, size // SAMPLE_BYTES)
    sample = [r[:64 << 10] for r in records[::step]]
    if len(sample) < 8 or size < 4 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, sample)) // 8)), sample, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive(records: list[bytes]) -> bytes:
    content = dictionary(records)
    shared = zstandard.ZstdCompressionDict(content) if content else None
    one = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True)
    return struct.pack("<II", DICT_FRAME, len(content)) + content + b"".join(map(one.compress, records))


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    magic, n = struct.unpack_from("<II", data)
    if magic != DICT_FRAME:
        raise ValueError("the archive does not open with a dictionary frame")
    shared = zstandard.ZstdCompressionDict(data[8 : 8 + n]) if n else None
    with zstandard.ZstdDecompressor(dict_data=shared).stream_reader(data[8 + n :], read_across_frames=True) as stream:
        buffer, ended = b"", False
        while True:
            at = buffer.find(b"\r\n\r\n")
            while at < 0 and not ended:
                more = stream.read(1 << 20)
                ended, buffer = not more, buffer + more
                at = buffer.find(b"\r\n\r\n")
            if at < 0:
                if buffer:
                    raise ValueError("the archive ends inside a record")
                return
            lines = buffer[:at].decode().split("\r\n")
            head = dict(x.split(": ", 1) for x in lines[1:])
            end = at + 4 + int(head["Content-Length"])
            parts, have = [buffer], len(buffer)
            while have < end + 4 and not ended:
                more = stream.read(1 << 20)
                ended = not more
                parts.append(more)
                have += len(more)
            buffer = b"".join(parts)
            if lines[0] != "WARC/1.1" or buffer[end : end + 4] != b"\r\n\r\n":
                raise ValueError("broken record")
            yield head, buffer[at + 4 : end]
            buffer = buffer[end + 4 :]


def _put(folder: str, records: list[bytes]) -> tuple[str, int, int]:
    store, path = pafs.FileSystem.from_uri(f"{folder}/{uuid.uuid4().hex}.warc.zst")
    data = archive(records)
    with store.open_output_stream(path) as out:
        out.write(data)
    return path.rpartition("/")[2], len(records), len(data)


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives into folder (a URI) and return one row for each: archive, records, bytes.

    pages: page_id, url, payload binary, digest, refers_to (null for responses), revisit boolean.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, waiting, size = [], [], 0
        for b in batches:
            for row in range(b.num_rows):
                r = record(*(b[c][row].as_py() for c in ("page_id", "url", "payload", "digest", "refers_to", "revisit")))
                waiting.append(r)
                size += len(r)
                if size >= ARCHIVE_BYTES:
                    made.append(_put(folder, waiting))
                    waiting, size = [], 0
        if waiting:
            made.append(_put(folder, waiting))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made) if made else ([], [], []), (pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"])

    return pages.select("page_id", "url", "payload", "digest", "refers_to", "revisit").mapInArrow(run, "archive string, records long, bytes long")


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, block_bytes long"


def read(archives: DataFrame, folder: str) -> DataFrame:
    """One row for each record of the archives, whose digests are checked against their payloads."""

    def page(text: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", text or "")
        return int(found[1]) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b["archive"].to_pylist():
                store, path = pafs.FileSystem.from_uri(f"{folder}/{name}")
                with store.open_input_stream(path) as f:
                    data = f.read()
                rows = []
                for head, block in records_of(data):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    if head["WARC-Type"] == "response" and (n != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{name}: a payload differs from its digest")
                    rows.append((page(head["WARC-Record-ID"]), head["WARC-Target-URI"], n, digest, head["WARC-Type"], page(head.get("WARC-Refers-To")), len(block)))
                cols = list(zip(*rows)) or [[]] * 7
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [c.split()[0] for c in RECORDS.split(", ")])

    return archives.select("archive").repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, RECORDS)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write every row of pages (page_id, url, html) to archives and read them back, one row per page.

    The payload is html in UTF-8, empty if null. Of equal payloads of REVISIT_BYTES or more, the record
    with the smallest page_id is the response (all rows of that id, should it repeat; null ids are never
    smallest unless alone) and the others revisit it; shorter payloads are all responses. White space and
    control bytes in a url are percent-encoded. Other columns are ignored; an empty table gives no rows.
    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, url, block_bytes.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    groups = written(
        rows.where(F.length("payload") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1"),
        "payloads",
    )
    # Only pages that revisit need a partner: their ids and targets are a narrow table, found without the payloads.
    narrow = written(rows.where(F.length("payload") >= REVISIT_BYTES).select("page_id", "digest"), "digests")
    again = attach(narrow, groups, "digest").where(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")))
    again = written(again.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "first_id").distinct(), "revisits")
    joined = rows.join(again.hint("merge"), F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    folder = f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
    store = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    s, path = pafs.FileSystem.from_uri(store)
    s.create_dir(path, recursive=True)
    archives = written(write(joined.select("page_id", "url", "payload", "digest", F.col("first_id").alias("refers_to"), F.col("first_id").isNotNull().alias("revisit")), store), "archives")
    return read(archives, store).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "block_bytes")
