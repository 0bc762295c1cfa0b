"""Packing along a space-filling curve.

Each document's hashed term vector is projected to DIMS numbers, whose Hilbert key orders the documents so
that neighbours are alike. Documents are range-sorted by that key, each range is one stream of tokens, and
the stream is cut every 2048 tokens. What a range has left at its end is cut into powers of two, so that no
sequence needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import mix, partitions, written
from .tokens import part_encoder

LENGTH, END = 2048, 1
#: Buckets of the hashed vectors, dimensions they are projected to, bits of each in the Hilbert key.
BUCKETS, DIMS, BITS = 1024, 4, 15
#: Characters encoded at a time, documents projected at a time.
CHUNK, TOGETHER = 2_000_000, 128


def directions(seed: int = 7) -> np.ndarray:
    """BUCKETS x DIMS signs from a hash."""
    h = mix(np.arange(BUCKETS * DIMS, dtype=np.uint64) + np.uint64(seed << 32))
    return np.where(h & np.uint64(1), 1.0, -1.0).reshape(BUCKETS, DIMS)


#: The bucket of each id of 16 bits, and the logarithms of small counts.
_BUCKET = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(7)) % np.uint64(BUCKETS)).astype(np.int64)


def _logarithms(counts: np.ndarray) -> np.ndarray:
    """log1p in steps of 2^-20, so that sums of a row are exact and equal texts lie in one place, whatever stands beside them."""
    return np.round(np.log1p(counts) * (1 << 20)) / (1 << 20)


_LOG = _logarithms(np.arange(4096))


def project(ids: list[bytes], signs: np.ndarray) -> np.ndarray:
    """Where documents (16-bit ids of each) lie in the unit cube: their vectors' projections, by the normal distribution's curve."""
    found = [np.zeros((0, DIMS))]
    for at in range(0, len(ids), TOGETHER):
        some = ids[at : at + TOGETHER]
        rows = np.repeat(np.arange(len(some)) * BUCKETS, [len(x) // 2 for x in some])
        counts = np.bincount(rows + _BUCKET[np.frombuffer(b"".join(some), "<u2")], minlength=len(some) * BUCKETS).reshape(len(some), BUCKETS)
        v = _LOG[counts] if counts.max() < len(_LOG) else _logarithms(counts)
        norms = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
        p = v @ signs / np.where(norms > 0, norms, 1)
        found.append(1 / (1 + np.exp(-1.702 * p)))
    return np.concatenate(found)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Key of each row of integer coordinates on the Hilbert curve (transpose form, then interleaved)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] = np.where(high, x[i], x[i] ^ t) if i else x[i]
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, key long, n long, ids binary (little-endian 16-bit) of every row; the closing id is not in ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, signs = part_encoder(vocabulary), directions()
        for b in batches:
            doc_ids, texts = b["doc_id"].to_pylist(), [t or "" for t in b["text"].to_pylist()]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
                    size += len(texts[to])
                    to += 1
                ids = encoder.encode(texts[at:to])
                places = project(ids, signs)
                keys = hilbert(np.minimum((places * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[at:to], pa.int64()), pa.array(keys), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "key", "n", "ids"])
                at = to

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, key long, n long, ids binary")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, ids array<int>"


def _cut(left: int) -> int:
    """Length of the last sequences: powers of two that add up to what is left."""
    return 1 << (left.bit_length() - 1)


def _pack(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        pieces: list[tuple] = []  # of the open sequence: doc_id, start, ids, doc_tokens, offset
        filled = number = 0
        rows: list[tuple] = []
        ids: list[np.ndarray] = []  # of the rows

        def close(pieces, size):
            nonlocal number
            rows.extend((d, s, len(x), zlib.crc32(x.astype("<u4").tobytes()), n, base + number, o, size) for d, s, x, n, o in pieces)
            if with_ids:
                ids.extend(x for _, _, x, _, _ in pieces)
            number += 1

        def out():
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)]
            if with_ids:
                ends = pa.array(np.append(0, np.cumsum([len(x) for x in ids])), pa.int32())
                cols.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids).astype(np.int32))))
            else:
                cols.append(pa.nulls(len(rows), pa.list_(pa.int32())))
            rows.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in PIECES.split(", ")])

        for b in batches:
            for d, raw in zip(b["doc_id"].to_pylist(), b["ids"].to_pylist()):
                whole = np.append(np.frombuffer(raw, "<u2"), np.uint16(END))
                at = 0
                while at < len(whole):
                    take = whole[at : at + LENGTH - filled]
                    pieces.append((d, at, take, len(whole), filled))
                    filled += len(take)
                    at += len(take)
                    if filled == LENGTH:
                        close(pieces, LENGTH)
                        pieces, filled = [], 0
                if len(rows) >= 2_000:
                    yield out()
        # the rest of this range
        while filled:
            size, used, now, later = _cut(filled), 0, [], []
            for d, s, x, n, _ in pieces:
                first, second = x[: size - used], x[size - used :] if len(x) > size - used else x[:0]
                if len(first):
                    now.append((d, s, first, n, used))
                    used += len(first)
                if len(second):
                    later.append((d, s + len(x) - len(second), second, n, 0))
            close(now, size)
            pieces, filled = later, filled - size
        if rows:
            yield out()

    return run


def pack(docs: DataFrame, vocabulary: str, with_ids: bool = True) -> DataFrame:
    """Pack every row of docs (doc_id, text) into sequences of 2048 tokens; one row per piece of a document.

    Null and empty texts are the closing id alone. Equal keys are ordered by doc_id, so a group of copies may
    span many ranges. A range's last sequences have power-of-two lengths; all others have 2048 tokens, and
    none is padded. ids_crc32 is that of the piece's ids as unsigned 32-bit little-endian numbers. Rows that
    repeat a doc_id are packed each for itself. Other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    made = written(encoded(docs, vocabulary), "encoded")
    ranged = made.repartitionByRange(partitions(spark), "key", "doc_id").sortWithinPartitions("key", "doc_id")
    return ranged.mapInArrow(_pack(with_ids), PIECES)
