"""Exact dedup by an index of cuckoo filters.

Digests of the texts are dealt to the partitions of the index. Each partition keeps a cuckoo filter of
its live digests, beside the stored keys in the filter's buckets: a miss proves a digest new, a hit is
verified against the keys stored in the two buckets, and a filter that overflows is rebuilt at twice
the size from the stored keys. Before anything is shuffled each task runs its own rows through such an
index, so that a digest leaves a task once, however many copies there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import attach, fresh, written

#: Rows after which a task's own index is emptied into the shuffle.
LOCAL_ROWS = 200_000


class CuckooIndex:
    """A cuckoo filter of digests with deletion; each slot's stored key and entry lie in the same bucket."""

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int = 64) -> None:
        self.mask = buckets - 1  # buckets: a power of two
        self.tags: list[int] = [0] * (buckets * self.SLOTS)
        self.stored: list[tuple | None] = [None] * (buckets * self.SLOTS)
        self.n = self.resizes = 0

    @staticmethod
    def _tag(digest: bytes) -> int:
        return int.from_bytes(digest[8:10], "little") or 1

    def _other(self, bucket: int, tag: int) -> int:
        return (bucket ^ (tag * 0x5BD1E995)) & self.mask

    def _find(self, digest: bytes) -> int:
        """The slot of a live digest, -1 if there is none: tags first, then the keys of slots that hit."""
        tag = self._tag(digest)
        bucket = int.from_bytes(digest[:8], "little") & self.mask
        tags = self.tags
        for b in (bucket, self._other(bucket, tag)):
            at = b * self.SLOTS
            for slot in (at, at + 1, at + 2, at + 3):
                if tags[slot] == tag and self.stored[slot][0] == digest:
                    return slot
        return -1

    def get(self, digest: bytes) -> list | None:
        slot = self._find(digest)
        return None if slot < 0 else self.stored[slot][1]

    def add(self, digest: bytes, entry: list) -> None:
        """Insert a digest that get() did not find."""
        while not self._place(digest, entry):
            self._grow()
        self.n += 1

    def _place(self, digest: bytes, entry: list) -> bool:
        tag = self._tag(digest)
        bucket = int.from_bytes(digest[:8], "little") & self.mask
        path = []
        for kick in range(self.KICKS):
            for b in (bucket, self._other(bucket, tag)):
                at = b * self.SLOTS
                for slot in range(at, at + self.SLOTS):
                    if not self.tags[slot]:
                        self.tags[slot], self.stored[slot] = tag, (digest, entry)
                        return True
            bucket = self._other(bucket, tag) if kick % 2 else bucket
            slot = bucket * self.SLOTS + kick % self.SLOTS
            path.append((slot, self.tags[slot], self.stored[slot]))
            (tag, self.tags[slot]), ((digest, entry), self.stored[slot]) = (self.tags[slot], tag), (self.stored[slot], (digest, entry))
            bucket = self._other(bucket, tag)
        for slot, old_tag, old in reversed(path):  # as before; the caller grows the filter
            self.tags[slot], self.stored[slot] = old_tag, old
        return False

    def _grow(self) -> None:
        live = [x for x in self.stored if x]
        buckets = (self.mask + 1) * 2
        while True:
            self.mask, self.tags, self.stored = buckets - 1, [0] * (buckets * self.SLOTS), [None] * (buckets * self.SLOTS)
            self.resizes += 1
            if all(self._place(*x) for x in live):
                return
            buckets *= 2

    def remove(self, digest: bytes) -> bool:
        slot = self._find(digest)
        if slot < 0:
            return False
        self.tags[slot], self.stored[slot] = 0, None
        self.n -= 1
        return True

    def entries(self) -> Iterator[tuple[bytes, list]]:
        return (x for x in self.stored if x)


def _merge(index: CuckooIndex, digests, ids, counts, live) -> None:
    """entry: [largest id, rows]. A row that is not live deletes its digest."""
    for digest, doc_id, n, alive in zip(digests, ids, counts, live):
        if not alive:
            index.remove(digest)
        elif (entry := index.get(digest)) is None:
            index.add(digest, [doc_id, n])
        else:
            entry[1] += n
            if entry[0] is None or doc_id is not None and doc_id > entry[0]:
                entry[0] = doc_id


def _out(index: CuckooIndex) -> pa.RecordBatch:
    rows = list(index.entries())
    return pa.RecordBatch.from_arrays(
        [pa.array([d for d, _ in rows], pa.binary()), pa.array([e[0] for _, e in rows], pa.int64()), pa.array([e[1] for _, e in rows], pa.int64()), pa.array([True] * len(rows))],
        ["digest", "keep_id", "n", "live"],
    )


SCHEMA = "digest binary, keep_id long, n long, live boolean"


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for b in batches:
        _merge(index, b["digest"].to_pylist(), b["keep_id"].to_pylist(), b["n"].to_pylist(), b["live"].to_pylist())
        if index.n >= LOCAL_ROWS:
            yield _out(index)
            index = CuckooIndex()
    yield _out(index)


def _final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex(1024)
    for b in batches:
        _merge(index, b["digest"].to_pylist(), b["keep_id"].to_pylist(), b["n"].to_pylist(), b["live"].to_pylist())
    if index.n:
        rows = _out(index)
        for at in range(0, rows.num_rows, 50_000):
            yield rows.slice(at, 50_000)


def live_digests(digests: DataFrame, retired: DataFrame | None = None) -> DataFrame:
    """The index itself: one row for each live digest of `digests` (doc_id, digest) with keep_id and n.

    `retired` (digest) are deleted from the index after all insertions.
    """
    rows = digests.select("digest", F.col("doc_id").cast("long").alias("keep_id"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("live"))
    rows = rows.mapInArrow(_local, SCHEMA)
    if retired is not None:
        rows = rows.unionByName(retired.select("digest", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("live")).distinct())
    dealt = rows.repartition("digest")
    if retired is not None:
        dealt = dealt.sortWithinPartitions(F.desc("live"))
    return dealt.mapInArrow(_final, SCHEMA).select("digest", "keep_id", "n")


def _digests(docs: DataFrame) -> DataFrame:
    return written(docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")), "digests")


def dedup(docs: DataFrame, retired: DataFrame | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. The largest doc_id of equal texts stays (null
    ids only if a group has no other). Rows that repeat both id and text are one document and are marked
    alike. Other columns are ignored; an empty table gives an empty result. A text whose digest is in
    `retired` has been withdrawn from the index: none of its rows is kept, keep_id is null.
    """
    digests = _digests(docs)
    index = written(live_digests(digests, retired), "live")
    out = attach(digests, index, "digest", how="inner" if retired is None else "left")
    return out.select(
        "doc_id",
        "keep_id",
        F.coalesce("n", F.lit(0)).cast("long").alias("group_size"),
        (F.col("n").isNotNull() & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_rows(docs: DataFrame, decided: DataFrame, keep: str = "kept") -> DataFrame:
    """The rows of docs whose doc_id is marked in `decided`, with docs' own columns, whatever their names.

    All rows of a doc_id go or stay together; null ids are matched with null ids; empty tables give no rows.
    """
    mine = fresh(docs, "_kept_id")
    ids = decided.where(keep).select(F.col("doc_id").alias(mine)).distinct()
    return docs.join(ids.hint("merge"), docs["doc_id"].eqNullSafe(F.col(mine)), "left_semi")


def unique_rows(docs: DataFrame) -> DataFrame:
    """docs with one row for each text: of equal texts that of the largest doc_id, and of rows that repeat both one.

    Null texts count as empty; a null doc_id stays only where its text has no other. Other columns are carried,
    whatever their names; an empty table gives no rows.
    """
    mine = fresh(docs, "_row")
    name = lambda digest, doc_id: F.concat_ws(":", digest, F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    index = live_digests(_digests(docs)).select(name(F.lower(F.hex("digest")), "keep_id").alias(mine))
    rows = docs.withColumn(mine, name(F.sha2(F.coalesce("text", F.lit("")), 256), "doc_id"))
    return rows.join(written(index, "live").hint("merge"), mine, "left_semi").dropDuplicates([mine]).drop(mine).select(docs.columns)
