"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import string
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group is hot when it holds more than one row in HOT_SHARE; at most HOT_SHARE groups can be.
HOT_SHARE = 1000
#: Entries that a task keeps of its word cache before it starts afresh.
CACHE_WORDS = 400_000
#: What most often stands before and behind the letters and digits of a word.
SIGNS = string.punctuation


@lru_cache(maxsize=1)
def _own_scratch() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Without one a local folder serves a local master only, for
    executors elsewhere could not read it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or _own_scratch()


#: Spark's setting to remove a query's shuffle files once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts its lineage.

    The exchanges of the write serve nothing afterwards, so their files go as soon as it has ended.
    """
    path, conf = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


#: Rows of a narrow table that are worth a file of their own, and files that a small table has at most.
ROWS_A_FILE, FEW_FILES = 20_000, 4


def few(df: DataFrame, rows: int, per: int = ROWS_A_FILE) -> DataFrame:
    """df, which has so many rows at most, in no more tasks than they are worth.

    Every file that a task writes to a local folder costs two processes, where Hadoop has no native library: its JVM
    starts chmod for the file and for its checksums. Large tables keep the partitions that they have.
    """
    return df.coalesce(max(FEW_FILES, -(-rows // per)))


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing will read again: what was made of them must be written itself."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def attach(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str = "n", how: str = "inner", share: int = HOT_SHARE) -> DataFrame:
    """Join rows with groups (one row a key, `size` rows each) on key, however uneven the groups.

    Both should be written tables: each is read twice. The groups that hold more than one row in
    share are at most share in number, so they are broadcast; all others meet by a shuffle.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("_total"))
    hot = (
        groups.crossJoin(F.broadcast(total))
        .where((F.col(size) > 200) & (F.col(size) * share > F.col("_total")))
        .drop("_total")
    )
    first = rows.join(F.broadcast(hot), key, "inner")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return first.unionByName(rest.join(groups.hint("merge"), key, how))


_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """What this worker keeps under a name from task to task. What it kept under other names goes, so that the
    stages of a session do not add up in a worker, which Spark uses again for all of them."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word) >> 1


class _Known(dict):
    """Hash of a part's word as 8 bytes, no bytes where there is no word; worked out when first asked for."""

    def __missing__(self, part: str) -> bytes:
        kept = part.lower()
        if not kept.isalnum():
            kept = kept.strip(SIGNS)
            if not kept.isalnum():
                kept = "".join(filter(str.isalnum, kept))
        h = (word_hash(kept) | 1).to_bytes(8, "little") if kept else b""
        if len(part) <= 40:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[part] = h
        return h


#: What a byte of a text is: white space, part of a word, or a sign (0); and the byte in lower case.
SPACE, ALNUM, BEYOND = 1, 2, 4
_KIND = np.array([SPACE * chr(i).isspace() | ALNUM * chr(i).isalnum() if i < 128 else BEYOND for i in range(256)], np.uint8)
_LOWER = np.array([ord(chr(i).lower()) if i < 128 else i for i in range(256)], np.uint8)
_SPACES = re.compile(rb"[\t-\r\x1c- ]")
#: Characters of texts whose words are hashed together: few, so that their arrays stay in a processor's cache.
TOGETHER = 1 << 17
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def short_hashes(chars: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """xxh64 of the n bytes (under 32) from each place of chars on; chars has 8 bytes more behind the last."""
    eight = np.ndarray(len(chars) - 7, "<u8", chars, strides=(1,))
    at = at.copy()
    h = n.astype(np.uint64) + _P5
    for least in (8, 16, 24):
        some = np.flatnonzero(n >= least)
        if not len(some):
            break
        h[some] = _turned(h[some] ^ _turned(eight[at[some]] * _P2, 31) * _P1, 27) * _P1 + _P4
        at[some] += 8
    lane, left = eight[at], n & 7
    some = np.flatnonzero(left & 4)
    h[some] = _turned(h[some] ^ (lane[some] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
    lane[some] >>= np.uint64(32)
    left &= 3
    for i in range(3):
        some = np.flatnonzero(left > i)
        h[some] = _turned(h[some] ^ (lane[some] >> np.uint64(8 * i) & np.uint64(255)) * _P5, 11) * _P1
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    return h


def groups_of(texts: list[str | None]) -> Iterator[list[str | None]]:
    """The texts in order, as many at a time as have TOGETHER characters, one at least."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > TOGETHER and i > start:
            yield texts[start:i]
            start, size = i, len(t or "")
    if start < len(texts):
        yield texts[start:]


class Words:
    """Hashes of a text's words: runs of letters and digits, in lower case.

    White space parts a text; what is neither letter nor digit is dropped from each part, and parts
    of which nothing remains do not count. Words of letters up to U+00FF are hashed many at once, others one by one.
    """

    def __init__(self) -> None:
        held("words", lambda: None)
        self.known = _Known()

    def __call__(self, text: str) -> np.ndarray:
        return self.together([text])[0]

    def each(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The words of each text, many texts at a time; null texts have none."""
        for some in groups_of(texts):
            words, ends = self.together(some)
            start = 0
            for end in ends.tolist():
                yield words[start:end]
                start = end

    def together(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts in a row, and where those of each text end."""
        plain = [(t or "") if not t or t.isascii() else " ".join(t.split()) for t in texts]
        raw = "\n".join(plain).encode()
        data = np.frombuffer(raw, np.uint8)
        found, places, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        while at < len(data):
            # a part between white space is not cut
            to = at + TOGETHER
            to = min(len(data), to if to >= len(data) else next((m.start() for m in _SPACES.finditer(raw, to)), len(data)))
            words, starts = self._hashed(data[at:to])
            found.append(words)
            places.append(starts + at)
            at = to
        sizes = [len(t) if t.isascii() else len(t.encode()) for t in plain]
        breaks = np.cumsum(sizes, dtype=np.int64) + np.arange(len(texts))
        return np.concatenate(found), np.searchsorted(np.concatenate(places), breaks)

    def _hashed(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of data, and the places of their first bytes."""
        kind, chars = _KIND[data], _LOWER[data]
        if beyond := (kind & BEYOND).any():
            # letters of two bytes from U+00C0 to U+00FF: all but the signs of times and division, capitals 32 below
            second = np.flatnonzero(data == 0xC3) + 1
            second = second[(data[second] != 0x97) & (data[second] != 0xB7)]
            kind[second] = kind[second - 1] = ALNUM
            chars[second[data[second] <= 0x9E]] += 32
            beyond = (kind & BEYOND).any()
        at = np.flatnonzero(kind & (ALNUM | BEYOND))
        part = np.cumsum(kind & SPACE, dtype=np.int32)[at]
        first = np.flatnonzero(np.diff(part, prepend=-1))
        n = np.diff(first, append=len(at))
        chars = np.append(chars[at], np.zeros(8, np.uint8))
        short = n < 32
        words = short_hashes(chars, first, np.where(short, n, 0)) >> np.uint64(1) | np.uint64(1)
        for i in np.flatnonzero(~short).tolist():
            words[i] = word_hash(chars[first[i] : first[i] + n[i]].tobytes()) | 1
        places = at[first]
        if beyond:
            odd = np.unique(np.searchsorted(first, np.flatnonzero(kind[at] == BEYOND), "right") - 1)
            kept = np.ones(len(words), bool)
            ends = np.append(places[1:], len(data))
            for i in odd.tolist():
                h = self.known[data[places[i] : ends[i]].tobytes().split(None, 1)[0].decode()]
                words[i], kept[i] = int.from_bytes(h, "little"), bool(h)
            words, places = words[kept], places[kept]
        return words, places

    def places(self, text: str) -> list[int]:
        """Which parts between white space are words."""
        return [i for i, p in enumerate(text.split()) if self.known[p]]


def lists(column: pa.Array) -> list:
    """The values of a column of numbers or of lists of numbers; lists hold no nulls."""
    if pa.types.is_list(column.type):
        values, ends = column.values.to_numpy(zero_copy_only=False).tolist(), column.offsets.to_numpy().tolist()
        held = [values[a:b] for a, b in zip(ends, ends[1:])]
        return held if not column.null_count else [x if ok else None for x, ok in zip(held, column.is_valid().to_pylist())]
    if column.null_count == len(column):
        return [None] * len(column)
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of k words; a shorter text is one shingle of all its words, an empty one has none."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    k = min(k, len(words))
    n = len(words) - k + 1
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = (h + words[i : i + n]) * _MIX
            h ^= h >> np.uint64(29)
    return h
