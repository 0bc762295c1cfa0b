"""Document fingerprints from statistically improbable features.

Every WINDOW-byte window of a text has an entropy; windows whose entropy is rare in the corpus are preferred. A
window that is the rarest of enough of its neighbourhoods is a feature. Features go into chained Bloom
filters of fixed capacity, and two fingerprints are compared by the overlap of their filters' bits,
normalised by what chance would give.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import mix, partitions

#: Bytes of a window, ranks in a neighbourhood, neighbourhoods a feature must win.
WINDOW, NEIGHBOURS, WINS = 32, 16, 4
#: Texts of fewer bytes have all their windows as features, and all windows of SMALL bytes too.
SHORT, SMALL = 256, 8
#: Bytes of texts that are taken together.
TOGETHER = 1 << 18
#: Classes of entropy; those below LOW (nearly constant bytes) are used only where there are no others.
CLASSES, LOW = 1000, 100
#: Bits and features of a Bloom filter, bits that a feature sets.
BITS, CAPACITY, SET = 2048, 160, 5
#: Bytes whose entropies are computed at a time.
CHUNK = 1 << 16

_C = np.arange(WINDOW + 1)
_CLOGC = np.round(np.where(_C > 0, _C * np.log2(np.maximum(_C, 1)), 0) * 1024).astype(np.int32)
#: What one more, or one less, of a byte that is there c times changes in the sum of c log c.
_MORE, _LESS = np.append(np.diff(_CLOGC), 0).astype(np.int32), np.append(0, -np.diff(_CLOGC)).astype(np.int32)


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy class of each window of data (uint8); one class if data is shorter than a window."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int16)
    # how often a byte stands among the WINDOW - 1 before it, and among as many after it
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    same = np.empty(CHUNK, np.uint8)
    for at in range(0, n, CHUNK):
        to = min(n, at + CHUNK)
        for d in range(1, WINDOW):
            lo = max(at, d)
            if lo >= to:
                break
            eq = same[: to - lo]
            np.equal(data[lo:to], data[lo - d : to - d], out=eq.view(bool))
            before[lo:to] += eq
            after[lo - d : to - d] += eq
    first = np.bincount(data[:WINDOW], minlength=256)
    total = np.empty(n - WINDOW + 1, np.int32)
    total[0] = _CLOGC[first].sum()
    if n > WINDOW:
        out_ = after[: n - WINDOW].astype(np.int64) + 1  # of the byte that leaves, with itself
        total[1:] = _LESS[out_] + _MORE[before[WINDOW:]]
        np.cumsum(total, out=total)
    most = np.log2(WINDOW)
    return np.clip((most - total / (1024 * WINDOW)) * (CLASSES / most), 0, CLASSES).astype(np.int16)


def entropies_of(texts: list[np.ndarray]) -> Iterator[np.ndarray]:
    """entropies() of each text, computed for many at once: a window's entropy does not depend on what is around it."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= TOGETHER):
            size += len(texts[to])
            to += 1
        joined = entropies(np.concatenate(texts[at:to]))
        start = 0
        for t in texts[at:to]:
            yield joined[start : start + max(0, len(t) - WINDOW + 1)]
            start += len(t)
        at = to


def precedence(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy class, rarest first; classes below LOW come last."""
    order = np.lexsort((np.arange(CLASSES + 1), counts))
    rank = np.empty(CLASSES + 1, np.uint16)
    rank[order] = np.arange(CLASSES + 1)
    rank[:LOW] += CLASSES + 1
    return rank


def selected(ranks: np.ndarray) -> np.ndarray:
    """Windows that win WINS neighbourhoods or more (the leftmost of equals wins); of few windows, the rarest one."""
    n = len(ranks)
    if n == 0:
        return np.zeros(0, np.int64)
    if n < NEIGHBOURS:
        return np.array([int(ranks.argmin())])
    key = ranks.astype(np.uint64) << np.uint64(40) | np.arange(n, dtype=np.uint64)
    span = 1
    while span < NEIGHBOURS:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    won = (key & np.uint64((1 << 40) - 1)).astype(np.int64)
    # winners ascend, so runs of the same one are its wins
    starts = np.flatnonzero(np.append(True, won[1:] != won[:-1]))
    wins = np.diff(np.append(starts, len(won)))
    found = won[starts[wins >= WINS]]
    return found if len(found) else won[starts[[int(wins.argmax())]]]


_POWERS = mix(np.arange(1, WINDOW + 1, dtype=np.uint64)) | np.uint64(1)


def _hashes(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    windows = np.lib.stride_tricks.sliding_window_view(data, size)
    with np.errstate(over="ignore"):
        parts = [(windows[at[i : i + 4096]].astype(np.uint64) * _POWERS[:size]).sum(axis=1) for i in range(0, len(at), 4096)]
    return mix(np.concatenate(parts))


def features(data: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Hashes of the features of a text, whose windows have these ranks; an empty text has none."""
    n = len(data)
    if n >= SHORT:
        return _hashes(data, selected(ranks), WINDOW)
    own = [_hashes(data, np.arange(n - size + 1), size) for size in (WINDOW, SMALL) if n >= size]
    if not own and n:
        own = [_hashes(np.append(data, np.zeros(SMALL - n, np.uint8)), np.array([0]), SMALL)]
    return np.concatenate(own) if own else np.zeros(0, np.uint64)


def filters(hashes: np.ndarray) -> np.ndarray:
    """Chained Bloom filters, one row of BITS / 8 bytes for each CAPACITY distinct features in the order of the text."""
    _, first = np.unique(hashes, return_index=True)
    h = hashes[np.sort(first)]
    rows = -(-len(h) // CAPACITY)
    bits = np.zeros((rows, BITS), bool)
    row = np.arange(len(h)) // CAPACITY
    for i in range(SET):
        bits[row, ((h >> np.uint64(11 * i)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: mean over the filters of the shorter chain of their best overlap with the other's, less chance."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    x, y = np.unpackbits(a, axis=1).astype(np.float32), np.unpackbits(b, axis=1).astype(np.float32)
    nx, ny = x.sum(1)[:, None], y.sum(1)[None, :]
    chance = nx * ny / BITS
    most = np.minimum(nx, ny)
    score = np.clip((x @ y.T - chance) / np.maximum(most - chance, 1), 0, 1)
    # a filter's weight is its bits, so that a last filter with few features counts little
    return float(min(1.0, (score.max(axis=1) * nx[:, 0]).sum() / nx.sum()))


def encode(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BITS // 8)


class Text:
    """A text's bytes and entropies, so that edited texts need no second pass."""

    def __init__(self, text: str, entropy: np.ndarray | None = None) -> None:
        self.text, self.raw = text, text.encode("utf-8", "surrogatepass")
        self.data = np.frombuffer(self.raw, np.uint8)
        self.entropy = entropies(self.data) if entropy is None else entropy

    def head(self, chars: int) -> int:
        """Bytes of the first code points."""
        return chars if len(self.raw) == len(self.text) else len(self.text[:chars].encode("utf-8", "surrogatepass"))


def fingerprint(data: np.ndarray, entropy: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return filters(features(data, rank[entropy]))


def edited(a: Text, b: Text) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and entropies of a with its last half replaced by as much of b's start."""
    half = len(a.text) // 2
    i, j = a.head(len(a.text) - half), b.head(min(half, len(b.text)))
    data = np.concatenate([a.data[:i], b.data[:j]])
    own, other = max(0, i - WINDOW + 1), max(0, j - WINDOW + 1)
    # windows that hold bytes of both
    seam = entropies(data[own : len(data) - other + WINDOW - 1 if other else len(data)]) if i and j else a.entropy[:0]
    if other and i and j:
        seam = seam[: i - own]
    return data, np.concatenate([a.entropy[:own], seam, b.entropy[:other]])


def _bytes(texts: list[str | None]) -> list[np.ndarray]:
    return [np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8) for t in texts]


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CLASSES + 1, np.int64)
    for b in batches:
        for e in entropies_of(_bytes(b["text"].to_pylist())):
            counts += np.bincount(e, minlength=CLASSES + 1)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], ["entropy", "n"])


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _run(rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of range and document; a range ends with a copy of the next range's first document."""
        rows: list[tuple] = []
        last = None  # range, doc_id, Text, fingerprint

        def out():
            cols = list(zip(*rows)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64())
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [c.split()[0] for c in OUT.split(", ")])
            rows.clear()
            return batch

        for b in batches:
            columns = [b[c].to_pylist() for c in ("range", "guest", "doc_id", "text")]
            for part, guest, doc_id, text, entropy in zip(*columns, entropies_of(_bytes(columns[3]))):
                if guest and (last is None or last[0] != part):
                    continue
                now = Text(text, entropy)
                chain = fingerprint(now.data, now.entropy, rank)
                if last is not None and last[0] == part:
                    data, entropy = edited(last[2], now)
                    other = fingerprint(data, entropy, rank)
                    rows.append((last[1], len(last[2].text), hashlib.sha256(data.tobytes()).hexdigest(), encode(last[3]), encode(other), likeness(last[3], other), likeness(last[3], chain)))
                last = None if guest else (part, doc_id, now, chain)
            yield out()

    return run


def rarity(texts: DataFrame) -> np.ndarray:
    """Ranks of the entropy classes by how often the whole corpus has them: CLASSES + 1 counts, whatever its size."""
    counts = np.zeros(CLASSES + 1, np.int64)
    for r in texts.mapInArrow(_histogram, "entropy int, n long").groupBy("entropy").agg(F.sum("n").alias("n")).collect():
        counts[r["entropy"]] = r["n"]
    return precedence(counts)


def with_next(texts: DataFrame) -> DataFrame:
    """texts (doc_id, text) dealt into ranges of doc_id, in order, each followed by the first document of the next range.

    Columns range, guest, doc_id, text. The last range is followed by the first document of all. Only the
    ranges' bounds and smallest ids, one number a range, come to the driver.
    """
    spark = texts.sparkSession
    ids = texts.select(F.col("doc_id").cast("double").alias("v"))
    n = partitions(spark)
    cuts = ids.where("v IS NOT NULL").approxQuantile("v", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    bounds = [-np.inf, *(sorted(set(cuts)) or [0.0]), np.inf]  # it takes two ranges at least
    place = Bucketizer(splits=[float(x) for x in bounds], inputCol="v", outputCol="range", handleInvalid="keep")
    rows = texts.withColumn("v", F.coalesce(F.col("doc_id").cast("double"), F.lit(-1e300)))  # rows without an id come first
    rows = place.transform(rows).withColumn("range", F.col("range").cast("int"))
    least = sorted((r["range"], r["least"]) for r in rows.groupBy("range").agg(F.min("v").alias("least")).collect())
    if not least:
        return rows.select("range", F.lit(False).alias("guest"), "doc_id", "text")
    before = [(r, v, least[i - 1][0]) for i, (r, v) in enumerate(least)]
    firsts = F.broadcast(spark.createDataFrame(before, "range int, v double, before int"))  # a row for each range
    guests = rows.join(firsts, ["range", "v"]).select(F.col("before").alias("range"), F.lit(True).alias("guest"), "doc_id", "text")
    return rows.select("range", F.lit(False).alias("guest"), "doc_id", "text").unionByName(guests)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): the columns of OUT.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many,
    or all, of the next document in ascending doc_id; the first follows the last. Null texts are empty; rows
    without a doc_id come before all others, and rows with the same doc_id are in the order of their texts'
    digests. An empty text has no filter: it is like another empty one (1) and unlike any other (0). A single
    row is followed by itself. Other columns are ignored; an empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rank = rarity(texts)
    n = partitions(docs.sparkSession)
    dealt = with_next(texts).repartitionById(n, F.pmod(F.col("range"), F.lit(n))).sortWithinPartitions("range", "guest", F.asc_nulls_first("doc_id"), F.sha2("text", 256))
    return dealt.select("range", "guest", "doc_id", "text").mapInArrow(_run(rank), OUT)
