"""Near-duplicate documents by improved consistent weighted sampling.

A document is the weighted set of its five-word shingles, each weighing its count times the inverse
document frequency of its hash bucket. Consistent weighted samples, in BANDS bands of ROWS, propose
candidates: two documents of weighted Jaccard similarity s meet with probability 1 - (1 - s^ROWS)^BANDS,
0.9994 at 0.8. Candidates are verified by their exact weighted Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Words, attach, discard, few, mix, shingles, written
from .components import components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 14, 4
#: Hash buckets whose document frequencies weigh the shingles; a fixed number, whatever the corpus.
DF_BITS = 16
#: Documents of a bucket that the first round compares with all others; each further round so many times as many.
PIVOTS = 16
#: Rows of a bucket, or partners of a document, that a task gets.
PER_TASK = 512
#: Texts that are worth a task of their own.
TEXTS = 2_000
#: Groups of shingles by which bounds are kept.
GROUPS = 32
#: Weight that two sets must share, of the sum of their weights, to be SIMILARITY alike.
SHARE = SIMILARITY / (1 + SIMILARITY) - 1e-9
#: Steps of the tables of gamma variates.
STEPS = 4096


def _gamma_steps() -> np.ndarray:
    """Gamma(2, 1) at the middle of STEPS equal parts of probability, by bisection of its distribution."""
    p = (np.arange(STEPS) + 0.5) / STEPS
    low, high = np.zeros(STEPS), np.full(STEPS, 60.0)
    for _ in range(60):
        x = (low + high) / 2
        below = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(below, x, low), np.where(below, high, x)
    return (low + high) / 2


class Sampler:
    """Band keys of weighted sets."""

    def __init__(self) -> None:
        g = _gamma_steps()
        self.r, self.log_c = g.astype(np.float32), np.log(g).astype(np.float32)
        self.per_r = (1 / g).astype(np.float32)
        self.factors = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)

    def samples(self, h: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One sample for each factor: a hash of the shingle drawn and its step."""
        log_w = np.log(weights).astype(np.float32)
        k = len(self.factors)
        best, drawn = np.full(k, np.inf, np.float32), np.zeros(k, np.uint64)
        cols = np.arange(k)
        for at in range(0, len(h), 1024):
            part = h[at : at + 1024, None]
            with np.errstate(over="ignore"):
                p = part * self.factors
            p ^= p >> np.uint64(29)
            # three numbers of 12 bits from each product: steps of r and of c, and beta
            bits = p.view(np.int64)
            step = bits & 4095
            r = self.r.take(step)
            t = self.per_r.take(step)
            t *= log_w[at : at + 1024, None]
            beta = ((bits >> 12) & 4095).astype(np.float32)
            beta += 0.5
            beta *= 1 / STEPS
            t += beta
            np.floor(t, out=t)
            # ln a = ln c - ln y - r, with ln y = r (t - beta)
            beta -= t
            beta -= 1
            beta *= r
            beta += self.log_c.take((p >> np.uint64(52)).view(np.int64))
            row = beta.argmin(axis=0)
            least = beta[row, cols]
            with np.errstate(over="ignore"):
                found = mix(part[row, 0] + t[row, cols].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            drawn = np.where(least < best, found, drawn)
            best = np.minimum(best, least)
        return drawn

    def bands(self, h: np.ndarray, weights: np.ndarray) -> np.ndarray:
        s = self.samples(h, weights).reshape(BANDS, ROWS)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for i in range(ROWS):
            key = mix(key ^ s[:, i])
        return key.view(np.int64)


def weighted(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles and their weights."""
    h, n = np.unique(shingles(words, WORDS), return_counts=True)
    return h, n * idf[(h >> np.uint64(64 - DF_BITS)).astype(np.int64)]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets as weighted() gives them."""
    total = a[1].sum() + b[1].sum()
    if not total:
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (total - both))


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (doc_id, h, digest of its words) for each document, and at the end the task's document frequencies."""
    words, df = Words(), np.zeros(1 << DF_BITS, np.int64)
    none = lambda n, kind: pa.nulls(n, kind)
    names = ["doc_id", "h", "digest", "bucket", "n"]
    for b in batches:
        digests = []
        for w in words.each(b["text"].to_pylist()):
            digests.append(xxhash.xxh3_128_digest(w.tobytes()) if len(w) else None)
            if len(w):
                h = np.unique(shingles(w, WORDS)) >> np.uint64(64 - DF_BITS)
                df += np.bincount(h.astype(np.int64), minlength=1 << DF_BITS)
        n = len(digests)
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["h"], pa.array(digests, pa.binary()), none(n, pa.int32()), none(n, pa.int64())], names)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([none(len(at), pa.int64()), none(len(at), pa.int64()), none(len(at), pa.binary()), pa.array(at, pa.int32()), pa.array(df[at])], names)


def _sign(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sampler = Words(), Sampler()
        for b in batches:
            keys, ids, hashes = [], [], []
            for doc_id, h, w in zip(b["doc_id"].to_pylist(), b["h"].to_pylist(), words.each(b["text"].to_pylist())):
                if len(w):
                    ids.append(doc_id)
                    hashes.append(h)
                    keys.append(sampler.bands(*weighted(w, idf)))
            values = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * BANDS, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), lists], ["doc_id", "h", "keys"])

    return run


def _verify(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        last, kept = None, None
        for batch in batches:
            a, b, s = [], [], []
            for i, j, first, second in zip(*(batch[c].to_pylist() for c in ("a", "b", "a_text", "b_text"))):
                if i != last:
                    last, kept = i, weighted(words(first or ""), idf)
                x = similarity(kept, weighted(words(second or ""), idf))
                if x >= SIMILARITY - 1e-9:
                    a.append(i)
                    b.append(j)
                    s.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], ["a", "b", "similarity"])

    return run


def _linked(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, number: int) -> DataFrame:
    """The pairs (a, b) whose documents are alike enough. pairs: a written table of `number` rows.

    The text of an `a` with many partners is sent out once for each PER_TASK of them. A written table.
    """
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("salts", F.ceil(F.col("n") / PER_TASK))
    counts = written(few(counts, number), "counts")
    salted = attach(pairs, counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    u = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")).join(counts.hint("merge"), "a")
    u = u.select("a", "a_text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    t = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text"))
    joined = salted.join(t.hint("merge"), "b").join(u.hint("merge"), ["a", "salt"])
    found = joined.select("a", "b", "a_text", "b_text").mapInArrow(_verify(idf), "a long, b long, similarity double")
    found = written(found, "links")  # not few tasks: each would hold the sorted texts of many partitions
    discard(counts)
    return found


def _own(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                sets = [weighted(w, idf) for w in words.each(part["text"].to_pylist())]
                ids = np.repeat(part["doc_id"].to_numpy(zero_copy_only=False), [len(h) for h, _ in sets])
                cols = [np.concatenate([h for h, _ in sets]).view(np.int64), ids, np.concatenate([w for _, w in sets]).astype(np.float64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["shingle", "doc_id", "w"])

    return run


def _bounds(texts: DataFrame, idf: np.ndarray, number: int) -> DataFrame:
    """doc_id, w, shared, s0, s1, ...: a document's weight, the part of it on shingles that others of texts have as
    well, and that part by GROUPS groups of shingles. Two documents share at most the sum of the smaller ones. number: of texts, at most.
    """
    rows = written(few(texts.mapInArrow(_own(idf), "shingle long, doc_id long, w double"), number, TEXTS), "shingles")
    by = rows.groupBy("shingle").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), F.min("w").alias("w"))
    alone = by.where("doc_id = last").select("shingle", "doc_id", F.lit(0.0).alias("w"), (-F.col("w")).alias("s"))
    both = rows.select("shingle", "doc_id", "w", F.col("w").alias("s")).unionByName(alone).withColumn("g", F.pmod("shingle", F.lit(GROUPS)))
    sums = [F.sum(F.when(F.col("g") == i, F.col("s")).otherwise(0.0)).alias(f"s{i}") for i in range(GROUPS)]
    bounds = written(few(both.groupBy("doc_id").agg(F.sum("w").alias("w"), F.sum("s").alias("shared"), *sums), number, TEXTS), "bounds")
    discard(rows)
    return bounds


def _pivots(opened: DataFrame, number: int, rows: int) -> DataFrame:
    """`number` documents of each bucket, to be compared with all others in it. rows: of opened, at most.

    Those outside the bucket's largest component come first, for with all of them as pivots a bucket is settled;
    among them, and where no component is larger, those that share most of their weight: the least edited of a
    group of copies, which is like most of them.
    """
    sizes = written(few(opened.groupBy("key", "root").agg(F.count(F.lit(1)).alias("own")), rows), "sizes")
    top = sizes.groupBy("key").agg(F.max_by("root", F.struct("own", "root")).alias("top"), F.max("own").alias("own"), F.sum("own").alias("n"))
    top = written(few(top.select("key", "n", F.when(F.col("own") > 1, F.col("top")).alias("top")), rows), "top")
    ranked = attach(opened.drop("n"), top, "key").withColumn("late", F.coalesce(F.col("root") == F.col("top"), F.lit(False)))
    ranked = ranked.withColumn("apart", F.round(1 - F.col("shared") / F.col("w"), 9)).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / PER_TASK)))
    order = ("late", "apart", "doc_id")
    first = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("key", "salt").orderBy(*order))).where(F.col("rank") <= number)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("rank") <= number)
    pivots = written(few(first.select("key", "doc_id", "root", "n"), rows), "pivots")
    discard(sizes, top)
    return pivots


def _candidates(opened: DataFrame, pivots: DataFrame, bounds: DataFrame) -> DataFrame:
    """a, b: pairs of a pivot and another document of its bucket, of different components, that their bounds let be alike."""
    names = ["w", *(f"s{i}" for i in range(GROUPS))]
    salts = F.ceil(F.col("n") / PER_TASK)
    known = bounds.select("doc_id", *names)
    rows = opened.select("key", "doc_id", "root", F.pmod(F.xxhash64("doc_id"), salts).alias("salt")).join(known.hint("merge"), "doc_id")
    p = pivots.select("key", "doc_id", "root", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt")).join(known.hint("merge"), "doc_id")
    p = p.select("key", "salt", *(F.col(c).alias(f"p_{c}") for c in ("doc_id", "root", *names)))
    most = sum((F.least(f"s{i}", f"p_s{i}") for i in range(1, GROUPS)), F.least("s0", "p_s0"))
    alike = (F.col("root") != F.col("p_root")) & (most >= SHARE * (F.col("w") + F.col("p_w")) - 1e-6)
    pairs = rows.join(p.hint("merge"), (rows["key"] == p["key"]) & (rows["salt"] == p["salt"]) & alike)
    return pairs.select(F.least("doc_id", "p_doc_id").alias("a"), F.greatest("doc_id", "p_doc_id").alias("b")).distinct()


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(members, reps, links, roots): doc_id, digest and rows of every document that has words; digest, rep (the
    smallest id with the same words) and n; verified links a, b, similarity between representatives; and node, root
    of their components.

    First each document of a bucket is compared with the bucket's smallest. Components that arise need no further
    comparison inside. Where components still share a bucket, pivots are compared with all others in it, PIVOTS
    a bucket, then PIVOTS times as many in each further round, until no bucket holds two components that may yet be
    linked. So no link between components is lost, and the work is that of the documents left apart, not of all
    pairs. Bounds decide first which documents can be alike at all: what a document has on shingles of its own
    alone it shares with nobody, and by groups of shingles two documents share at most the lesser weight.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).where("doc_id IS NOT NULL")
    survey = written(texts.mapInArrow(_survey, "doc_id long, h long, digest binary, bucket int, n long"), "survey")
    # A fixed number of counts, whatever the corpus: these alone come to the driver.
    counts = survey.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = survey.where("digest IS NOT NULL").count()
    df = np.zeros(1 << DF_BITS)
    df[counts["bucket"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy(dtype=np.float64)
    idf = np.log1p((total + 1) / (df + 1))

    # of rows that repeat an id one text stands for all
    named = survey.where("digest IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("h", "digest")).alias("one"), F.count(F.lit(1)).alias("rows"))
    members = written(few(named.select("doc_id", "rows", "one.h", "one.digest"), total), "members")
    reps = members.groupBy("digest").agg(F.min(F.struct("doc_id", "h")).alias("one"), F.count(F.lit(1)).alias("n"))
    discard(survey)
    reps = written(few(reps.select("digest", F.col("one.doc_id").alias("rep"), F.col("one.h").alias("rep_h"), "n"), total), "reps")

    signed = written(texts.mapInArrow(_sign(idf), "doc_id long, h long, keys array<long>"), "signed")
    own = signed.join(reps.select("rep", "rep_h").hint("merge"), (F.col("doc_id") == F.col("rep")) & (F.col("h") == F.col("rep_h")), "left_semi")
    rows = written(few(own.select("doc_id", "h", F.explode("keys").alias("key")).distinct(), BANDS * total), "bands")
    discard(signed)
    shared = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(few(shared, BANDS * total // 2), "shared")
    buckets = written(few(attach(rows, shared, "key").select("key", "doc_id", "h", "first"), BANDS * total), "buckets")
    most = buckets.count()  # all later buckets are parts of these
    discard(rows, shared)
    wanted = buckets.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    near = texts.join(wanted.hint("shuffle_hash"), (F.col("doc_id") == F.col("_id")) & (F.col("h") == F.col("_h")), "left_semi")
    near = written(few(near.dropDuplicates(["doc_id", "h"]).select("doc_id", "text"), total, TEXTS), "near")

    pairs = buckets.where("doc_id > first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()
    pairs = written(few(pairs, most), "pairs")
    found = _linked(pairs, near, idf, pairs.count())
    done = pairs
    roots, all_buckets = components(found, found.count()), buckets
    buckets = _open(buckets.where("doc_id > first").select("key", "doc_id"), roots, most)  # the smallest has met all others
    discard(all_buckets)
    if buckets is None:
        return members, reps, found, roots
    wanted = buckets.select(F.col("doc_id").alias("_id")).distinct()
    bounds = _bounds(near.join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("_id"), "left_semi"), idf, min(most, total))
    before = [buckets]  # tables that the next round's buckets are made of
    buckets, number = buckets.select("key", "doc_id").join(bounds.select("doc_id", "w", "shared").hint("merge"), "doc_id"), PIVOTS
    while True:
        buckets = _open(buckets, roots, most, bounded=True)
        discard(*before)
        if buckets is None:
            discard(near, bounds)
            return members, reps, found, roots
        pivots = _pivots(buckets, number, most)
        before = [buckets, pivots]
        pairs = _candidates(buckets, pivots, bounds).join(done.hint("merge"), ["a", "b"], "left_anti")
        pairs = written(few(pairs, most * number), "pairs")
        if n := pairs.count():
            new, old = _linked(pairs, near, idf, n), [found, roots]
            found = written(few(found.unionByName(new), found.count() + n), "links")
            done = done.unionByName(pairs)
            roots = components(found, found.count())
            discard(new, *old)
        buckets = buckets.drop("root", "n").join(pivots.select("key", "doc_id").hint("merge"), ["key", "doc_id"], "left_anti")
        number *= PIVOTS


def _open(buckets: DataFrame, roots: DataFrame, rows: int, bounded: bool = False) -> DataFrame | None:
    """The buckets (key, doc_id, ...; so many rows at most) in which several components meet, with root and n; None if there are none.

    Of bounded ones (w, shared), documents that cannot be alike any that are there are left out first.
    """
    placed = buckets.join(roots.hint("merge"), F.col("doc_id") == F.col("node"), "left").drop("node").withColumn("root", F.coalesce("root", "doc_id"))
    placed = written(few(placed, rows), "placed")
    used = [placed]
    if bounded:
        sizes = placed.groupBy("key").agg(F.min("w").alias("least"), F.count(F.lit(1)).alias("n"))
        # partners of a document weigh at most what it shares, divided by SHARE, less its own weight
        sizes = written(few(sizes, rows), "sizes")
        placed = attach(placed, sizes, "key").where(F.col("shared") / SHARE - F.col("w") >= F.col("least") - 1e-6).drop("least", "n")
        placed = written(few(placed, rows), "placed")
        used += [sizes, placed]
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("key", "n")
    mixed = written(few(mixed, rows), "mixed")
    opened = None if mixed.isEmpty() else written(few(attach(placed, mixed, "key"), rows), "open")
    discard(*used, mixed)
    return opened


def dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, class_id, class_size, links, kept.

    Classes are the connected components of documents linked by a weighted Jaccard similarity of 0.8 or
    more; class_id is the smallest doc_id in the class and that document is kept. Documents with the same
    words are one member each of the same class; links counts the verified links of a document's
    representative, enough to hold its class together. Texts of fewer than five words are one shingle. A text
    without words (null, empty, signs only) or without a doc_id is a class of its own. Rows that repeat a doc_id
    are one document: the text whose hash is smallest stands for all, and they are marked alike. Other columns
    are ignored; an empty table gives no rows.
    """
    members, reps, found, roots = links(docs)
    rows = members.count()  # reps and classes are no more
    ends = found.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("links"))
    placed = reps.join(roots.hint("merge"), F.col("rep") == F.col("node"), "left").join(ends.hint("merge"), F.col("rep") == F.col("v"), "left")
    placed = placed.select("digest", "n", F.coalesce("root", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    placed = written(few(placed, rows), "placed")
    sizes = written(few(placed.groupBy("class_id").agg(F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("texts")), rows), "classes")
    placed = written(few(attach(placed, sizes, "class_id", "texts").select("digest", "n", "class_id", "class_size", "links"), rows), "placed")
    known = written(few(attach(members.select("doc_id", "rows", "digest"), placed, "digest").drop("digest", "n"), rows), "known")
    out = attach(docs.select(F.col("doc_id").cast("long").alias("doc_id")), known, "doc_id", "rows", "left")
    return out.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
