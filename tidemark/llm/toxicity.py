"""Toxicity by a factorization machine over hashed terms.

Terms are a text's words and the starts of its words. They are hashed to buckets; the buckets that tell the
labels apart best, by counts over the labelled rows, are the features. A factorization machine learns a weight
for each and an interaction for each pair, so that two terms together can mean what neither does alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import CACHE_WORDS, held, written

BUCKETS = 1 << 20
#: Letters of the starts of words that are terms.
STARTS = (4, 5, 6)
#: Features, factors of each, labelled rows that a bucket must be in, and its likelihood ratio (G squared) at least.
FEATURES, FACTORS, LEAST_ROWS, LEAST_RATIO = 2048, 8, 4, 15.0
#: Labelled rows that the machine is fitted on, about: where there are more, those whose ids have small hashes. A
#: bound of the fit alone; which buckets are features is counted over all labelled rows.
FIT_ROWS = 40_000
ITERATIONS, STEP, PENALTY = 80, 0.1, 1e-3
TOXIC_FROM = 0.7

_WORD = re.compile(r"[^\W_]+")


class Terms:
    """Buckets of the terms of a text; those of each part between white space are worked out once."""

    def __init__(self, wanted: dict[int, int] | None = None) -> None:
        held("terms", lambda: None)
        self.wanted, self.known = wanted, {}

    def _of(self, part: str) -> tuple[int, ...]:
        found = set()
        for word in _WORD.findall(part.casefold()):
            for term in (f"={word}", *(f"{n}{word[:n]}" for n in STARTS if len(word) >= n)):
                b = xxhash.xxh64_intdigest(term) % BUCKETS
                if self.wanted is None:
                    found.add(b)
                elif b in self.wanted:
                    found.add(self.wanted[b])
        return tuple(found)

    def __call__(self, text: str) -> list[int]:
        known, found = self.known, set()
        for part in set(text.split()):
            t = known.get(part)
            if t is None:
                t = self._of(part)
                if len(part) <= 40:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    known[part] = t
            found.update(t)
        return sorted(found)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Terms()
    for b in batches:
        lists = [terms(t or "") for t in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["toxic"], pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "toxic", "terms"])


class Machine:
    """features: place of each bucket; score(places) is the probability of label 1."""

    def __init__(self, buckets: list[int], bias: float, weights: np.ndarray, factors: np.ndarray) -> None:
        self.places = {b: i for i, b in enumerate(buckets)}
        self.bias, self.weights, self.factors = bias, weights, factors

    def score(self, at: list[int]) -> float:
        v = self.factors[at]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v * v).sum(axis=0)).sum()) if len(at) > 1 else 0.0
        z = self.bias + float(self.weights[at].sum()) + pairs
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def fit(labelled: DataFrame, features: int = FEATURES, fit_rows: int = FIT_ROWS, least_ratio: float = LEAST_RATIO, iterations: int = ITERATIONS, step: float = STEP, penalty: float = PENALTY) -> Machine:
    """A machine from labelled rows (doc_id, text, toxic 0/1); null labels do not count.

    Without both labels, or without a bucket that tells them apart, the machine gives the share of label 1 for every text (one half if there are no rows).
    """
    spark = labelled.sparkSession
    rows = labelled.where("toxic IN (0, 1)").selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(toxic AS INT) AS toxic", "text")
    rows = written(rows.mapInArrow(_buckets, "doc_id long, toxic int, terms array<int>"), "labelled")
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("k")).first()
    share = (n["k"] + 0.5) / (n["n"] + 1)
    plain = Machine([], math.log(share / (1 - share)), np.zeros(0), np.zeros((0, FACTORS)))
    if n["k"] in (0, n["n"]):
        return plain
    # log-likelihood ratio of presence against the label, from counts of all labelled rows
    total, toxic = float(n["n"]), float(n["k"])
    counts = rows.select("toxic", F.explode("terms").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).cast("double").alias("m"), F.sum("toxic").cast("double").alias("t"))
    xlogx = lambda c: F.when(c > 0, c * F.log(c)).otherwise(0.0)
    m, t = F.col("m"), F.col("t")
    gain = xlogx(t) + xlogx(m - t) + xlogx(toxic - t) + xlogx(total - toxic - (m - t)) - xlogx(m) - xlogx(total - m)
    none = toxic * math.log(toxic) + (total - toxic) * math.log(total - toxic) - total * math.log(total)
    best = counts.where(m >= LEAST_ROWS).withColumn("gain", gain).where(F.col("gain") - none >= least_ratio / 2).orderBy(F.desc("gain"), "bucket").limit(features)
    buckets = [r["bucket"] for r in best.select("bucket").collect()]  # FEATURES numbers at most
    if not buckets:
        return plain
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(fit_rows / max(fit_rows, total) * (1 << 20)))
    vectors = CountVectorizerModel.from_vocabulary([str(b) for b in buckets], inputCol="names", outputCol="features", minTF=1.0)
    vectors.setBinary(True)
    named = vectors.transform(sample.select("toxic", F.col("terms").cast("array<string>").alias("names")))
    ready = written(named.select(F.col("toxic").cast("double").alias("label"), "features"), "vectors")
    ready = ready.repartition(spark.sparkContext.defaultParallelism).cache()
    try:
        fm = FMClassifier(factorSize=FACTORS, maxIter=iterations, stepSize=step, regParam=penalty, solver="adamW", initStd=0.05, seed=11).fit(ready)
    finally:
        ready.unpersist()
    return Machine(buckets, float(fm.intercept), fm.linear.toArray(), fm.factors.toArray())


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from TOXIC_FROM on) of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(machine.places)
        for b in batches:
            scores = np.array([machine.score(terms(t or "")) for t in b["text"].to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(scores), pa.array((scores >= TOXIC_FROM).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(doc_id="doc_id"):
    """Rows that no machine learns from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> Machine:
    """A machine from the labels (doc_id, toxic) of rows that are not held out; labels that differ for an id do not count."""
    sure = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most")).where("toxic = _most")
    sure = sure.where(~held_out()).select(F.col("doc_id").alias("_id"), "toxic")
    rows = docs.select("doc_id", "text").where(~held_out())
    return fit(rows.join(sure.hint("shuffle_hash"), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score, predicted.

    Only the text is scored; null texts are empty and score what the machine's bias alone gives. Rows without a
    doc_id are scored and never learned from. Rows that repeat an id are scored each for itself. Other columns
    of either table are ignored; an empty table gives no rows.
    """
    scored = score(docs, learn(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of docs that the machine does not call toxic, with all their columns, whatever their names.

    Each row is judged for itself, whatever its id; null and empty texts score what the machine's bias alone
    gives; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(machine.places)
        for b in batches:
            yield b.filter(pa.array([machine.score(terms(t or "")) < TOXIC_FROM for t in b["text"].to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
