"""Hard negatives for every anchor, by bounds along spanning trees of anchors.

Anchors that are near each other make a tree of least total edge length. A candidate's score at an anchor lies within
its score at the anchor's parent plus or minus the edge's length times the candidate's norm, so what is known at the
parent bounds what a child can give. A first pass finds each anchor's positives, a second one the negatives whose
scores lie in the positives' windows; in both, an anchor scores only candidates whose bounds reach what it looks for.
Trees of anchors meet blocks of candidates, so no task holds more than one of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import mix, partitions, written

#: Anchors of a tree, candidates of a block.
TREE, BLOCK = 512, 4096
#: Positives of an anchor, negatives of a positive, and the window of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Integers below this are exact as doubles.
EXACT = float(1 << 53)
SIGNS = 16


def valid(rows: DataFrame) -> DataFrame:
    """vec_id, label, embedding of the rows that take part: one for each id, the least by label and vector."""
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    own = rows.where(sound).where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding")).alias("v"))
    return own.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v.label", "v.embedding")


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of floor(256 x), the shorter vectors filled with zeros."""
    values, ends = np.floor(256 * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    sizes = np.diff(ends, prepend=0)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = values
    return out


def _pack(v: np.ndarray) -> bytes:
    small = np.abs(v).max(initial=0) < 1 << 15
    return v.astype("<i2" if small else "<f8").tobytes()


def _unpack(raw: bytes, n: int, dim: int) -> np.ndarray:
    wide = len(raw) == 8 * n * dim
    return np.frombuffer(raw, "<f8" if wide else "<i2").reshape(n, dim).astype(np.float64)


_CELLS = [("part", pa.int64()), ("seq", pa.int64()), ("n", pa.int64()), ("dim", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())]
_SQL = {pa.int64(): "long", pa.binary(): "binary", pa.int32(): "int"}


def _schema(fields: list[tuple[str, pa.DataType]]) -> str:
    return ", ".join(f"{n} {_SQL[t]}" for n, t in fields)


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of all batches, size at a time."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        while n + len(b) >= size:
            held.append(b.slice(0, size - n))
            yield pa.Table.from_batches(held).combine_chunks()
            b, held, n = b.slice(size - n), [], 0
        if len(b):
            held.append(b)
            n += len(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def candidate_blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks of candidates in order of label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for seq, t in enumerate(_gathered(batches, BLOCK)):
            ids, labels, v = (t[c] for c in ("vec_id", "label", "embedding"))
            ids, labels, v = ids.to_numpy().astype("<i8"), labels.to_numpy().astype("<i4"), _matrix(_one(v))
            order = np.lexsort((ids, labels))
            cells = [TaskContext.get().partitionId(), seq, len(ids), v.shape[1], ids[order].tobytes(), labels[order].tobytes(), _pack(v[order])]
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, (_, k) in zip(cells, _CELLS)], [n for n, _ in _CELLS])

    return vectors.repartition(max(1, -(-rows // BLOCK)), "vec_id").mapInArrow(run, _schema(_CELLS))


def spanning_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows from the one nearest to their mean, each after its parent; parents' places in it; edges' lengths."""
    n = len(v)
    square = (v * v).sum(axis=1)
    first = int(np.argmin(((v - v.mean(axis=0)) ** 2).sum(axis=1)))
    order, parent, edge = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n)
    near, by, out = np.full(n, np.inf), np.zeros(n, np.int32), np.ones(n, bool)
    at = first
    for k in range(n):
        order[k], out[at] = at, False
        if k:
            parent[k], edge[k] = by[at], np.sqrt(((v[at] - v[order[by[at]]]) ** 2).sum())
        gap = np.maximum(square + square[at] - 2 * (v @ v[at]), 0)
        closer = out & (gap < near)
        near[closer], by[closer] = gap[closer], k
        at = int(np.argmin(np.where(out, near, np.inf)))
    return order, parent, edge


_TREES = [*_CELLS, ("parents", pa.binary()), ("edges", pa.binary())]


def anchor_trees(anchors: DataFrame, rows: int) -> DataFrame:
    """Trees of anchors that lie on the same sides of SIGNS planes, as far as a range of them goes."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b["embedding"])
            sides = np.where(mix(np.arange(v.shape[1] * SIGNS, dtype=np.uint64)) & np.uint64(1), 1.0, -1.0).reshape(-1, SIGNS)
            key = ((v @ sides > 0) << np.arange(SIGNS)).sum(axis=1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), b["vec_id"], b["label"], b["embedding"]], ["key", "vec_id", "label", "embedding"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for seq, t in enumerate(_gathered(batches, TREE)):
            ids, labels, v = t["vec_id"].to_numpy().astype("<i8"), t["label"].to_numpy().astype("<i4"), _matrix(_one(t["embedding"]))
            order, parents, edges = spanning_tree(v)
            cells = [TaskContext.get().partitionId(), seq, len(ids), v.shape[1], ids[order].tobytes(), labels[order].tobytes(), _pack(v[order]), parents.tobytes(), edges.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, (_, k) in zip(cells, _TREES)], [n for n, _ in _TREES])

    sided = anchors.mapInArrow(keyed, "key long, vec_id long, label int, embedding array<double>")
    ranged = sided.repartitionByRange(max(1, -(-rows // TREE)), "key", "vec_id").sortWithinPartitions("key", "vec_id")
    return ranged.mapInArrow(run, _schema(_TREES))


class Walk:
    """Bounds of a block's candidates at the anchors of a tree, narrowed as anchors score candidates."""

    def __init__(self, tree: dict, block: dict) -> None:
        self.ids, self.labels, self.v = self._cells(block)
        self.anchor_ids, self.anchor_labels, self.a = self._cells(tree)
        dim = max(self.v.shape[1], self.a.shape[1])
        self.v, self.a = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (self.v, self.a))
        self.parents, self.edges = np.frombuffer(tree["parents"], "<i4"), np.frombuffer(tree["edges"], "<f8")
        self.norms, self.anchor_norms = (np.sqrt((x * x).sum(axis=1)) for x in (self.v, self.a))
        self.exact = self.norms.max(initial=0) * self.anchor_norms.max(initial=0) < EXACT / 2
        self.low, self.high = np.zeros((2, len(self.a), len(self.v)))
        self.scored = 0

    @staticmethod
    def _cells(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i4"), _unpack(row["vectors"], row["n"], row["dim"])

    def enter(self, k: int) -> None:
        """What the parent's bounds say of anchor k. The root's are those of its norm and the candidates'."""
        p = self.parents[k]
        reach = self.norms * (self.edges[k] if k else self.anchor_norms[0])
        reach += 1e-9 * (1 + self.norms * self.anchor_norms[k])  # for the roundings of doubles
        np.subtract(self.low[p] if k else 0.0, reach, out=self.low[k])
        np.add(self.high[p] if k else 0.0, reach, out=self.high[k])

    def score(self, k: int, which: np.ndarray) -> np.ndarray:
        """Scores of candidates at anchor k; there they are known from now on."""
        if self.exact:
            s = self.v[which] @ self.a[k]
        else:
            whole = lambda x: np.array([int(y) for y in x.ravel()], object).reshape(x.shape)
            s = whole(self.v[which]) @ whole(self.a[k])
        self.low[k, which] = self.high[k, which] = s.astype(np.float64)
        self.scored += len(which)
        return s.astype(np.int64)


def _first(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:n]


def _positives(w: Walk) -> Iterator[tuple[int, int, int]]:
    """anchor_id, positive_id, score: of each anchor the best of this block."""
    for k, (anchor, label) in enumerate(zip(w.anchor_ids, w.anchor_labels)):
        w.enter(k)
        if k == 0:
            w.score(0, np.arange(len(w.v)))
        own = np.arange(np.searchsorted(w.labels, label), np.searchsorted(w.labels, label, "right"))
        own = own[w.ids[own] != anchor]
        few = min(POSITIVES, len(own))
        if not few:
            continue
        tops = own[np.argpartition(-w.high[k, own], few - 1)[:few]]
        least = w.score(k, tops).min()
        rest = np.setdiff1d(own[w.high[k, own] >= least], tops, assume_unique=True)
        found = np.concatenate([tops, rest])
        scores = np.concatenate([w.score(k, tops), w.score(k, rest)])
        for i in _first(scores, w.ids[found], POSITIVES):
            yield int(anchor), int(w.ids[found[i]]), int(scores[i])


def _window(p: int) -> tuple[int, int]:
    """The integers n with LOW p <= 100 n <= HIGH p."""
    return -(-LOW * p // 100), HIGH * p // 100


def _negatives(w: Walk, positives: list[dict]) -> Iterator[tuple[int, int, int, int, int]]:
    """anchor_id, positive_id, positive_score, negative_id, score: of each positive's window the best of this block."""
    of: dict[int, list[tuple[int, int]]] = {}
    for p in positives:
        of.setdefault(p["anchor_id"], []).append((p["positive_id"], p["positive_score"]))
    for k, (anchor, label) in enumerate(zip(w.anchor_ids, w.anchor_labels)):
        w.enter(k)
        if k == 0:
            w.score(0, np.arange(len(w.v)))
        windows = [(i, s, *_window(s)) for i, s in of.get(int(anchor), ()) if _window(s)[0] <= _window(s)[1]]
        reached = np.zeros(len(w.v), bool)
        for low, high in {x[2:] for x in windows}:
            reached |= (w.high[k] >= low) & (w.low[k] <= high)
        which = np.flatnonzero(reached & (w.labels != label))
        if not len(which):
            continue
        scores = w.score(k, which)
        for i, s, low, high in windows:
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            for j in inside[_first(scores[inside], w.ids[which[inside]], NEGATIVES)]:
                yield int(anchor), i, s, int(w.ids[which[j]]), int(scores[j])


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """Written blocks or trees with numbers from 0 instead of the task's and the place within it."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy("part").agg(F.count(F.lit(1)).alias("_n")).select("part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    return df.join(F.broadcast(parts), "part").withColumn(name, F.col("_base") + F.col("seq")).drop("part", "seq", "_base")


def _meet(trees: DataFrame, blocks: DataFrame, n_trees: int, n_blocks: int, walk, out: list[tuple[str, pa.DataType]]) -> DataFrame:
    """Rows that walk gives of each tree and each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in (b.slice(i, 1).to_pylist()[0] for i in range(len(b))):
                found = list(walk(Walk(row["tree_cells"], row["block_cells"]), row["tree_cells"]))
                columns = list(zip(*found)) or [[]] * (len(out) - 1)
                arrays = [pa.array([row["tree"]] * len(found), pa.int64()), *(pa.array(c, t) for c, (_, t) in zip(columns, out[1:]))]
                yield pa.RecordBatch.from_arrays(arrays, [n for n, _ in out])

    a = trees.select("tree", F.struct(*(c for c in trees.columns if c != "tree")).alias("tree_cells")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    c = blocks.select("block", F.struct(*(c for c in blocks.columns if c != "block")).alias("block_cells")).withColumn("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_trees - 1).cast("long"))))
    return a.join(c.hint("merge"), ["tree", "block"]).mapInArrow(run, _schema(out))


ID, NUMBER = pa.int64(), pa.int32()


def mine(rows: DataFrame, every: int = 50) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of every anchor: rows whose vec_id every divides.

    rows: vec_id, label, embedding. Those with a null id, label or vector, or with a component that is null, NaN or
    infinite take no part; of rows that repeat an id the least by label and vector does. Vectors of other lengths count
    as filled with zeros, so an empty one scores 0. Equal scores go by the smaller vec_id; a positive without negatives in
    its window gives no rows, nor does an empty table. Scores beyond 64 bits are an OverflowError. Other columns are ignored.
    """
    spark = rows.sparkSession
    vectors = written(valid(rows), "vectors")
    count = vectors.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("vec_id") % every == 0).alias("anchors")).first()
    blocks = written(candidate_blocks(vectors, count["all"]), "blocks")
    trees = written(anchor_trees(vectors.where(F.col("vec_id") % every == 0), count["anchors"]), "trees")
    n_trees, n_blocks = trees.count(), blocks.count()
    if not n_trees:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    blocks, trees = _numbered(blocks, "block"), _numbered(trees, "tree")

    best = _meet(trees, blocks, n_trees, n_blocks, lambda w, _: _positives(w), [("tree", ID), ("anchor_id", ID), ("positive_id", ID), ("positive_score", ID)])
    w = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    positives = written(best.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= POSITIVES).drop("_place"), "positives")
    sought = positives.groupBy("tree").agg(F.collect_list(F.struct("anchor_id", "positive_id", "positive_score")).alias("positives"))
    asked = trees.join(sought.hint("merge"), "tree")

    out = [("tree", ID), ("anchor_id", ID), ("positive_id", ID), ("positive_score", ID), ("negative_id", ID), ("negative_score", ID)]
    found = _meet(asked, blocks, n_trees, n_blocks, lambda w, tree: _negatives(w, tree["positives"]), out)
    w = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= NEGATIVES)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
