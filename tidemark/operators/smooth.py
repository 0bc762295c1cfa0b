"""Episode curves by a penalized cubic basis: an episode's equations are grouped sums, and many small systems are solved at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models import frame_model

LAST = 28
#: Functions of the basis, weight of their second differences, and of their sizes.
BASIS, PENALTY, RIDGE = 6, 1e-3, 1e-8


def basis(x: np.ndarray, n: int = BASIS, last: float = LAST, degree: int = 3) -> np.ndarray:
    """Values at x of n B-splines over [0, last], whose first and last knots are repeated; by their recursion over degrees."""
    inner = np.linspace(0, last, n - degree + 1)
    knots = np.concatenate([np.zeros(degree), inner, np.full(degree, last)])
    x = np.asarray(x, float)[:, None]
    left, right = knots[:-1], knots[1:]
    b = ((x >= left) & (x < right) | (x == last) & (left < last) & (right == last)).astype(float)
    for d in range(1, degree + 1):
        low, high = knots[d:-1] - knots[: -d - 1], knots[d + 1 :] - knots[1:-d]
        up = np.where(low > 0, (x - knots[: -d - 1]) / np.where(low > 0, low, 1), 0)
        down = np.where(high > 0, (knots[d + 1 :] - x) / np.where(high > 0, high, 1), 0)
        b = up * b[:, :-1] + down * b[:, 1:]
    return b


GRID = basis(np.arange(LAST + 1))
_DIFFERENCE = np.diff(np.eye(BASIS), n=2, axis=0)
ADDED = PENALTY * _DIFFERENCE.T @ _DIFFERENCE + RIDGE * np.eye(BASIS)
_PAIRS = [(i, j) for i in range(BASIS) for j in range(i, BASIS)]


def solved(gram: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Curves on the grid from sums of products (episodes x pairs) and of products with values (episodes x functions)."""
    system = np.zeros((len(gram), BASIS, BASIS))
    for k, (i, j) in enumerate(_PAIRS):
        system[:, i, j] = system[:, j, i] = gram[:, k]
    return np.linalg.solve(system + ADDED, cross[:, :, None])[:, :, 0] @ GRID.T


def curves(knots: DataFrame) -> DataFrame:
    """geo_value, reference_date, lag, remaining: the target less the smoothed path at every lag. knots: lag, y, the target at LAST.

    Where a system cannot be solved the path is the line through the knots.
    """
    table = knots.sparkSession.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(GRID)], "lag int, b array<double>")
    rows = knots.select("geo_value", "reference_date", "lag", "y").join(F.broadcast(table), "lag")
    b = [F.col("b")[i] for i in range(BASIS)]
    sums = rows.groupBy("geo_value", "reference_date").agg(
        F.array(*(F.sum(b[i] * b[j]) for i, j in _PAIRS)).alias("gram"), F.array(*(F.sum(v * F.col("y")) for v in b)).alias("cross"),
        F.max(F.when(F.col("lag") == LAST, F.col("y"))).alias("target"), F.sort_array(F.collect_list(F.struct("lag", "y"))).alias("k"),
    ).where("target IS NOT NULL AND size(k) >= 2").select("geo_value", "reference_date", "gram", "cross", "target", F.col("k.lag").alias("lags"), F.col("k.y").alias("ys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(b)
            gram, cross = (b[c].flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("gram", "cross"))
            try:
                fitted = solved(gram, cross)
            except np.linalg.LinAlgError:
                fitted = np.stack([np.interp(np.arange(LAST + 1), x, y) for x, y in zip(b["lags"].to_pylist(), b["ys"].to_pylist())])
            remaining = b["target"].to_numpy()[:, None] - fitted
            ends = pa.array(np.arange(n + 1) * (LAST + 1), pa.int32())
            yield pa.RecordBatch.from_arrays([b["geo_value"], b["reference_date"], pa.ListArray.from_arrays(ends, pa.array(remaining.ravel()))], ["geo_value", "reference_date", "remaining"])

    made = sums.mapInArrow(run, "geo_value string, reference_date date, remaining array<double>")
    return made.select("geo_value", "reference_date", F.posexplode("remaining").alias("lag", "remaining"))


# in place of episode_curves: run(..., given={"episode_curves": run(..., "episode_curves_bspline")})
frame_model("episode_curves_bspline", ("knots",), curves)
