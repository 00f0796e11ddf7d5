"""Fits that are a few aggregates each: single-feature logistic regression (K8) and k-means restarts (K4)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwise.functions.columns import uniform
from chartwise.operators.learn import cluster_profile

#: Newton steps of the logistic fit (it converges quadratically), and the step under which it stops.
STEPS, SMALL = 25, 1e-12

#: k-means: parts of one that positions are rounded to, so that sums are integers and don't depend on the order of rows;
#: rows of the sample for each restart's starting centres; rounds at most; squared movement of its centres, for features
#: of variance 1, under which a restart rests.
GRID, STARTS, MOST, REST = 1 << 30, 2000, 300, 1e-4


def logistic_newton(df: DataFrame, x: str, label: str, penalty: float = 1.0) -> tuple[float, float]:
    """K8: (coefficient, intercept) of a logistic regression on one feature, L2 penalty on the coefficient alone.

    Rows are folded to one per distinct value (map-side combined) and landed; each Newton step is one aggregate that
    gives gradient and Hessian together. With one class only, or no rows, both are 0 and the log-odds' bound.
    """
    folded = (df.filter(F.col(x).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(x).cast("double").alias("x"))
              .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(label).cast("double")).alias("p")).checkpoint())
    n, p = folded.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("p"), F.lit(0.0))).first()
    if not 0 < p < n:
        return 0.0, 0.0 if not n else 30.0 if p else -30.0
    w, b = 0.0, math.log(p / (n - p))
    for _ in range(STEPS):
        prob = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("x") * F.lit(w) + F.lit(b))))
        miss, flat = F.col("n") * prob - F.col("p"), F.col("n") * prob * (F.lit(1.0) - prob)
        g0, g1, h00, h01, h11 = folded.agg(F.sum(miss), F.sum(miss * F.col("x")), F.sum(flat), F.sum(flat * F.col("x")), F.sum(flat * F.col("x") * F.col("x"))).first()
        g1, h11 = g1 + penalty * w, h11 + penalty
        det = h00 * h11 - h01 * h01
        db, dw = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        w, b = w - dw, b - db
        if abs(dw) + abs(db) < SMALL:
            break
    return w, b


def starting_centres(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ over a bounded sample."""
    centres = [sample[rng.integers(len(sample))]]
    while len(centres) < k:
        gap = np.min([((sample - c) ** 2).sum(axis=1) for c in centres], axis=0)
        total = gap.sum()
        centres.append(sample[rng.choice(len(sample), p=gap / total)] if total > 0 else sample[rng.integers(len(sample))])
    return np.array(centres)


def blocks(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The columns on the grid as binary blocks of some thousand rows, a column after the other: what each pass reads."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                whole = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype("i8")
                yield pa.RecordBatch.from_pydict({"points": pa.array([whole.tobytes()], pa.binary())})

    return rows.select(*cols).mapInArrow(pack, "points binary")


def assign_pass(rows: DataFrame, cols: Sequence[str], centres: np.ndarray) -> dict[tuple[int, int], tuple[int, np.ndarray, float]]:
    """{(restart, cluster): (rows, sums on the grid, cost)}: one pass assigns every row to a centre of each restart.

    ``rows`` holds the columns on the grid, or their :func:`blocks`."""
    if rows.columns != ["points"]:
        rows = blocks(rows, cols)
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    dims = len(cols)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = shared.value
        restarts, k, _ = every.shape
        n, sums, cost = np.zeros((restarts, k), "i8"), np.zeros((restarts, k, dims), "i8"), np.zeros((restarts, k))
        for block in (b.as_buffer() for batch in batches for b in batch.column(0)):
            whole = np.frombuffer(block, "i8").reshape(dims, -1)
            points, size = whole / GRID, whole.shape[1]
            # sums of whole numbers under 2^53 are exact as doubles, in any order
            exact = float(np.abs(whole).max()) * size < 2.0 ** 53
            floats = whole.astype("f8") if exact else None
            for r in range(restarts):
                apart = sum((points[j][None, :] - every[r, :, j][:, None]) ** 2 for j in range(dims))
                own = apart.argmin(axis=0)
                n[r] += np.bincount(own, minlength=k)
                cost[r] += np.bincount(own, weights=apart[own, np.arange(size)], minlength=k)
                if exact:
                    sums[r] += ((own == np.arange(k)[:, None]).astype("f8") @ floats.T).astype("i8")
                else:
                    for c in range(k):
                        sums[r, c] += whole[:, own == c].sum(axis=1)
        at = np.argwhere(n > 0)
        yield pa.RecordBatch.from_pydict({
            "r": pa.array(at[:, 0], pa.int32()), "c": pa.array(at[:, 1], pa.int32()), "n": pa.array(n[at[:, 0], at[:, 1]], pa.int64()),
            "cost": pa.array(cost[at[:, 0], at[:, 1]], pa.float64()), **{f"s{j}": pa.array(sums[at[:, 0], at[:, 1], j], pa.int64()) for j in range(dims)}})

    shape = "r int, c int, n long, cost double, " + ", ".join(f"s{j} long" for j in range(dims))
    total = rows.mapInArrow(add, shape).groupBy("r", "c").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), *[F.sum(F.col(f"s{j}").cast("decimal(38,0)")).alias(f"s{j}") for j in range(dims)])
    return {(row["r"], row["c"]): (row["n"], np.array([float(row[f"s{j}"]) for j in range(dims)]) / GRID, row["cost"]) for row in total.collect()}


def lloyd(rows: DataFrame, cols: Sequence[str], centres: np.ndarray, rounds: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """(centres, cost of each restart) after at most ``rounds`` rounds; ``rows`` holds the columns on the grid.

    All restarts share each pass: one assignment to restarts x k centres and one aggregate of that many rows. A centre
    without rows stays where it is; restarts that rest drop out of the next pass. The rows are packed once for all passes.
    """
    rows = blocks(rows, cols).checkpoint()
    centres = centres.copy()
    cost = np.zeros(len(centres))
    moving = np.arange(len(centres))
    for _ in range(rounds):
        found = assign_pass(rows, cols, centres[moving])
        old = centres[moving].copy()
        cost[moving] = 0.0
        for (r, c), (n, sums, spent) in found.items():
            centres[moving[r], c] = sums / n
            cost[moving[r]] += spent
        moving = moving[((centres[moving] - old) ** 2).sum(axis=(1, 2)) > REST]
        if not len(moving):
            break
    return centres, cost


def on_grid(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.rint(F.col(c) * F.lit(float(GRID))).cast("long") for c in cols})


def kmeans(df: DataFrame, key: str, cols: Sequence[str], k: int, restarts: int = 10, seed: int = 42) -> tuple[np.ndarray, float]:
    """K4: (centres, cost) of the best of ``restarts`` fits; starts are k-means++ over STARTS rows by hash each."""
    rows = on_grid(df.select(key, *cols), cols).checkpoint()
    n = rows.count()
    if not n:
        return np.zeros((0, len(cols))), 0.0
    share = min(1.0, 1.5 * STARTS / n)
    some = rows.filter(uniform(seed, F.col(key)) < share).orderBy(uniform(seed, F.col(key)), key).limit(STARTS).select(*cols).toPandas().to_numpy(dtype=float) / GRID
    if not len(some):
        some = rows.select(*cols).limit(k).toPandas().to_numpy(dtype=float) / GRID
    starts = np.stack([starting_centres(some, k, np.random.default_rng(seed + r)) for r in range(restarts)])
    centres, cost = lloyd(rows, cols, starts)
    best = int(np.lexsort((np.arange(restarts), cost))[0])
    return centres[best], float(cost[best])


def profile_by_size(df: DataFrame, cluster: str, features: Sequence[str]) -> DataFrame:
    """The cluster profile with clusters numbered from the largest (ties: the lower old number)."""
    sizes = [r[0] for r in df.groupBy(cluster).count().orderBy(F.desc("count"), cluster).collect()]  # k rows
    place = F.coalesce(*[F.when(F.col(cluster) == old, F.lit(new)) for new, old in enumerate(sizes)]) if sizes else F.lit(0)
    return cluster_profile(df.withColumn(cluster, place), cluster, features)
