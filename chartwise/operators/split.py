"""Exact stratified splits and exact-size samples without a window or a join over rows.

Row order inside each class is the deterministic ``uniform(seed, key)`` (then the key), so results are reproducible
and independent of partitioning. The row at a wanted rank is found by refining a histogram of that number, 2^16 bins at
a time, for all classes and cuts at once; what then labels (or samples) the rows is a literal comparison with the found
(number, key), evaluated where the rows are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartwise.functions.columns import uniform

#: Rows around the cuts whose keys are fetched at once; more are told apart by another 2^16 bins first.
KEEP = 100_000

BINS = 1 << 16


def approximate_mode(class_counts: dict, n_draws: int) -> dict:
    """Per-class draw counts: floor of the proportional share, leftovers to the
    largest remainders (ties to the smaller class value)."""
    total = sum(class_counts.values())
    cont = {c: k / total * n_draws for c, k in class_counts.items()}
    fl = {c: int(math.floor(v)) for c, v in cont.items()}
    need = n_draws - sum(fl.values())
    for c in sorted(cont, key=lambda c: (-(cont[c] - fl[c]), c))[:max(need, 0)]:
        fl[c] += 1
    return fl


def stratified_sizes(class_counts: dict, test_size: float = 0.15, val_size: float = 0.15) -> dict:
    """{class: (train, val, test)} following the two-stage train/test, train/val split."""
    n = sum(class_counts.values())
    n_test = int(math.ceil(test_size * n))
    tv = approximate_mode(class_counts, n - n_test)
    n_tv = n - n_test
    n_val = int(math.ceil(val_size / (1.0 - test_size) * n_tv))
    train = approximate_mode(tv, n_tv - n_val)
    return {c: (train[c], tv[c] - train[c], class_counts[c] - tv[c]) for c in class_counts}


def rows_at(df: DataFrame, class_col: str, key: str, ranks: dict, seed: int) -> dict:
    """{class: [(number, key) of the row at each rank, from 0; None beyond the class]}.

    At most 2^16 counts a class and cut, and then KEEP keys (or those of one 32-bit number), come to the driver."""
    number = (uniform(seed, F.col(key)) * float(BINS)) * float(BINS)  # 32 bits, exact
    rows = df.select(F.col(class_col).alias("c"), F.col(key).alias("k"), number.cast("long").alias("u"))
    rows = rows.filter(_any([F.col("c").eqNullSafe(F.lit(c)) for c in ranks]))
    state = {(c, r): (0, r) for c, rs in ranks.items() for r in rs}  # (class, rank) -> (prefix, rank under it)
    for shift in (16, 0):
        tally = rows.select("c", F.shiftright("u", shift).alias("b"))
        if not shift:
            tally = tally.filter(_any([F.col("c").eqNullSafe(F.lit(c)) & (F.shiftright("b", 16) == p) for c, p in {(c, p) for (c, _), (p, _) in state.items()}]))
        bins: dict = {}
        for r in tally.groupBy("c", "b").count().orderBy("c", "b").collect():
            bins.setdefault(r["c"], []).append((r["b"], r["count"]))
        left = {}
        for (c, rank), (prefix, under) in list(state.items()):
            before = 0
            for b, n in bins.get(c, []):
                if shift == 0 and b >> 16 != prefix:
                    continue
                if before + n > under:
                    state[c, rank], left[c, b] = (b, under - before), n
                    break
                before += n
            else:
                del state[c, rank]
        if sum(left.values()) <= KEEP:
            break
    found: dict = {}
    if state:
        near = rows.filter(_any([F.col("c").eqNullSafe(F.lit(c)) & (F.shiftright("u", shift) == b) for c, b in left]))
        for r in near.groupBy("c", "u", "k").count().collect():
            found.setdefault((r["c"], r["u"] >> shift), []).append((r["u"], r["k"] is not None, r["k"], r["count"]))
    out = {}
    for c, rs in ranks.items():
        out[c] = []
        for rank in rs:
            at = None
            if (c, rank) in state:
                prefix, under = state[c, rank]
                for u, known, k, n in sorted(found[c, prefix], key=lambda x: (x[0], x[1], x[2] if x[1] else 0)):
                    under -= n
                    if under < 0:
                        at = (u / float(1 << 32), k)
                        break
            out[c].append(at)
    return out


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def before(u: Column, key: Column, at: tuple | None) -> Column:
    """Whether a row precedes the one ``at`` (None: every row does)."""
    if at is None:
        return F.lit(True)
    number, k = at
    smaller = F.coalesce(key < F.lit(k), F.lit(True)) if k is not None else F.lit(False)  # a null key comes first
    return (u < F.lit(number)) | ((u == F.lit(number)) & smaller)


def assign_by_rank(df: DataFrame, class_col: str, key: str, cuts: dict, labels: Sequence[str], seed: int = 42, out: str = "split") -> DataFrame:
    """Label each row by its exact rank within its class.

    ``cuts[c]`` = ascending cumulative boundaries for class c; rank < cuts[c][0]
    gets labels[0], rank < cuts[c][1] labels[1], ..., the rest labels[-1]. Rows of other classes are left out.
    Sizes are exact where keys are unique; rows that share a key get one label.
    """
    found = rows_at(df, class_col, key, cuts, seed)
    u, k = F.col("_u"), F.col(key)
    label = F.lit(None).cast("string")
    for c, ats in found.items():
        own = F.lit(labels[-1])
        for name, at in list(zip(labels, ats))[::-1]:
            own = F.when(before(u, k, at), F.lit(name)).otherwise(own)
        label = F.when(F.col(class_col).eqNullSafe(F.lit(c)), own).otherwise(label)
    return df.withColumn("_u", uniform(seed, F.col(key))).withColumn(out, label).drop("_u").filter(F.col(out).isNotNull())


def stratified_split(df: DataFrame, key: str, label: str, test_size: float = 0.15, val_size: float = 0.15,
                     seed: int = 42) -> DataFrame:
    """exact-size stratified train/val/test labels in a ``split`` column. A count per class comes to the driver."""
    rows = df.groupBy(label).count().collect()
    counts = {r[label]: r["count"] for r in rows}
    sizes = stratified_sizes(counts, test_size, val_size)
    cuts = {c: [tr, tr + va] for c, (tr, va, te) in sizes.items()}
    return assign_by_rank(df, label, key, cuts, ["train", "val", "test"], seed)


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows, without replacement, the first n by uniform(seed, key): one literal filter."""
    if n <= 0:
        return df.limit(0)
    at = rows_at(df.withColumn("_one", F.lit(1)), "_one", key, {1: [n]}, seed)[1][0]
    return df if at is None else df.filter(before(uniform(seed, F.col(key)), F.col(key), at))


def sample_per_class(df: DataFrame, label: str, key: str, sizes: dict, seed: int = 42) -> DataFrame:
    """The first ``sizes[c]`` rows of each class c by uniform(seed, key); classes that aren't named are left out."""
    found = rows_at(df, label, key, {c: [n] for c, n in sizes.items()}, seed)
    u, k = uniform(seed, F.col(key)), F.col(key)
    return df.filter(_any([F.col(label).eqNullSafe(F.lit(c)) & before(u, k, ats[0]) for c, ats in found.items() if sizes[c] > 0]))
