"""Period trends (E14-E16, F2), breakpoints.

Raw rows are touched once per operator, by exact sums per period (:mod:`chartwise.operators.moments`) or partial
aggregation; slopes, first/last shifts and jumps then run on the handful of period or bucket rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartwise.functions.columns import fround, right_closed_bin_index
from chartwise.operators.moments import correlation, exact_sums, number


def period_means(df: DataFrame, period: str, features: Sequence[str], label: str = "charted",
                 min_n: int = 50) -> DataFrame:
    """Per period: n (rows), label rate and feature means; periods with n >= min_n."""
    feats = [c for c in features if c in df.columns]
    names = {"1": F.lit(1.0), "y": F.col(label), **{f"x{i}": F.col(c) for i, c in enumerate(feats)}}
    sums = exact_sums(df.filter(F.col(period).isNotNull()), names, [(c,) for c in names], by=[period])
    rows = [(p, s["1",].n, *[number(s[c,].mean) for c in names if c != "1"]) for (p,), s in sorted(sums.items()) if s["1",].n >= min_n]
    shape = T.StructType([T.StructField(period, df.schema[period].dataType), T.StructField("n", T.LongType()),
                          *[T.StructField(c, T.DoubleType()) for c in ["chart_rate", *feats]]])
    return df.sparkSession.createDataFrame(rows, shape).coalesce(1)


def feature_trends(means: DataFrame, period: str, features: Sequence[str], min_points: int = 3) -> DataFrame:
    """Least-squares slope of each feature's period means (per unit of ``period``).

    The means table has one row per period, so the reshaping and the regression
    aggregate run on a few dozen rows.
    """
    feats = [c for c in features if c in means.columns]
    rows = means.select(F.col(period).cast("double"), *[F.col(c).cast("double") for c in feats]).collect()  # one per period
    found = []
    for i, c in enumerate(feats):
        points = [(Fraction(r[0]), Fraction(r[i + 1])) for r in rows if r[0] is not None and r[i + 1] is not None]
        if len(points) < min_points:
            continue
        x, y = sum(p for p, _ in points), sum(q for _, q in points)
        xx, yy, xy = sum(p * p for p, _ in points), sum(q * q for _, q in points), sum(p * q for p, q in points)
        n, vx, vy = len(points), xx - x * x / len(points), yy - y * y / len(points)
        r = correlation(n, x, y, xx, yy, xy)
        slope = float((xy - x * y / n) / vx) if vx else None
        r2 = None if not vx else 1.0 if not vy else float((xy - x * y / n) ** 2 / (vx * vy))
        found.append((c, i, slope, r2, n, r))
    g = means.sparkSession.createDataFrame(found, "feature string, ordinal int, slope double, r2 double, k long, r double").coalesce(1)
    r = F.col("r")
    t = F.when(F.abs(r) < 1.0, r * F.sqrt((F.col("k") - 2.0) / (F.lit(1.0) - r * r)))
    return g.select("feature", "ordinal", fround("slope", 6).alias("slope"), fround("r2", 6).alias("r2"),
                    F.col("k").cast("bigint").alias("n_points"), fround(t, 4).alias("t"),
                    F.when(F.col("slope") > 0, "↑ increasing").otherwise("↓ decreasing").alias("direction"),
                    t.alias("_t"), (F.col("k") - 2.0).alias("_df"))


def conditional_gap(df: DataFrame, period: str, value: str, label: str = "charted", min_n: int = 50) -> DataFrame:
    """Mean of ``value`` among positives minus among negatives, per period (both must exist)."""
    y = F.col(label)
    factors = {"1": F.lit(1.0), "c": F.when(y == 1, F.col(value)), "nc": F.when(y == 0, F.col(value))}
    sums = exact_sums(df.filter(F.col(period).isNotNull()), factors, [(c,) for c in factors], by=[period])
    rows = [(p, s["1",].n, number(s["c",].mean), number(s["nc",].mean)) for (p,), s in sorted(sums.items())
            if s["1",].n >= min_n and s["c",].n and s["nc",].n]
    shape = T.StructType([T.StructField(period, df.schema[period].dataType), T.StructField("n", T.LongType()),
                          T.StructField("c", T.DoubleType()), T.StructField("nc", T.DoubleType())])
    g = df.sparkSession.createDataFrame(rows, shape).coalesce(1)
    return g.select(period, fround("c", 4).alias(f"charted_{value}"), fround("nc", 4).alias(f"noncharted_{value}"),
                    fround(F.col("c") - F.col("nc"), 4).alias("gap"))


def first_last_shift(means: DataFrame, period: str, features: Sequence[str], digits: int = 4) -> DataFrame:
    """feature mean in the last period minus the first (on rounded means, as reported)."""
    feats = [c for c in features if c in means.columns]
    row = means.agg(F.min(period).alias("first_period"), F.max(period).alias("last_period"),
                    *[F.min_by(fround(c, digits), F.col(period)).alias(f"f{i}") for i, c in enumerate(feats)],
                    *[F.max_by(fround(c, digits), F.col(period)).alias(f"l{i}") for i, c in enumerate(feats)])
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"f{i}").alias("first"), F.col(f"l{i}").alias("last"))
                      for i, c in enumerate(feats)])
    long = row.select("first_period", "last_period", F.inline(items))
    return long.select("feature", "first_period", "last_period", "first", "last",
                       fround(F.col("last") - F.col("first"), digits).alias("delta"))


def bucket_rates(df: DataFrame, x, edges: Sequence[float], label: str = "charted", min_n: int = 100) -> DataFrame:
    """E1 over right-closed buckets of ``x`` with bucket bounds and midpoints; n >= min_n."""
    b = df.withColumn("bucket_index", right_closed_bin_index(x, edges)).filter(F.col("bucket_index").isNotNull())
    g = b.groupBy("bucket_index").agg(F.count(label).alias("n"), F.sum(label).alias("positives"))
    g = g.filter(F.col("n") >= min_n)
    lo = F.element_at(F.array(*[F.lit(float(e)) for e in edges[:-1]]), F.col("bucket_index") + 1)
    hi = F.element_at(F.array(*[F.lit(float(e)) for e in edges[1:]]), F.col("bucket_index") + 1)
    return g.select("bucket_index", lo.alias("lo"), hi.alias("hi"), ((lo + hi) / 2.0).alias("mid"),
                    F.col("n").cast("bigint").alias("n"), F.col("positives").cast("bigint").alias("positives"),
                    (F.col("positives") / F.col("n")).alias("rate"))


def largest_jump(buckets: DataFrame) -> DataFrame:
    """The largest rise of rate between consecutive surviving buckets.

    One row: mid of the upper bucket, the jump (NULL when it is exactly 0, as
    reported) and 10**mid rounded.  ``lag`` runs over the <= few dozen bucket rows.
    """
    w = Window.orderBy("mid")
    d = buckets.withColumn("jump", F.col("rate") - F.lag("rate").over(w)).filter(F.col("jump").isNotNull())
    best = d.agg(F.max_by(F.struct("mid", "jump"), F.struct(F.col("jump"), -F.col("mid"))).alias("b"))
    return best.select(F.col("b.mid").alias("breakpoint_log"),
                       fround(F.pow(F.lit(10.0), F.col("b.mid")), 0).cast("bigint").alias("breakpoint_followers"),
                       F.when(F.col("b.jump") != 0, fround(F.col("b.jump"), 4)).alias("breakpoint_jump"))
