"""Linear scores, tiers and per-row contributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwise.functions.columns import fround, weighted_sum

# Fixed values that must equal the reference's: interactive-score weights,
# intercept, clamp and tier cut-offs.
LINEAR_WEIGHTS = {"energy": 0.30, "danceability": 0.25, "loudness_norm": 0.25, "valence": 0.05,
                  "acousticness": -0.20, "speechiness": -0.05, "instrumentalness": -0.08, "liveness": -0.03}
LINEAR_INTERCEPT = 0.15
LINEAR_CLAMP = (0.02, 0.96)
TIER_CUTS = ((0.5, "Likely to chart!"), (0.2, "Possible"))
TIER_ELSE = "Below threshold"


def linear_score(df: DataFrame, weights: dict = LINEAR_WEIGHTS, intercept: float = LINEAR_INTERCEPT,
                 clamp: tuple[float, float] = LINEAR_CLAMP, out: str = "score") -> DataFrame:
    """clamp(intercept + sum(w * x)) with absent values as 0, plus a 3-way tier and a 1-dp percentage."""
    s = F.lit(float(intercept)) + weighted_sum(weights)
    s = F.greatest(F.lit(clamp[0]), F.least(F.lit(clamp[1]), s))
    tier = F.when(F.col(out) >= TIER_CUTS[0][0], TIER_CUTS[0][1]).when(F.col(out) >= TIER_CUTS[1][0], TIER_CUTS[1][1]) \
        .otherwise(TIER_ELSE)
    return df.withColumn(out, s).withColumn("pct", fround(F.col(out) * 100.0, 1)).withColumn("tier", tier)


def top_contributions(df: DataFrame, key: str, weights: dict = LINEAR_WEIGHTS, top: int = 6) -> DataFrame:
    """Per row, the ``top`` largest |w * x| terms (ties keep weight order) and each
    term's share of the largest, in %.  Emits at most ``top`` rows per input row."""
    terms = F.array(*[F.struct(F.abs(F.lit(float(w)) * F.coalesce(F.col(f), F.lit(0.0))).alias("a"),
                               F.lit(-i).alias("o"), F.lit(f).alias("feature"),
                               (F.lit(float(w)) * F.coalesce(F.col(f), F.lit(0.0))).alias("contribution"))
                      for i, (f, w) in enumerate(weights.items())])
    t = df.select(key, F.sort_array(terms, asc=False).alias("terms"))
    t = t.select(key, F.col("terms")[0]["a"].alias("_max"), F.posexplode(F.slice("terms", 1, top)).alias("pos", "t"))
    return t.select(key, (F.col("pos") + 1).alias("rank"), F.col("t.feature").alias("feature"),
                    F.col("t.contribution").alias("contribution"),
                    F.when(F.col("_max") > 0, F.col("t.a") / F.col("_max") * 100.0).alias("share_pct"))


def score_tiers(df: DataFrame, score: str, edges: Sequence[float], labels: Sequence[str],
                label: str = "charted") -> DataFrame:
    """E22 buckets: right-closed bins of a score with n, positives and rate (4 dp)."""
    from chartwise.functions.columns import right_closed_bin_index
    b = df.withColumn("ordinal", right_closed_bin_index(score, edges)).filter(F.col("ordinal").isNotNull())
    g = b.groupBy("ordinal").agg(F.count(label).cast("bigint").alias("n"), F.sum(label).cast("bigint").alias("charted"))
    names = F.array(*[F.lit(x) for x in labels])
    return g.select(F.element_at(names, F.col("ordinal") + 1).alias("tier"), "ordinal", "n", "charted",
                    fround(F.col("charted") / F.col("n"), 4).alias("chart_rate"))
