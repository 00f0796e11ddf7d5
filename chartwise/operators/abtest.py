"""Two-proportion A/B tests (E12), chains of them over tiers (E13) and the
threshold A/B (C2).

Group counts come from ONE conditional aggregate over the input (or one
``groupBy(tier)``); the statistics are closed-form columns on the resulting
handful of rows.  ``with_p`` adds the chi-square p-value through a vectorised
UDF on those rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartwise.functions.columns import fround
from chartwise.functions.stats import (CHI2_CRIT_05, chi2_2x2, chi2_pvalue, cohen_h, effect_label,
                                       lift, wilson_bounds, winner)


def ab_from_counts(counts: DataFrame, clamp_cells: bool = False, with_p: bool = False,
                   keep: Sequence[str] = ()) -> DataFrame:
    """Columns group_a, group_b, n_a, s_a, n_b, s_b -> the A/B result row(s)."""
    na, sa, nb, sb = (F.col(c).cast("double") for c in ("n_a", "s_a", "n_b", "s_b"))
    ra = F.when(na > 0, sa / na).otherwise(F.lit(0.0))
    rb = F.when(nb > 0, sb / nb).otherwise(F.lit(0.0))
    chi2 = chi2_2x2("s_a", "n_a", "s_b", "n_b", clamp_cells)
    a_lo, a_hi = wilson_bounds("s_a", "n_a")
    b_lo, b_hi = wilson_bounds("s_b", "n_b")
    h = cohen_h(ra, rb)
    out = counts.select(
        *keep, "group_a", "group_b", F.col("n_a").cast("bigint").alias("n_a"), F.col("n_b").cast("bigint").alias("n_b"),
        fround(ra, 4).alias("chart_rate_a"), fround(rb, 4).alias("chart_rate_b"),
        a_lo.alias("ci_a_lo"), a_hi.alias("ci_a_hi"), b_lo.alias("ci_b_lo"), b_hi.alias("ci_b_hi"),
        fround(chi2, 6).alias("chi2"), F.coalesce(chi2 > CHI2_CRIT_05, F.lit(False)).alias("significant"),
        h.alias("cohen_h"), effect_label(h).alias("effect_size"),
        winner(ra, rb, F.col("group_a"), F.col("group_b")).alias("winner"), lift(ra, rb).alias("lift"),
        *([chi2.alias("_chi2")] if with_p else []))
    if with_p:
        out = out.withColumn("p_value", fround(chi2_pvalue(F.col("_chi2")), 6)).drop("_chi2")
    return out


def ab_test(df: DataFrame, pred_a: Column, pred_b: Column, label: str, name_a: str, name_b: str,
            clamp_cells: bool = False, min_n: int = 0, with_p: bool = False) -> DataFrame:
    """A/B test of ``label`` between two row predicates (groups may overlap or leave gaps)."""
    y = F.col(label)
    counts = df.agg(F.count(F.when(pred_a, 1)).alias("n_a"), F.coalesce(F.sum(F.when(pred_a, y)), F.lit(0)).alias("s_a"),
                    F.count(F.when(pred_b, 1)).alias("n_b"), F.coalesce(F.sum(F.when(pred_b, y)), F.lit(0)).alias("s_b"))
    counts = counts.select(F.lit(name_a).alias("group_a"), F.lit(name_b).alias("group_b"), "*")
    if min_n:
        counts = counts.filter((F.col("n_a") > min_n) & (F.col("n_b") > min_n))
    return ab_from_counts(counts, clamp_cells, with_p)


def ab_chain(df: DataFrame, tier_col: str, label: str, tiers: Sequence[str], mode: str = "adjacent",
             pairs: Sequence[tuple[str, str]] | None = None, min_n: int = 0, clamp_cells: bool = False,
             with_p: bool = False) -> DataFrame:
    """A/B tests between tiers: consecutive tiers (``adjacent``), every ordered
    pair i < j (``pairs``) or an explicit list of pairs.

    Tier counts are one ``groupBy``; the pair list is a parameter table of at
    most len(tiers)^2 rows joined twice on the tier name (equi-joins).
    """
    if pairs is None:
        if mode == "adjacent":
            pairs = list(zip(tiers[:-1], tiers[1:]))
        else:
            pairs = [(tiers[i], tiers[j]) for i in range(len(tiers)) for j in range(i + 1, len(tiers))]
    spark = df.sparkSession
    plist = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(pairs)], "group_a string, group_b string, k int")
    per = df.groupBy(F.col(tier_col).alias("tier")).agg(F.count(F.lit(1)).alias("n"),
                                                         F.coalesce(F.sum(label), F.lit(0)).alias("s"))
    a = per.select(F.col("tier").alias("group_a"), F.col("n").alias("n_a"), F.col("s").alias("s_a"))
    b = per.select(F.col("tier").alias("group_b"), F.col("n").alias("n_b"), F.col("s").alias("s_b"))
    counts = plist.join(a, "group_a", "left").join(b, "group_b", "left").na.fill(0, ["n_a", "s_a", "n_b", "s_b"])
    if min_n:
        counts = counts.filter((F.col("n_a") > min_n) & (F.col("n_b") > min_n))
    return ab_from_counts(counts, clamp_cells, with_p, keep=["k"]).withColumnRenamed("k", "pair_index")


def ab_many(df: DataFrame, tests: Sequence[tuple[str, Column, str, Column]], label: str, clamp_cells: bool = False,
            min_n: int = 0, with_p: bool = False) -> DataFrame:
    """Several A/B tests (name_a, pred_a, name_b, pred_b) from ONE conditional aggregate pass."""
    y = F.col(label)
    aggs = []
    for i, (_, pa, _, pb) in enumerate(tests):
        aggs += [F.count(F.when(pa, 1)).alias(f"na{i}"), F.coalesce(F.sum(F.when(pa, y)), F.lit(0)).alias(f"sa{i}"),
                 F.count(F.when(pb, 1)).alias(f"nb{i}"), F.coalesce(F.sum(F.when(pb, y)), F.lit(0)).alias(f"sb{i}")]
    row = df.agg(*aggs)
    items = F.array(*[F.struct(F.lit(i).alias("test_index"), F.lit(na).alias("group_a"), F.lit(nb).alias("group_b"),
                               F.col(f"na{i}").alias("n_a"), F.col(f"sa{i}").alias("s_a"),
                               F.col(f"nb{i}").alias("n_b"), F.col(f"sb{i}").alias("s_b"))
                      for i, (na, _, nb, _) in enumerate(tests)])
    counts = row.select(F.inline(items))
    if min_n:
        counts = counts.filter((F.col("n_a") >= min_n) & (F.col("n_b") >= min_n))
    return ab_from_counts(counts, clamp_cells, with_p, keep=["test_index"])
