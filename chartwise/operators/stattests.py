"""Group comparisons beyond 2x2 tables: Welch t-tests per feature (E10/E11),
correlation tests (E9/E21), feature interactions (E18/E19).

All are single passes. Means, variances and correlations come from exact sums (:mod:`chartwise.operators.moments`), so
they don't depend on the order of the rows; what follows works on one row per feature, never on raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwise.functions.columns import fround
from chartwise.functions.stats import r_to_t, t_pvalue, welch_t
from chartwise.operators.moments import correlation, exact_sums, number, variance


def _num(c):
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def welch_profile(df: DataFrame, features: Sequence[str], label: str = "charted", with_p: bool = False) -> DataFrame:
    """Per feature: means of the two label groups, difference, Welch t and df."""
    feats = [c for c in features if c in df.columns]
    spark = df.sparkSession
    rows = df.filter(F.col(label).isin(0, 1))
    sums = exact_sums(rows, {c: _num(c) for c in feats}, [t for c in feats for t in ((c,), (c, c))], by=[label])
    of = {int(y): terms for (y,), terms in sums.items()}

    def side(y: int, c: str) -> tuple:
        if y not in of:
            return None, None, 0.0
        one, two = of[y][c,], of[y][c, c]
        return number(one.mean), number(variance(one.n, one.total, two.total, 1)), float(one.n)
    long = spark.createDataFrame([(c, i, *side(1, c), *side(0, c)) for i, c in enumerate(feats)],
                                 "feature string, ordinal int, m1 double, v1 double, n1 double, m0 double, v0 double, n0 double").coalesce(1)
    t, dof = welch_t("m1", "v1", "n1", "m0", "v0", "n0")
    out = long.select("feature", "ordinal", fround("m1", 4).alias("charted_mean"),
                      fround("m0", 4).alias("noncharted_mean"), fround(F.col("m1") - F.col("m0"), 4).alias("diff"),
                      fround(t, 4).alias("t"), fround(dof, 2).alias("df"),
                      F.col("n1").cast("bigint").alias("n_charted"), F.col("n0").cast("bigint").alias("n_noncharted"),
                      *([t.alias("_t"), dof.alias("_df")] if with_p else []))
    if with_p:
        p = t_pvalue(F.col("_t"), F.col("_df"))
        from chartwise.functions.stats import stars
        out = out.withColumn("p_value", fround(p, 8)).withColumn("significant", F.col("p_value") < 0.05) \
                 .withColumn("stars", stars(F.col("p_value"))).drop("_t", "_df")
    return out


def correlations(df: DataFrame, columns: dict, target: str) -> tuple[dict[str, tuple[float | None, int]], int]:
    """({name: (Pearson r with ``target`` over the rows that have both, how many they are)}, all rows), in one pass."""
    y = F.col(target).cast("double")
    factors = {"1": F.lit(1.0)}
    for i, x in enumerate(columns.values()):
        factors |= {f"x{i}": F.when(y.isNotNull(), x), f"y{i}": F.when(x.isNotNull(), y)}
    terms = [("1",)] + [t for i in range(len(columns)) for t in ((f"x{i}",), (f"y{i}",), (f"x{i}", f"x{i}"), (f"y{i}", f"y{i}"), (f"x{i}", f"y{i}"))]
    s = exact_sums(df, factors, terms)[()]
    found = {}
    for i, c in enumerate(columns):
        x, y_of, n = f"x{i}", f"y{i}", s[f"x{i}", f"y{i}"].n
        found[c] = correlation(n, s[x,].total, s[y_of,].total, s[x, x].total, s[y_of, y_of].total, s[x, y_of].total), n
    return found, s["1",].n


def corr_tests(df: DataFrame, features: Sequence[str], target: str, with_p: bool = False,
               digits: int | None = 4) -> DataFrame:
    """Pearson r with NULL features as 0 (point-biserial when target is 0/1), t with n - 2 df. ``digits`` None: unrounded r."""
    feats = [c for c in features if c in df.columns]
    found, n = correlations(df, {c: F.coalesce(_num(c), F.lit(0.0)) for c in feats}, target)
    long = df.sparkSession.createDataFrame([(n, c, i, found[c][0]) for i, c in enumerate(feats)], "_n long, feature string, ordinal int, r double").coalesce(1)
    t = r_to_t(F.col("r"), F.col("_n"))
    shown = F.col("r") if digits is None else fround("r", digits)
    out = long.select("feature", "ordinal", shown.alias("r"), fround(t, 4).alias("t"),
                      F.col("_n").cast("bigint").alias("n"),
                      *([t.alias("_t"), (F.col("_n") - 2.0).alias("_df")] if with_p else []))
    if with_p:
        out = out.withColumn("p_value", fround(t_pvalue(F.col("_t"), F.col("_df")), 8)).drop("_t", "_df")
    return out


def interaction_gain(df: DataFrame, pairs: Sequence[tuple[str, str]], label: str = "charted",
                     eps: float = 0.002) -> DataFrame:
    """|r(a*b)| - max(|r(a)|, |r(b)|) with zero-filled columns; synergy if > eps."""
    exprs = {}
    for a, b in pairs:
        exprs[a] = F.coalesce(_num(a), F.lit(0.0))
        exprs[b] = F.coalesce(_num(b), F.lit(0.0))
        exprs[f"{a}*{b}"] = F.coalesce(_num(a) * _num(b), F.lit(0.0))
    r = {c: found[0] for c, found in correlations(df, exprs, label)[0].items()}
    long = df.sparkSession.createDataFrame([(a, b, j, r[a], r[b], r[f"{a}*{b}"]) for j, (a, b) in enumerate(pairs)],
                                           "feat_a string, feat_b string, ordinal int, ra double, rb double, ri double").coalesce(1)
    imp = F.abs("ri") - F.greatest(F.abs("ra"), F.abs("rb"))
    return long.select("feat_a", "feat_b", "ordinal", fround("ra", 4).alias("r_a"), fround("rb", 4).alias("r_b"),
                       fround("ri", 4).alias("r_interaction"), fround(imp, 4).alias("improvement"),
                       (imp > eps).alias("synergy"))


def quadrant_synergy(df: DataFrame, tests: Sequence[tuple[str, str, float, float]], label: str = "charted",
                     eps: float = 0.001, min_n: int = 30) -> DataFrame:
    """Joint-high rate minus the best single-high rate, per feature pair.

    Joint low uses ``x <= 1 - t`` evaluated in double (1 - 0.7 is 0.30000000000000004).
    Pairs whose joint-high or joint-low group has fewer than ``min_n`` rows are skipped.
    """
    y = F.col(label)
    aggs = []
    for j, (a, b, ta, tb) in enumerate(tests):
        hi = (F.col(a) >= ta) & (F.col(b) >= tb)
        lo = (F.col(a) <= F.lit(1.0) - F.lit(ta)) & (F.col(b) <= F.lit(1.0) - F.lit(tb))
        aggs += [F.count(F.when(hi, 1)).alias(f"nh{j}"), F.avg(F.when(hi, y)).alias(f"rh{j}"),
                 F.count(F.when(lo, 1)).alias(f"nl{j}"), F.avg(F.when(lo, y)).alias(f"rl{j}"),
                 F.avg(F.when(F.col(a) >= ta, y)).alias(f"ra{j}"), F.avg(F.when(F.col(b) >= tb, y)).alias(f"rb{j}")]
    row = df.agg(*aggs)
    items = F.array(*[F.struct(F.lit(a).alias("feat_a"), F.lit(b).alias("feat_b"), F.lit(j).alias("ordinal"),
                               F.col(f"nh{j}").alias("n_joint_high"), F.col(f"nl{j}").alias("n_joint_low"),
                               F.col(f"rh{j}").alias("rj"), F.col(f"rl{j}").alias("rl"),
                               F.col(f"ra{j}").alias("ra"), F.col(f"rb{j}").alias("rb"))
                      for j, (a, b, _, _) in enumerate(tests)])
    long = row.select(F.inline(items)).filter((F.col("n_joint_high") >= min_n) & (F.col("n_joint_low") >= min_n))
    best = F.greatest("ra", "rb")
    syn = F.col("rj") - best
    return long.select("feat_a", "feat_b", "ordinal", F.col("n_joint_high").cast("bigint").alias("n_joint_high"),
                       F.col("n_joint_low").cast("bigint").alias("n_joint_low"),
                       fround("rj", 4).alias("joint_rate"), fround("rl", 4).alias("joint_low_rate"),
                       fround(best, 4).alias("best_single_rate"), fround(syn, 4).alias("synergy"),
                       (syn > eps).alias("positive_synergy"))
