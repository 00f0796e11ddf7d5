"""Trend, breakpoint and score queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartwise.functions.columns import fround
from chartwise.functions.stats import t_pvalue
from chartwise.operators.abtest import ab_test
from chartwise.operators.scoring import LINEAR_WEIGHTS, linear_score, score_tiers, top_contributions
from chartwise.operators.stattests import corr_tests
from chartwise.operators.trends import (bucket_rates, conditional_gap, feature_trends, first_last_shift,
                                        largest_jump, period_means)
from chartwise.plans import views
from chartwise.plans.oracle_views import ab_sql, t_p_sql, with_views
from chartwise.plans.q_rates import LOG_EDGES
from chartwise.plans.q_stats import HIT_SCORE_SQL, hit_score
from chartwise.plans.registry import ORACLES, register

# Fixed values that must equal the reference's: trend features, decade range,
# hit-score bucket edges and labels.
TREND_FEATURES = ["danceability", "energy", "valence", "loudness_norm", "acousticness", "duration_min",
                  "tempo_norm", "speechiness", "instrumentalness"]
SHIFT_FEATURES = ["energy", "acousticness", "loudness_norm", "duration_min", "danceability"]
DECADE_RANGE = (1920, 2020)
HIT_EDGES = [-9, 0.3, 0.45, 0.55, 0.65, 9]
HIT_LABELS = ["Very Low", "Low", "Medium", "High", "Very High"]


def _means_sql(period_expr, where, min_n=50):
    feats = ", ".join(f"favg({c}) AS {c}" for c in TREND_FEATURES)
    return (f"SELECT {period_expr} AS period, count(*) AS n, avg(charted) AS chart_rate, {feats} "
            f"FROM facts WHERE {where} GROUP BY 1 HAVING count(*) >= {min_n}")


def _decades(spark, sf):
    f = views.facts(spark, sf).withColumn("decade", (F.floor(F.col("release_year") / 10) * 10).cast("int"))
    return f.filter(F.col("decade").between(*DECADE_RANGE))


@register("decade_trend", with_views(["facts"], f"""
SELECT CAST(period AS INTEGER) AS decade, CAST(n AS BIGINT) AS n, round_even(chart_rate, 4) AS chart_rate,
  {", ".join(f"round_even({c}, 4) AS {c}" for c in TREND_FEATURES)}
FROM ({_means_sql("CAST(release_year // 10 * 10 AS INTEGER)",
                  "release_year IS NOT NULL AND release_year // 10 * 10 BETWEEN 1920 AND 2020")})"""))
def q_decade_trend(spark, sf):
    """Per decade (1920-2020, n >= 50): chart rate and feature means."""
    m = period_means(_decades(spark, sf), "decade", TREND_FEATURES)
    return m.select("decade", "n", fround("chart_rate", 4).alias("chart_rate"),
                    *[fround(c, 4).alias(c) for c in TREND_FEATURES])


def _year_means(spark, sf):
    return period_means(views.facts(spark, sf), "release_year", TREND_FEATURES)


def _trend_sql(p=False):
    parts = [f"SELECT '{c}' AS feature, {i} AS ordinal, regr_slope({c}, CAST(period AS DOUBLE)) AS slope, "
             f"regr_r2({c}, CAST(period AS DOUBLE)) AS r2, count({c}) AS k, "
             f"covar_pop({c}, CAST(period AS DOUBLE)) / (stddev_pop({c}) * stddev_pop(CAST(period AS DOUBLE))) AS r "
             f"FROM m" for i, c in enumerate(TREND_FEATURES)]
    return (f"SELECT feature, ordinal, round_even(slope, 6) AS slope, round_even(r2, 6) AS r2, "
            f"CAST(k AS BIGINT) AS n_points, CASE WHEN abs(r) < 1.0 THEN round_even(r * sqrt((k - 2.0) / (1.0 - r * r)), 4) END AS t, "
            f"CASE WHEN slope > 0 THEN '↑ increasing' ELSE '↓ decreasing' END AS direction "
            + (f", round_even({t_p_sql('CASE WHEN abs(r) < 1.0 THEN r * sqrt((k - 2.0) / (1.0 - r * r)) END', '(k - 2.0)')}, 6) AS p_value, p_value < 0.05 AS significant " if p else "")
            + f"FROM ({' UNION ALL '.join(parts)}) WHERE k >= 3")


@register("feature_trend", with_views(["facts"], _trend_sql(),
                                      extra_ctes=f"m AS ({_means_sql('release_year', 'release_year IS NOT NULL')})"))
def q_feature_trend(spark, sf):
    """Least-squares slope per year of each feature's yearly mean (years with n >= 50, >= 3 points)."""
    return feature_trends(_year_means(spark, sf), "release_year", TREND_FEATURES).drop("_t", "_df")


@register("feature_trend_pvalues", with_views(["facts"], _trend_sql(p=True),
                                              extra_ctes=f"m AS ({_means_sql('release_year', 'release_year IS NOT NULL')})"))
def q_feature_trend_pvalues(spark, sf):
    """Feature trends with the regression p-value, significance and stars."""
    t = feature_trends(_year_means(spark, sf), "release_year", TREND_FEATURES)
    p = fround(t_pvalue(F.col("_t"), F.col("_df")), 6)
    return t.withColumn("p_value", p).withColumn("significant", F.col("p_value") < 0.05).drop("_t", "_df")


@register("energy_gap", with_views(["facts"], """
SELECT release_year, round_even(c, 4) AS charted_energy, round_even(nc, 4) AS noncharted_energy,
  round_even(c - nc, 4) AS gap
FROM (SELECT release_year, count(*) AS n, favg(energy) FILTER (WHERE charted = 1) AS c,
      favg(energy) FILTER (WHERE charted = 0) AS nc FROM facts WHERE release_year IS NOT NULL GROUP BY release_year)
WHERE n >= 50 AND c IS NOT NULL AND nc IS NOT NULL"""))
def q_energy_gap(spark, sf):
    """Per year: energy of charted minus non-charted tracks (both groups present, n >= 50)."""
    return conditional_gap(views.facts(spark, sf), "release_year", "energy")


@register("first_last_shift", with_views(["facts"], f"""
SELECT feature, CAST(fp AS INTEGER) AS first_period, CAST(lp AS INTEGER) AS last_period, "first", "last",
  round_even("last" - "first", 4) AS delta FROM (
  {" UNION ALL ".join(f"SELECT '{c}' AS feature, min(period) AS fp, max(period) AS lp, round_even(arg_min({c}, period), 4) AS \"first\", round_even(arg_max({c}, period), 4) AS \"last\" FROM m" for c in SHIFT_FEATURES)})""",
    extra_ctes=f"m AS ({_means_sql('release_year', 'release_year IS NOT NULL')})"))
def q_first_last_shift(spark, sf):
    """Change of each feature's (rounded) yearly mean from the first to the last year."""
    return first_last_shift(_year_means(spark, sf), "release_year", SHIFT_FEATURES)


BP_BUCKETS_SQL = """
b AS (SELECT bucket_index, bucket_index * 0.5::DOUBLE + 0.25::DOUBLE AS mid, sum(charted) / count(*) AS rate
      FROM (SELECT charted, CAST(ceil(log10(greatest(followers, 1.0)) / 0.5) AS INTEGER) - 1 AS bucket_index
            FROM facts WHERE followers > 0 AND log10(greatest(followers, 1.0)) > 0 AND log10(greatest(followers, 1.0)) <= 8)
      GROUP BY bucket_index HAVING count(*) >= 100),
j AS (SELECT mid, rate - lag(rate) OVER (ORDER BY mid) AS jump FROM b),
bp AS (SELECT mid, jump FROM j WHERE jump IS NOT NULL ORDER BY jump DESC, mid ASC LIMIT 1),
thr AS (SELECT mid AS breakpoint_log, CAST(round_even(pow(10, mid), 0) AS BIGINT) AS breakpoint_followers,
        CASE WHEN jump <> 0 THEN round_even(jump, 4) END AS breakpoint_jump FROM bp)"""


@register("breakpoint", with_views(["facts"], f"""
SELECT thr.breakpoint_log, thr.breakpoint_followers, thr.breakpoint_jump, ab.* FROM thr, ({ab_sql(
    "SELECT 'Above threshold (≥' || format('{:,}', max(thr.breakpoint_followers)) || ' followers)' AS group_a, "
    "'Below threshold (<' || format('{:,}', max(thr.breakpoint_followers)) || ' followers)' AS group_b, "
    "count(*) FILTER (WHERE followers >= thr.breakpoint_followers) AS n_a, "
    "coalesce(sum(charted) FILTER (WHERE followers >= thr.breakpoint_followers), 0) AS s_a, "
    "count(*) FILTER (WHERE followers < thr.breakpoint_followers) AS n_b, "
    "coalesce(sum(charted) FILTER (WHERE followers < thr.breakpoint_followers), 0) AS s_b FROM facts, thr",
    clamp=True)}) ab""", extra_ctes=BP_BUCKETS_SQL.strip()))
def q_breakpoint(spark, sf):
    """Follower level where the chart rate jumps most between consecutive log buckets, and the A/B test there."""
    f = views.facts(spark, sf)
    fp = f.filter(F.col("followers") > 0)
    b = bucket_rates(fp, F.log10(F.greatest("followers", F.lit(1.0))), LOG_EDGES, min_n=100)
    bp = largest_jump(b).first()
    found = bp is not None and bp["breakpoint_followers"] is not None
    thr = int(bp["breakpoint_followers"]) if found else 0
    ab = ab_test(f, F.col("followers") >= thr, F.col("followers") < thr, "charted",
                 f"Above threshold (≥{thr:,} followers)", f"Below threshold (<{thr:,} followers)", clamp_cells=True)
    out = ab.select(F.lit(bp["breakpoint_log"] if found else None).cast("double").alias("breakpoint_log"), F.lit(thr).cast("bigint").alias("breakpoint_followers"),
                    F.lit(bp["breakpoint_jump"] if found else None).cast("double").alias("breakpoint_jump"), "*")
    return out if found else out.limit(0)


def _hit_case():
    parts = [f"WHEN hs > {lo} AND hs <= {hi} THEN {i}" for i, (lo, hi) in enumerate(zip(HIT_EDGES[:-1], HIT_EDGES[1:]))]
    return "CASE " + " ".join(parts) + " END"


@register("hit_score_tiers", with_views(["facts"], f"""
SELECT (['Very Low','Low','Medium','High','Very High'])[o + 1] AS tier, o AS ordinal, CAST(count(charted) AS BIGINT) AS n,
  CAST(sum(charted) AS BIGINT) AS charted, round_even(sum(charted) / count(charted), 4) AS chart_rate
FROM (SELECT charted, {_hit_case()} AS o FROM (SELECT charted, {HIT_SCORE_SQL} AS hs FROM facts)) WHERE o IS NOT NULL
GROUP BY o"""))
def q_hit_score_tiers(spark, sf):
    """Composite hit score (NULLs as 0) in five right-closed tiers with chart rates."""
    f = views.facts(spark, sf).withColumn("hit_score", hit_score())
    return score_tiers(f, "hit_score", HIT_EDGES, HIT_LABELS)


@register("hit_score_corr", with_views(["facts"], f"""
SELECT round_even(rs, 4) AS correlation, round_even(best, 4) AS best_individual_r, abs(rs) > best AS beats_best_individual
FROM (SELECT covar_pop(hs, y) / (stddev_pop(hs) * stddev_pop(y)) AS rs,
  greatest(abs(covar_pop(coalesce(energy, 0.0), y) / (stddev_pop(coalesce(energy, 0.0)) * stddev_pop(y))),
           abs(covar_pop(coalesce(danceability, 0.0), y) / (stddev_pop(coalesce(danceability, 0.0)) * stddev_pop(y))),
           abs(covar_pop(coalesce(loudness_norm, 0.0), y) / (stddev_pop(coalesce(loudness_norm, 0.0)) * stddev_pop(y))),
           abs(covar_pop(coalesce(acousticness, 0.0), y) / (stddev_pop(coalesce(acousticness, 0.0)) * stddev_pop(y)))) AS best
  FROM (SELECT *, {HIT_SCORE_SQL} AS hs, CAST(charted AS DOUBLE) AS y FROM facts))"""))
def q_hit_score_corr(spark, sf):
    """Correlation of the hit score with the label vs the best single input feature."""
    f = views.facts(spark, sf).withColumn("hit_score", hit_score())
    r = corr_tests(f, ["hit_score", "energy", "danceability", "loudness_norm", "acousticness"], "charted", digits=12)
    row = r.agg(F.max(F.when(F.col("feature") == "hit_score", F.col("r"))).alias("rs"),
                F.max(F.when(F.col("feature") != "hit_score", F.abs("r"))).alias("best"))
    return row.select(fround("rs", 4).alias("correlation"), fround("best", 4).alias("best_individual_r"),
                      (F.abs("rs") > F.col("best")).alias("beats_best_individual"))


LIN_SQL = " + ".join(f"{w!r}::DOUBLE * coalesce({f}, 0.0)" for f, w in LINEAR_WEIGHTS.items())


@register("linear_score_tiers", with_views(["facts"], f"""
SELECT track_id, round_even(s, 6) AS score, round_even(s * 100.0, 1) AS pct,
  CASE WHEN s >= 0.5 THEN 'Likely to chart!' WHEN s >= 0.2 THEN 'Possible' ELSE 'Below threshold' END AS tier
FROM (SELECT track_id, greatest(0.02, least(0.96, 0.15::DOUBLE + {LIN_SQL})) AS s FROM facts)"""))
def q_linear_score_tiers(spark, sf):
    """Clamped linear chart score per track with its percentage and 3-way tier."""
    s = linear_score(views.facts(spark, sf))
    return s.select("track_id", fround("score", 6).alias("score"), "pct", "tier")


@register("row_contributions", with_views(["facts"], f"""
SELECT track_id, CAST(rn AS INTEGER) AS rank, feature, c AS contribution,
  CASE WHEN mx > 0 THEN abs(c) / mx * 100.0 END AS share_pct
FROM (SELECT track_id, feature, c, row_number() OVER (PARTITION BY track_id ORDER BY abs(c) DESC, o) AS rn,
        max(abs(c)) OVER (PARTITION BY track_id) AS mx
      FROM (SELECT track_id, unnest([{", ".join(f"'{f}'" for f in LINEAR_WEIGHTS)}]) AS feature,
                   unnest([{", ".join(f"{w!r}::DOUBLE * coalesce({f}, 0.0)" for f, w in LINEAR_WEIGHTS.items())}]) AS c,
                   unnest(range({len(LINEAR_WEIGHTS)})) AS o FROM facts))
WHERE rn <= 6"""))
def q_row_contributions(spark, sf):
    """Per track: the six largest weighted feature terms and their share of the largest."""
    return top_contributions(views.facts(spark, sf), "track_id")


@register("best_decade", f"SELECT decade, n, chart_rate FROM ({ORACLES['decade_trend']}) ORDER BY chart_rate DESC, decade LIMIT 1")
def q_best_decade(spark, sf):
    """The decade with the highest chart rate (the earliest on ties)."""
    return q_decade_trend(spark, sf).select("decade", "n", "chart_rate").orderBy(F.desc("chart_rate"), "decade").limit(1)
