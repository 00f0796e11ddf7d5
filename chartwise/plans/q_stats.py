"""Statistical test queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chartwise.functions.columns import fround, weighted_sum
from chartwise.operators.abtest import ab_chain, ab_many, ab_test
from chartwise.operators.moments import exact_sums
from chartwise.operators.quantiles import exact_quantiles
from chartwise.operators.stattests import corr_tests, interaction_gain, quadrant_synergy, welch_profile
from chartwise.plans import views
from chartwise.plans.oracle_views import ab_counts_sql, ab_sql, with_views, t_p_sql
from chartwise.plans.q_rates import COLLAB, FOLLOWER_TIERS, collab_tier_col, follower_tier_col
from chartwise.plans.registry import register

# Fixed values that must equal the reference's: feature lists, thresholds,
# score weights, pairs and group names.
AUDIO_VS_CHART = ["danceability", "energy", "valence", "loudness_norm", "acousticness", "speechiness",
                  "instrumentalness", "liveness", "tempo_norm"]
EMERGING_FEATS = ["danceability", "energy", "valence", "loudness_norm", "acousticness", "duration_min", "tempo_norm"]
PREDICTOR_FEATS = ["danceability", "energy", "valence", "loudness_norm", "acousticness"]
TOP10_FEATS = ["danceability", "energy", "valence", "loudness_norm", "acousticness", "duration_min"]
HIT_WEIGHTS = {"energy": 0.30, "danceability": 0.25, "loudness_norm": 0.25, "acousticness": -0.20}
INTERACTION_PAIRS = [("energy", "danceability"), ("energy", "loudness_norm"), ("danceability", "loudness_norm"),
                     ("danceability", "valence"), ("energy", "valence")]
QUADRANT_TESTS = [("energy", "danceability", 0.7, 0.7), ("energy", "loudness_norm", 0.7, 0.7),
                  ("danceability", "loudness_norm", 0.7, 0.7)]

HIT_SCORE_SQL = ("(0.3::DOUBLE * coalesce(energy, 0.0) + 0.25::DOUBLE * coalesce(danceability, 0.0) "
                 "+ 0.25::DOUBLE * coalesce(loudness_norm, 0.0) + -0.2::DOUBLE * coalesce(acousticness, 0.0))")


def hit_score():
    return weighted_sum(HIT_WEIGHTS)


@register("ab_test", with_views(["facts"], ab_sql(ab_counts_sql(
    "facts", "followers < 10000", "followers >= 1000000", "Low followers (<10K)", "High followers (1M+)", 30))))
def q_ab_test(spark, sf):
    """Low (<10K) vs high (1M+) follower artists: chart-rate A/B test (both groups > 30)."""
    f = views.facts(spark, sf)
    return ab_test(f, F.col("followers") < 10_000, F.col("followers") >= 1_000_000, "charted",
                   "Low followers (<10K)", "High followers (1M+)", min_n=30)


@register("ab_test_pvalue", with_views(["facts"], ab_sql(ab_counts_sql(
    "facts", "followers < 10000", "followers >= 1000000", "Low followers (<10K)", "High followers (1M+)", 30), p=True)))
def q_ab_test_pvalue(spark, sf):
    """The same A/B test with its chi-square p-value (vectorised UDF on the 1-row result)."""
    f = views.facts(spark, sf)
    return ab_test(f, F.col("followers") < 10_000, F.col("followers") >= 1_000_000, "charted",
                   "Low followers (<10K)", "High followers (1M+)", min_n=30, with_p=True)


#: Score levels of the clamped test, where the given tables have rows on both sides (0.65 and 0.30 leave none).
HS_HIGH, HS_LOW = 0.45, 0.2


@register("ab_test_clamped", with_views(["facts"], ab_sql(ab_counts_sql(
    f"(SELECT *, {HIT_SCORE_SQL} AS hs FROM facts)", f"hs >= {HS_HIGH}", f"hs < {HS_LOW}",
    f"Very High Hit Score (≥{HS_HIGH:.2f})", f"Very Low Hit Score (<{HS_LOW:.2f})", 30), clamp=True)))
def q_ab_test_clamped(spark, sf):
    """Very high vs very low composite hit score; every 2x2 cell clamped to >= 1."""
    f = views.facts(spark, sf).withColumn("hs", hit_score())
    return ab_test(f, F.col("hs") >= HS_HIGH, F.col("hs") < HS_LOW, "charted", f"Very High Hit Score (≥{HS_HIGH:.2f})",
                   f"Very Low Hit Score (<{HS_LOW:.2f})", clamp_cells=True, min_n=30)


@register("threshold_ab", with_views(["facts"], ab_sql(ab_counts_sql(
    "facts", "duration_min < 3.5", "duration_min >= 4.5", "Short (<3.5 min)", "Long (>4.5 min)", 30))))
def q_threshold_ab(spark, sf):
    """Short (<3.5 min) vs long (>=4.5 min, labelled '>4.5') tracks; a gap between the groups."""
    f = views.facts(spark, sf)
    return ab_test(f, F.col("duration_min") < 3.5, F.col("duration_min") >= 4.5, "charted",
                   "Short (<3.5 min)", "Long (>4.5 min)", min_n=30)


def _tier_counts_sql(tier_case, pairs, min_n=0):
    values = ", ".join(f"('{a}', '{b}', {k})" for k, (a, b) in enumerate(pairs))
    where = f" WHERE n_a > {min_n} AND n_b > {min_n}" if min_n else ""
    return f"""SELECT * FROM (
  SELECT p.k, p.group_a, p.group_b, coalesce(a.n, 0) AS n_a, coalesce(a.s, 0) AS s_a, coalesce(b.n, 0) AS n_b,
    coalesce(b.s, 0) AS s_b
  FROM (VALUES {values}) p(group_a, group_b, k)
  LEFT JOIN (SELECT {tier_case} AS tier, count(*) AS n, sum(charted) AS s FROM facts GROUP BY 1) a ON a.tier = p.group_a
  LEFT JOIN (SELECT {tier_case} AS tier, count(*) AS n, sum(charted) AS s FROM facts GROUP BY 1) b ON b.tier = p.group_b){where}"""


FOLLOWER_CASE = ("CASE WHEN followers < 100000 THEN '<100K followers' WHEN followers < 1000000 THEN '100K–1M' "
                 "ELSE '1M+ followers' END")
COLLAB_CASE = ("CASE WHEN n_artists = 1 THEN 'Solo (1 artist)' WHEN n_artists = 2 THEN 'Duo (2 artists)' "
               "ELSE 'Group (3+ artists)' END")
COLLAB_PAIRS = [(COLLAB[0], COLLAB[1]), (COLLAB[0], COLLAB[2]), (COLLAB[1], COLLAB[2])]


@register("ab_adjacent", with_views(["facts"], ab_sql(_tier_counts_sql(
    FOLLOWER_CASE, list(zip(FOLLOWER_TIERS[:-1], FOLLOWER_TIERS[1:]))), keep="k AS pair_index,")))
def q_ab_adjacent(spark, sf):
    """A/B tests between consecutive follower tiers."""
    f = views.facts(spark, sf).withColumn("tier", follower_tier_col())
    return ab_chain(f, "tier", "charted", FOLLOWER_TIERS, mode="adjacent")


@register("ab_pairs", with_views(["facts"], ab_sql(_tier_counts_sql(COLLAB_CASE, COLLAB_PAIRS, 30),
                                                  keep="k AS pair_index,")))
def q_ab_pairs(spark, sf):
    """A/B tests between every pair of collaboration tiers with more than 30 tracks each."""
    f = views.facts(spark, sf).withColumn("tier", collab_tier_col())
    return ab_chain(f, "tier", "charted", COLLAB, pairs=COLLAB_PAIRS, min_n=30)


STARS_SQL = "CASE WHEN p_value < 0.001 THEN '★★★' WHEN p_value < 0.01 THEN '★★' WHEN p_value < 0.05 THEN '★' WHEN p_value IS NOT NULL THEN '' END"


def _welch_sql(feats, table, p=False):
    parts = []
    for i, c in enumerate(feats):
        parts.append(
            f"SELECT '{c}' AS feature, {i} AS ordinal, favg({c}) FILTER (WHERE charted = 1) AS m1, "
            f"var_samp({c}) FILTER (WHERE charted = 1) AS v1, CAST(count({c}) FILTER (WHERE charted = 1) AS DOUBLE) AS n1, "
            f"favg({c}) FILTER (WHERE charted = 0) AS m0, var_samp({c}) FILTER (WHERE charted = 0) AS v0, "
            f"CAST(count({c}) FILTER (WHERE charted = 0) AS DOUBLE) AS n0 FROM {table}")
    body = "\nUNION ALL\n".join(parts)
    se = "(v1 / n1 + v0 / n0)"
    dof = f"({se} * {se} / ((v1 / n1) * (v1 / n1) / (n1 - 1.0) + (v0 / n0) * (v0 / n0) / (n0 - 1.0)))"
    if p:
        return (f"SELECT *, p_value < 0.05 AS significant, {STARS_SQL} AS stars FROM (SELECT feature, ordinal, charted_mean, noncharted_mean, diff, t, df, n_charted, n_noncharted, "
                f"round_even({t_p_sql('_t', '_df')}, 8) AS p_value FROM (SELECT *, CASE WHEN _se > 0 THEN _d / sqrt(_se) END AS _t FROM ({_welch_sql(feats, table)}) "
                f"JOIN (SELECT feature AS _f, m1 - m0 AS _d, {se} AS _se, {dof} AS _df FROM ({body})) ON _f = feature))")
    return (f"SELECT feature, ordinal, round_even(m1, 4) AS charted_mean, round_even(m0, 4) AS noncharted_mean, "
            f"round_even(m1 - m0, 4) AS diff, CASE WHEN {se} > 0 THEN round_even((m1 - m0) / sqrt({se}), 4) END AS t, "
            f"CASE WHEN {se} > 0 THEN round_even({se} * {se} / ((v1 / n1) * (v1 / n1) / (n1 - 1.0) + (v0 / n0) * (v0 / n0) / (n0 - 1.0)), 2) END AS df, "
            f"CAST(n1 AS BIGINT) AS n_charted, CAST(n0 AS BIGINT) AS n_noncharted FROM ({body})")


@register("welch_profile", with_views(["facts"], _welch_sql(AUDIO_VS_CHART, "facts")))
def q_welch_profile(spark, sf):
    """Charted vs non-charted means per audio feature with Welch t and df."""
    return welch_profile(views.facts(spark, sf), AUDIO_VS_CHART)


@register("welch_pvalues", with_views(["facts"], _welch_sql(AUDIO_VS_CHART, "facts", p=True)))
def q_welch_pvalues(spark, sf):
    """Welch profile with two-sided p-values, significance and stars."""
    return welch_profile(views.facts(spark, sf), AUDIO_VS_CHART, with_p=True)


@register("emerging_welch", with_views(["facts"], _welch_sql(EMERGING_FEATS, "(SELECT * FROM facts WHERE followers < 100000)")))
def q_emerging_welch(spark, sf):
    """Within artists under 100K followers: what separates charted from non-charted tracks."""
    f = views.facts(spark, sf).filter(F.col("followers") < 100_000)
    return welch_profile(f, EMERGING_FEATS)


def _corr0_sql(feats, target, table, raw=False):
    parts = [f"SELECT '{c}' AS feature, {i} AS ordinal, covar_pop(coalesce({c}, 0.0), CAST({target} AS DOUBLE)) AS cv, "
             f"stddev_pop(coalesce({c}, 0.0)) AS sx, stddev_pop(CAST({target} AS DOUBLE)) AS sy, count(*) AS n FROM {table}"
             for i, c in enumerate(feats)]
    body = "\nUNION ALL\n".join(parts)
    r = "(cv / (sx * sy))"
    return (f"SELECT feature, ordinal, round_even({r}, 4) AS r, {f'{r} AS raw, ' if raw else ''}"
            f"CASE WHEN abs({r}) < 1.0 THEN round_even({r} * sqrt((n - 2.0) / (1.0 - {r} * {r})), 4) END AS t, "
            f"CAST(n AS BIGINT) AS n FROM ({body}) WHERE sx > 0 AND sy > 0")


@register("corr_zero_filled", with_views(["facts"], _corr0_sql(AUDIO_VS_CHART, "popularity_track", "facts")))
def q_corr_zero_filled(spark, sf):
    """Pearson r of each feature (NULL -> 0) with track popularity, with its t statistic."""
    return corr_tests(views.facts(spark, sf), AUDIO_VS_CHART, "popularity_track").filter(F.col("r").isNotNull())


@register("corr_pvalues", with_views(["facts"], f"""SELECT feature, ordinal, r, t, n,
  round_even({t_p_sql("CASE WHEN abs(raw) < 1.0 THEN raw * sqrt((n - 2.0) / (1.0 - raw * raw)) END", "(n - 2.0)")}, 8) AS p_value
FROM ({_corr0_sql(AUDIO_VS_CHART, "popularity_track", "facts", raw=True)})"""))
def q_corr_pvalues(spark, sf):
    """Zero-filled correlations with popularity including two-sided p-values."""
    return corr_tests(views.facts(spark, sf), AUDIO_VS_CHART, "popularity_track", with_p=True)


@register("predictor_rank", with_views(["facts"], f"""
SELECT CASE WHEN feature = 'followers' THEN 'artist_followers' ELSE feature END AS predictor, abs(r) AS abs_r,
  CAST(row_number() OVER (ORDER BY abs(raw) DESC, feature) AS INTEGER) AS rank
FROM ({_corr0_sql(["followers"] + PREDICTOR_FEATS, "charted", "facts", raw=True)})"""))
def q_predictor_rank(spark, sf):
    """Artist followers vs audio features ranked by |r| with the label (NULL -> 0)."""
    r = corr_tests(views.facts(spark, sf), ["followers"] + PREDICTOR_FEATS, "charted", digits=None).filter(F.col("r").isNotNull())
    r = r.select(F.when(F.col("feature") == "followers", "artist_followers").otherwise(F.col("feature")).alias("predictor"),
                 F.abs("r").alias("abs_r"), "feature")
    w = Window.orderBy(F.desc("abs_r"), "feature")  # a handful of aggregated rows
    return r.withColumn("rank", F.row_number().over(w).cast("int")).withColumn("abs_r", fround("abs_r", 4)).drop("feature")


@register("top_decile_compare", with_views(["facts"], "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS feature, round_even(favg({c}) FILTER (WHERE popularity_track >= q), 4) AS top10_mean,
  round_even(favg({c}) FILTER (WHERE charted = 0), 4) AS noncharted_mean,
  round_even(favg({c}) FILTER (WHERE popularity_track >= q) - favg({c}) FILTER (WHERE charted = 0), 4) AS diff
FROM facts, (SELECT quantile_cont(popularity_track, 0.9) AS q FROM facts)""" for c in TOP10_FEATS)))
def q_top_decile_compare(spark, sf):
    """Top-decile popularity (ties included) vs non-charted: mean of each feature."""
    f = views.facts(spark, sf)
    q = exact_quantiles(f, ["popularity_track"], [0.9])[("popularity_track", 0.9)]
    top, bottom = F.col("popularity_track") >= F.lit(q), F.col("charted") == 0
    masked = {(c, side): F.when(rows, F.col(c)) for c in TOP10_FEATS for side, rows in (("t", top), ("b", bottom))}
    sums = exact_sums(f, {f"{side}.{c}": x for (c, side), x in masked.items()}, [(f"{side}.{c}",) for c, side in masked])[()]
    long = spark.createDataFrame([(c, sums[f"t.{c}",].mean, sums[f"b.{c}",].mean) for c in TOP10_FEATS], "feature string, t double, b double")
    return long.select("feature", fround("t", 4).alias("top10_mean"), fround("b", 4).alias("noncharted_mean"),
                       fround(F.col("t") - F.col("b"), 4).alias("diff"))


def _quadrant_sql():
    parts = []
    for j, (a, b, ta, tb) in enumerate(QUADRANT_TESTS):
        hi = f"{a} >= {ta} AND {b} >= {tb}"
        lo = f"{a} <= 1.0::DOUBLE - {ta}::DOUBLE AND {b} <= 1.0::DOUBLE - {tb}::DOUBLE"
        parts.append(
            f"SELECT '{a}' AS feat_a, '{b}' AS feat_b, {j} AS ordinal, count(*) FILTER (WHERE {hi}) AS nh, "
            f"count(*) FILTER (WHERE {lo}) AS nl, avg(charted) FILTER (WHERE {hi}) AS rj, "
            f"avg(charted) FILTER (WHERE {lo}) AS rl, avg(charted) FILTER (WHERE {a} >= {ta}) AS ra, "
            f"avg(charted) FILTER (WHERE {b} >= {tb}) AS rb FROM facts")
    body = "\nUNION ALL\n".join(parts)
    return (f"SELECT feat_a, feat_b, ordinal, CAST(nh AS BIGINT) AS n_joint_high, CAST(nl AS BIGINT) AS n_joint_low, "
            f"round_even(rj, 4) AS joint_rate, round_even(rl, 4) AS joint_low_rate, "
            f"round_even(greatest(ra, rb), 4) AS best_single_rate, round_even(rj - greatest(ra, rb), 4) AS synergy, "
            f"(rj - greatest(ra, rb)) > 0.001 AS positive_synergy FROM ({body}) WHERE nh >= 30 AND nl >= 30")


@register("quadrant_synergy", with_views(["facts"], _quadrant_sql()))
def q_quadrant_synergy(spark, sf):
    """Joint-high vs best single-high chart rate for feature pairs (>= .7 / <= .3 quadrants)."""
    return quadrant_synergy(views.facts(spark, sf), QUADRANT_TESTS)


def _interaction_sql():
    parts = []
    for j, (a, b) in enumerate(INTERACTION_PAIRS):
        def r(x):
            return (f"covar_pop({x}, CAST(charted AS DOUBLE)) / (stddev_pop({x}) * stddev_pop(CAST(charted AS DOUBLE)))")
        parts.append(f"SELECT '{a}' AS feat_a, '{b}' AS feat_b, {j} AS ordinal, {r(f'coalesce({a}, 0.0)')} AS ra, "
                     f"{r(f'coalesce({b}, 0.0)')} AS rb, {r(f'coalesce({a} * {b}, 0.0)')} AS ri FROM facts")
    body = "\nUNION ALL\n".join(parts)
    imp = "(abs(ri) - greatest(abs(ra), abs(rb)))"
    return (f"SELECT feat_a, feat_b, ordinal, round_even(ra, 4) AS r_a, round_even(rb, 4) AS r_b, "
            f"round_even(ri, 4) AS r_interaction, round_even({imp}, 4) AS improvement, {imp} > 0.002 AS synergy "
            f"FROM ({body})")


@register("interaction_gain", with_views(["facts"], _interaction_sql()))
def q_interaction_gain(spark, sf):
    """Does the product of two features correlate with the label better than either alone?"""
    return interaction_gain(views.facts(spark, sf), INTERACTION_PAIRS)


def _quadrant_ab_sql():
    parts = []
    for j, (a, b, ta, tb) in enumerate(QUADRANT_TESTS):
        hi = f"{a} >= {ta} AND {b} >= {tb}"
        lo = f"{a} <= 1.0::DOUBLE - {ta}::DOUBLE AND {b} <= 1.0::DOUBLE - {tb}::DOUBLE"
        parts.append(f"SELECT {j} AS test_index, 'High {a} + High {b}' AS group_a, 'Low {a} + Low {b}' AS group_b, "
                     f"count(*) FILTER (WHERE {hi}) AS n_a, coalesce(sum(charted) FILTER (WHERE {hi}), 0) AS s_a, "
                     f"count(*) FILTER (WHERE {lo}) AS n_b, coalesce(sum(charted) FILTER (WHERE {lo}), 0) AS s_b FROM facts")
    counts = "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE n_a >= 30 AND n_b >= 30"
    return with_views(["facts"], ab_sql(counts, clamp=True, keep="test_index,"))


@register("quadrant_ab", _quadrant_ab_sql())
def q_quadrant_ab(spark, sf):
    """Joint-high vs joint-low quadrant A/B tests (cells clamped to >= 1), all pairs in one pass."""
    tests = [(f"High {a} + High {b}", (F.col(a) >= ta) & (F.col(b) >= tb),
              f"Low {a} + Low {b}", (F.col(a) <= F.lit(1.0) - F.lit(ta)) & (F.col(b) <= F.lit(1.0) - F.lit(tb)))
             for a, b, ta, tb in QUADRANT_TESTS]
    return ab_many(views.facts(spark, sf), tests, "charted", clamp_cells=True, min_n=30)


@register("duration_corr", with_views(["facts"], f"""SELECT feature, ordinal, r, t, n,
  round_even({t_p_sql("CASE WHEN abs(raw) < 1.0 THEN raw * sqrt((n - 2.0) / (1.0 - raw * raw)) END", "(n - 2.0)")}, 8) AS p_value
FROM ({_corr0_sql(["duration_min"], "charted", "facts", raw=True)})"""))
def q_duration_corr(spark, sf):
    """Correlation of duration (NULL -> 0) with the label, with its p-value."""
    return corr_tests(views.facts(spark, sf), ["duration_min"], "charted", with_p=True)


#: Charted tracks that the emerging-artist profile needs more than.
EMERGING_MIN = 10


@register("emerging_flags", with_views(["facts"], f"""SELECT feature, charted_mean, noncharted_mean, diff, significant
FROM ({_welch_sql(EMERGING_FEATS, "(SELECT * FROM facts WHERE followers < 100000)", p=True)})
WHERE (SELECT count(*) FROM facts WHERE followers < 100000 AND charted = 1) > {EMERGING_MIN}"""))
def q_emerging_flags(spark, sf):
    """What separates charted tracks of artists under 100K followers, with flags; only if more than ten charted."""
    f = views.facts(spark, sf).filter(F.col("followers") < 100_000)
    enough = f.agg((F.count(F.when(F.col("charted") == 1, 1)) > EMERGING_MIN).alias("e"))
    flags = welch_profile(f, EMERGING_FEATS, with_p=True).select("feature", "charted_mean", "noncharted_mean", "diff", "significant")
    return flags.filter(F.lit(enough.first()["e"]))
