"""The analysis reports as one document each (A6, A7, H6): all eight analyses, and the advanced ones.

A section is the result of a registered analysis, named by its place in the document; its records are written as JSON,
read back, and returned as typed numbers, which SQL takes from the analyses' own SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chartwise.operators.reports import report_numbers
from chartwise.plans import views
from chartwise.plans.registry import ORACLES, QUERIES, register
from chartwise.session import scratch_dir
from chartwise.sources.files import read_report, write_report

AB = ["n_a", "n_b", "chart_rate_a", "chart_rate_b", "ci_a_lo", "ci_a_hi", "ci_b_lo", "ci_b_hi", "chi2", "cohen_h", "lift"]
SIDES = ["group_a", "group_b"]

#: Section -> (analysis, columns that name a record, its numbers).
ANALYSIS = {
    "audio_vs_chart.features": ("welch_pvalues", ["feature"], ["charted_mean", "noncharted_mean", "diff", "t", "df", "n_charted", "n_noncharted", "p_value"]),
    "audio_vs_chart.correlations": ("corr_pvalues", ["feature"], ["r", "t", "n", "p_value"]),
    "hit_song_profile.clusters": ("cluster_profile", ["cluster"], ["n", "chart_rate", "avg_popularity"]),
    "hit_song_profile.top10_vs_noncharted": ("top_decile_compare", ["feature"], ["top10_mean", "noncharted_mean", "diff"]),
    "marketing_vs_music.predictors": ("predictor_rank", ["predictor"], ["abs_r", "rank"]),
    "marketing_vs_music.tiers": ("follower_tiers", ["tier"], ["n", "charted", "chart_rate", "avg_followers"]),
    "marketing_vs_music.ab_test": ("ab_test", SIDES, AB),
    "emerging_artists.ab_tests": ("ab_adjacent", SIDES, AB),
    "emerging_artists.feature_diffs": ("emerging_flags", ["feature"], ["charted_mean", "noncharted_mean", "diff"]),
    "collaborations.tiers": ("collab_tiers", ["tier"], ["n", "charted", "chart_rate"]),
    "collaborations.ab_tests": ("ab_pairs", SIDES, AB),
    "duration.buckets": ("duration_buckets", ["bucket"], ["n", "chart_rate"]),
    "duration.correlation": ("duration_corr", ["feature"], ["r", "t", "n", "p_value"]),
    "duration.ab_test": ("threshold_ab", SIDES, AB),
    "release_timing": ("release_timing", ["dimension", "name"], ["ordinal", "n", "chart_rate"]),
    "genre_analysis": ("genre_rank", ["genre"], ["n", "charted", "avg_pop", "chart_rate"]),
}
ADVANCED = {
    "follower_threshold.buckets": ("follower_buckets", ["label"], ["log_mid", "followers_approx", "n", "charted", "chart_rate"]),
    "follower_threshold.breakpoint": ("breakpoint", SIDES, ["breakpoint_log", "breakpoint_followers", "breakpoint_jump", *AB]),
    "follower_threshold.logistic": ("logit_single", [], ["coef", "intercept", "auc"]),
    "time_trends.decades": ("decade_trend", ["decade"], ["n", "chart_rate", "danceability", "energy", "valence", "acousticness"]),
    "time_trends.feature_trends": ("feature_trend_pvalues", ["feature"], ["slope", "r2", "n_points", "t", "p_value"]),
    "time_trends.energy_gap": ("energy_gap", ["release_year"], ["charted_energy", "noncharted_energy", "gap"]),
    "time_trends.shift": ("first_last_shift", ["feature"], ["first", "last", "delta"]),
    "feature_interactions.pairs": ("interaction_gain", ["feat_a", "feat_b"], ["r_a", "r_b", "r_interaction", "improvement"]),
    "feature_interactions.quadrants": ("quadrant_synergy", ["feat_a", "feat_b"], ["n_joint_high", "n_joint_low", "joint_rate", "joint_low_rate", "best_single_rate", "synergy"]),
    "feature_interactions.quadrant_tests": ("quadrant_ab", SIDES, AB),
    "hit_score.tiers": ("hit_score_tiers", ["tier"], ["n", "charted", "chart_rate"]),
    "hit_score.correlation": ("hit_score_corr", [], ["correlation", "best_individual_r"]),
}


def _sql(layout: dict) -> str:
    parts = []
    for section, (name, ids, numbers) in layout.items():
        own = " || ' / ' || ".join(f'CAST("{c}" AS VARCHAR)' for c in ids) or "'all'"
        pairs = ", ".join(f"{{'metric': '{n}', 'number': CAST(\"{n}\" AS DOUBLE)}}" for n in numbers)
        parts.append(f"SELECT '{section}' AS section, id, m.metric AS metric, m.number AS number FROM (SELECT {own} AS id, unnest([{pairs}]) AS m FROM ({ORACLES[name]}))")
    return "SELECT * FROM (" + "\nUNION ALL\n".join(parts) + ") WHERE number IS NOT NULL"


def _report(spark, sf, layout: dict, name: str):
    for view in (views.tracks(spark, sf), views.artists(spark, sf), views.facts(spark, sf)):
        views.keep(view)  # every section reads them
    sections = {}
    for section, (query, ids, numbers) in layout.items():
        own = F.concat_ws(" / ", *[F.col(c).cast("string") for c in ids]) if ids else F.lit("all")
        sections[section] = QUERIES[query](spark, sf).select(own.alias("id"), *[F.col(n).cast("double").alias(n) for n in numbers])
    path = scratch_dir(spark, name)
    write_report(sections, path)
    return report_numbers(read_report(spark, path), {s: ("id", numbers) for s, (_, _, numbers) in layout.items()})


@register("analysis_report", _sql(ANALYSIS))
def q_analysis_report(spark, sf):
    """The eight analyses as one JSON document, written and read back."""
    return _report(spark, sf, ANALYSIS, "analysis")


@register("advanced_report", _sql(ADVANCED))
def q_advanced_report(spark, sf):
    """Follower threshold, time trends, interactions and hit score as one JSON document, written and read back."""
    return _report(spark, sf, ADVANCED, "advanced")
