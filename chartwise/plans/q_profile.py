"""Data-quality profile queries (E2-E8, K14) on the validating loader's frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartwise.operators.profile import (AUDIO_FEATURES, EXPECTED_RANGES, category_breakdown,
                                         class_balance, corr_table, describe, duplicate_count,
                                         null_profile, quality_issues, range_profile)
from chartwise.plans import views
from chartwise.plans.oracle_views import with_views
from chartwise.operators.reports import VALIDATION, report_numbers, validation_sections
from chartwise.plans.registry import ORACLES, register
from chartwise.session import scratch_dir
from chartwise.sources.files import read_report, write_report
from chartwise.sources.tables import read_table

PROFILE_COLS = ["track_id", "track_name", "popularity", "duration_ms", "explicit", "artist_ids", "release_date",
                "danceability", "energy", "key", "loudness", "mode", "speechiness", "acousticness",
                "instrumentalness", "liveness", "valence", "tempo", "time_signature", "genre", "charted",
                "loudness_norm", "tempo_norm", "duration_min", "energy_dance", "loud_energy", "markets_count",
                "release_year", "release_month", "release_dow"]


def _null_sql():
    parts = [f"SELECT '{c}' AS \"column\", {i} AS ordinal, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS count, "
             f"round_even(count(*) FILTER (WHERE {c} IS NULL) / count(*) * 100, 2) AS pct FROM tracks"
             for i, c in enumerate(PROFILE_COLS)]
    return "SELECT * FROM (\n" + "\nUNION ALL\n".join(parts) + "\n) WHERE count > 0"


def _range_sql():
    parts = []
    for c, (lo, hi) in EXPECTED_RANGES.items():
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS BIGINT) AS out_of_range, "
            f"round_even(count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) / count(*) * 100, 2) AS pct, "
            f"CAST({float(lo)} AS DOUBLE) AS expected_lo, CAST({float(hi)} AS DOUBLE) AS expected_hi, "
            f"round_even(CAST(min({c}) AS DOUBLE), 4) AS actual_min, round_even(CAST(max({c}) AS DOUBLE), 4) AS actual_max FROM tracks")
    return "SELECT * FROM (\n" + "\nUNION ALL\n".join(parts) + "\n) WHERE out_of_range > 0"


def _describe_sql():
    parts = [f"SELECT '{c}' AS feature, round_even(favg({c}), 4) AS mean, round_even(stddev_samp({c}), 4) AS std, "
             f"round_even(CAST(min({c}) AS DOUBLE), 4) AS min, round_even(quantile_cont({c}, 0.25), 4) AS q25, "
             f"round_even(quantile_cont({c}, 0.5), 4) AS median, round_even(quantile_cont({c}, 0.75), 4) AS q75, "
             f"round_even(CAST(max({c}) AS DOUBLE), 4) AS max FROM tracks" for c in AUDIO_FEATURES]
    return "\nUNION ALL\n".join(parts)


def _corr_sql(cols, target, table, zero=False):
    parts = []
    for i, c in enumerate(cols):
        if zero:
            x, filt = f"coalesce(CAST({c} AS DOUBLE), 0.0)", ""
        else:
            x, filt = f"CAST({c} AS DOUBLE)", f" FILTER (WHERE {c} IS NOT NULL AND {target} IS NOT NULL)"
        y = f"CAST({target} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS feature, {i} AS ordinal, covar_pop({x}, {y}){filt} AS cov, stddev_pop({x}){filt} AS sx, "
            f"stddev_pop({y}){filt} AS sy, CAST(count({x}){filt} AS BIGINT) AS n FROM {table}")
    body = "\nUNION ALL\n".join(parts)
    return (f"SELECT feature, ordinal, round_even(cov / (sx * sy), 4) AS r, n FROM ({body}) "
            f"WHERE sx > 0 AND sy > 0")


def _profile_frame(spark, sf):
    return views.tracks(spark, sf, round_to=True)


@register("null_profile", with_views(["tracks"], _null_sql()))
def q_null_profile(spark, sf):
    """Missing count and % per column, only columns with missing values."""
    return null_profile(_profile_frame(spark, sf), PROFILE_COLS)


@register("range_profile", with_views(["tracks"], _range_sql()))
def q_range_profile(spark, sf):
    """Values outside the expected ranges: count, % of rows, actual min/max."""
    return range_profile(_profile_frame(spark, sf))


@register("duplicate_count", """
SELECT 'lineitem' AS dataset, CAST(sum(c - 1) AS BIGINT) AS duplicates
FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)
UNION ALL
SELECT 'orders', CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM orders GROUP BY o_orderkey)""")
def q_duplicate_count(spark, sf):
    """Rows beyond the first per key: lineitem (no primary key) and orders."""
    li = duplicate_count(read_table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber"]),
                         ["l_orderkey", "l_linenumber"]).select(F.lit("lineitem").alias("dataset"), "duplicates")
    o = duplicate_count(read_table(spark, sf, "orders", ["o_orderkey"]), ["o_orderkey"]) \
        .select(F.lit("orders").alias("dataset"), "duplicates")
    return li.unionByName(o)


@register("feature_stats", with_views(["tracks"], _describe_sql()))
def q_feature_stats(spark, sf):
    """Describe: mean, sample std, min, exact linear quartiles, max (4 dp)."""
    return describe(_profile_frame(spark, sf), AUDIO_FEATURES)


@register("class_balance", with_views(["tracks"], """
SELECT CAST(count(*) FILTER (WHERE charted = 1) AS BIGINT) AS charted_count,
  round_even(count(*) FILTER (WHERE charted = 1) / count(*) * 100, 2) AS charted_pct,
  CAST(count(*) FILTER (WHERE charted = 0) AS BIGINT) AS non_charted_count,
  round_even(count(*) FILTER (WHERE charted = 0) / count(*) * 100, 2) AS non_charted_pct,
  round_even(CAST(CASE WHEN count(*) FILTER (WHERE charted = 0) > 0 THEN count(*) FILTER (WHERE charted = 0) ELSE 1 END AS DOUBLE)
    / greatest(CASE WHEN count(*) FILTER (WHERE charted = 1) > 0 THEN count(*) FILTER (WHERE charted = 1) ELSE 1 END, 1), 2) AS imbalance_ratio
FROM tracks"""))
def q_class_balance(spark, sf):
    """Class counts, percentages and imbalance ratio."""
    return class_balance(_profile_frame(spark, sf))


@register("genre_breakdown", with_views(["tracks"], """
SELECT genre, CAST(count(track_id) AS BIGINT) AS count, round_even(avg(charted), 4) AS charted_rate,
  round_even(avg(popularity), 4) AS avg_popularity FROM tracks GROUP BY genre"""))
def q_genre_breakdown(spark, sf):
    """Per genre: track count, chart rate, mean popularity."""
    return category_breakdown(_profile_frame(spark, sf))


@register("corr_with_label", with_views(["tracks"], _corr_sql(AUDIO_FEATURES, "charted", "tracks")))
def q_corr_with_label(spark, sf):
    """Pairwise-complete Pearson r of each audio feature with the label, by |r|."""
    r = corr_table(_profile_frame(spark, sf), AUDIO_FEATURES, "charted")
    return r.orderBy(F.abs("r").desc(), "feature")


@register("quality_issues", with_views(["tracks"], """
SELECT * FROM (
  SELECT 'duplicates' AS kind, 'track_id' AS subject, CAST(d AS DOUBLE) AS value, CAST(d AS VARCHAR) || ' rows repeat a key' AS message
  FROM (SELECT count(*) - count(DISTINCT track_id) AS d FROM tracks) WHERE d > 0
  UNION ALL
  SELECT 'missing', "column", pct, "column" || ' lacks a value in ' || CAST(pct AS VARCHAR) || ' % of the rows' FROM nulls WHERE pct > 5
  UNION ALL
  SELECT 'out_of_range', "column", pct, "column" || ' leaves its range in ' || CAST(pct AS VARCHAR) || ' % of the rows' FROM ranges WHERE pct > 1
  UNION ALL
  SELECT 'imbalance', 'charted', ratio, printf('%.1f', ratio) || ' negatives for each positive; oversampling may help'
  FROM (SELECT round_even(CAST(count(*) FILTER (WHERE charted = 0) AS DOUBLE) / greatest(count(*) FILTER (WHERE charted = 1), 1), 2) AS ratio FROM tracks)
  WHERE ratio > 10)""", extra_ctes=f"nulls AS ({_null_sql()}),\nranges AS ({_range_sql()})"))
def q_quality_issues(spark, sf):
    """Failed quality rules (duplicates, missingness > 5 %, out of range > 1 %, imbalance > 10)."""
    t = views.keep(_profile_frame(spark, sf))  # four passes
    return quality_issues(null_profile(t, PROFILE_COLS), range_profile(t), duplicate_count(t, ["track_id"]),
                          class_balance(t))


#: Columns of the prepared tracks, which the report's overview counts.
N_COLUMNS = 30


def _report_sql():
    issues = "SELECT subject, value FROM (" + ORACLES["quality_issues"] + ")"
    bodies = {
        "dataset_overview": with_views(["tracks"], f"SELECT count(*) AS total_tracks, {N_COLUMNS} AS total_columns FROM tracks"),
        "missing_values": ORACLES["null_profile"], "out_of_range": ORACLES["range_profile"],
        "duplicates": with_views(["tracks"], "SELECT count(*) - count(DISTINCT track_id) AS duplicates FROM tracks"),
        "class_balance": ORACLES["class_balance"], "genre_breakdown": ORACLES["genre_breakdown"], "feature_statistics": ORACLES["feature_stats"],
        "correlation_with_chart": ORACLES["corr_with_label"], "quality_issues": issues,
        "quality_pass": f"SELECT CAST(count(*) = 0 AS INTEGER) AS passed FROM ({issues})",
    }
    parts = [f"SELECT '{section}' AS section, {f'CAST({chr(34)}{name}{chr(34)} AS VARCHAR)' if name else chr(39) + 'all' + chr(39)} AS id, '{n}' AS metric, CAST(\"{n}\" AS DOUBLE) AS number FROM ({bodies[section]})"
             for section, (name, numbers) in VALIDATION.items() for n in numbers]
    return "SELECT * FROM (" + "\nUNION ALL\n".join(parts) + ") WHERE number IS NOT NULL"


@register("report_json", _report_sql())
def q_report_json(spark, sf):
    """Write the whole validation report (ten sections, one JSON document) and read its numbers back."""
    path = scratch_dir(spark, "report")
    write_report(validation_sections(views.keep(_profile_frame(spark, sf)), PROFILE_COLS, AUDIO_FEATURES), path)
    return report_numbers(read_report(spark, path))
