"""Projection queries: tidy/derive."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartwise.functions.columns import ordinal_name
from chartwise.operators.prepare import drop_present, feature_columns, prepare_tracks, reindex
from chartwise.plans import views
from chartwise.plans.oracle_views import with_views
from chartwise.plans.registry import register
from chartwise.sources.tables import artists_raw, tracks_raw

# Fixed values that must equal the reference's: month and weekday names.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
DAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


@register("prepare_tracks", with_views(["tracks_raw"], """
SELECT id AS track_id,
  CASE WHEN popularity >= 70 THEN 1 ELSE 0 END AS charted,
  CASE WHEN loudness IS NULL THEN NULL ELSE round_even(greatest(0.0, least(1.0, (loudness + 60.0) / 60.0)), 4) END AS loudness_norm,
  CASE WHEN tempo IS NULL THEN NULL ELSE round_even(greatest(0.0, least(1.0, (tempo - 40.0) / 180.0)), 4) END AS tempo_norm,
  round_even(duration_ms / 60000.0::DOUBLE, 2) AS duration_min,
  round_even(energy * danceability, 4) AS energy_dance,
  round_even(round_even(greatest(0.0, least(1.0, (loudness + 60.0) / 60.0)), 4) * energy, 4) AS loud_energy,
  0 AS markets_count, genre
FROM tracks_raw"""))
def q_prepare_tracks(spark, sf):
    """Loader derivations with the validating loader's rounding (4 dp norms, 2 dp minutes)."""
    t = prepare_tracks(tracks_raw(spark, sf), round_to=True, with_dates=False)
    return t.select("track_id", "charted", "loudness_norm", "tempo_norm", "duration_min", "energy_dance",
                    "loud_energy", "markets_count", "genre")


@register("date_parts", with_views(["tracks_raw"], """
SELECT id AS track_id, release_date,
  year(try_strptime(release_date, '%Y-%m-%d')) AS release_year,
  month(try_strptime(release_date, '%Y-%m-%d')) AS release_month,
  isodow(try_strptime(release_date, '%Y-%m-%d')) - 1 AS release_dow,
  (['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'])[month(try_strptime(release_date, '%Y-%m-%d'))] AS month_name,
  (['Mon','Tue','Wed','Thu','Fri','Sat','Sun'])[isodow(try_strptime(release_date, '%Y-%m-%d'))] AS day_name
FROM tracks_raw"""))
def q_date_parts(spark, sf):
    """Strict date parse: year-only strings give NULL parts; names by ordinal."""
    t = views.tracks(spark, sf)
    return t.select("track_id", "release_date", "release_year", "release_month", "release_dow",
                    ordinal_name("release_month", MONTHS).alias("month_name"),
                    ordinal_name("release_dow", DAYS, base=0).alias("day_name"))


@register("parse_list_literal", with_views(["facts"], """
SELECT track_id, artist_ids, primary_artist_id, CAST(n_artists AS INTEGER) AS n_artists FROM facts"""))
def q_parse_list_literal(spark, sf):
    """First element and element count of the list-literal artist ids."""
    f = views.facts(spark, sf)
    return f.select("track_id", "artist_ids", "primary_artist_id", F.col("n_artists").cast("int").alias("n_artists"))


@register("numeric_coerce", """
SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS artist_id,
  coalesce(TRY_CAST(CASE WHEN s_suppkey % 23 = 0 THEN 'n/a'
    ELSE CAST(CAST(floor(greatest(s_acctbal, 0.0) * 1000) AS BIGINT) AS VARCHAR) END AS DOUBLE), 0.0) AS followers
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def q_numeric_coerce(spark, sf):
    """Text followers coerced to numbers; unparsable text becomes 0."""
    a = artists_raw(spark, sf)
    return a.select(F.col("id").alias("artist_id"),
                    F.coalesce(F.col("followers").try_cast("double"), F.lit(0.0)).alias("followers"))


# Fixed values that must equal the reference's: the numeric features of its model, in their order.
MODEL_FEATURES = ["danceability", "energy", "loudness_norm", "tempo_norm", "speechiness", "acousticness",
                  "instrumentalness", "liveness", "valence", "energy_dance", "loud_energy", "duration_min",
                  "explicit", "markets_count", "release_year", "mode", "genre_enc"]


@register("feature_frame", with_views(["tracks"], """
SELECT track_id, charted, danceability, energy, loudness_norm, tempo_norm, speechiness, acousticness,
  instrumentalness, liveness, valence, energy_dance, loud_energy, duration_min,
  CAST(explicit AS DOUBLE) AS explicit, CAST(markets_count AS DOUBLE) AS markets_count,
  CAST(release_year AS DOUBLE) AS release_year, CAST(mode AS DOUBLE) AS mode, 0.0::DOUBLE AS genre_enc,
  21 AS n_features
FROM tracks"""))
def q_feature_frame(spark, sf):
    """Drop non-model columns, list features, re-index to a fixed list (absent -> 0)."""
    t = views.tracks(spark, sf).withColumn("row_key", F.col("track_id"))
    kept = drop_present(t)
    n_feats = len(feature_columns(kept, exclude={"track_id", "charted", "popularity", "row_key"}))
    out = reindex(kept, ["row_key", "charted"] + MODEL_FEATURES)
    return out.select(F.col("row_key").alias("track_id"), "charted",
                      *[F.col(c).cast("double").alias(c) for c in MODEL_FEATURES],
                      F.lit(n_feats).alias("n_features"))
