"""Encoding and cleaning queries (H5, H7, H8, K1-K3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartwise.functions.columns import fround
from chartwise.operators.encode import impute, label_encode, one_hot, standardize, unpivot_long
from chartwise.operators.split import stratified_split
from chartwise.operators.trends import period_means
from chartwise.plans import views
from chartwise.plans.oracle_views import with_views
from chartwise.plans.q_ingest import _split_sql
from chartwise.plans.registry import register

CLUSTER_FEATS = ["danceability", "energy", "valence", "loudness_norm", "acousticness", "speechiness",
                 "instrumentalness", "liveness", "tempo_norm"]
IMPUTE_OUT = ["danceability", "energy", "loudness_norm", "tempo_norm", "valence", "energy_dance", "loud_energy",
              "release_year", "duration_min"]


@register("label_encode", with_views(["tracks"], """
SELECT track_id, genre, CAST(dense_rank() OVER (ORDER BY genre) - 1 AS INTEGER) AS genre_enc FROM tracks"""))
def q_label_encode(spark, sf):
    """Genre -> integer code in sorted order."""
    t = views.tracks(spark, sf).select("track_id", "genre")
    enc, _ = label_encode(t, "genre")
    return enc.select("track_id", "genre", "genre_enc")


@register("one_hot", with_views(["tracks"], "SELECT track_id, " + ", ".join(
    [f"CASE WHEN key = {v} THEN 1 ELSE 0 END AS key_{v}" for v in range(1, 12)]
    + [f"CASE WHEN time_signature = {v} THEN 1 ELSE 0 END AS ts_{v}" for v in range(2, 6)]) + " FROM tracks"))
def q_one_hot(spark, sf):
    """key and time_signature one-hot encoded with the smallest category dropped."""
    t = views.tracks(spark, sf).select("track_id", "key", "time_signature")
    return one_hot(one_hot(t, "key", "key"), "time_signature", "ts")


def _impute_sql(source, fit_where="TRUE"):
    sel = []
    for c in IMPUTE_OUT:
        if c == "duration_min":
            sel.append("coalesce(duration_min, 0.0) AS duration_min")
        else:
            sel.append(f"round_even(coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM {source} WHERE {fit_where})), 6) AS {c}")
    return sel


@register("impute", with_views(["tracks"], "SELECT track_id, " + ", ".join(_impute_sql("tracks"))
                               + ", coalesce(genre, 'unknown') AS genre FROM tracks"))
def q_impute(spark, sf):
    """Median fill of audio features and release year over all rows; constants for the rest."""
    t = impute(views.tracks(spark, sf, round_to=False))
    return t.select("track_id", *[fround(F.col(c).cast("double"), 6).alias(c) if c != "duration_min" else c
                                  for c in IMPUTE_OUT], "genre")


def _impute_train_sql():
    sel = []
    for c in IMPUTE_OUT:
        if c == "duration_min":
            sel.append("coalesce(t.duration_min, 0.0) AS duration_min")
        else:
            sel.append(f"round_even(coalesce(CAST(t.{c} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM tr)), 6) AS {c}")
    return with_views(["tracks"], "SELECT s.track_id, s.split, " + ", ".join(sel)
                      + " FROM tracks t JOIN sp s ON s.track_id = t.track_id",
                      extra_ctes="sp AS (" + _split_sql() + "),\n"
                      "tr AS (SELECT t.* FROM tracks t JOIN sp s ON s.track_id = t.track_id WHERE s.split = 'train')")


@register("impute_train_only", _impute_train_sql())
def q_impute_train_only(spark, sf):
    """Medians fitted on the train split only, applied to train, val and test."""
    t = views.tracks(spark, sf)
    s = stratified_split(t.select("track_id", "charted"), "track_id", "charted").select("track_id", "split")
    # the split feeds several passes (medians of train, then the fill): write it once
    ts = t.join(s, "track_id").checkpoint()
    out = impute(ts, fit_on=ts.filter(F.col("split") == "train"))
    return out.select("track_id", "split", *[fround(F.col(c).cast("double"), 6).alias(c) if c != "duration_min" else c
                                             for c in IMPUTE_OUT])


@register("standardize", with_views(["tracks"], "SELECT track_id, " + ", ".join(
    f"round_even(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in CLUSTER_FEATS)
    + " FROM (SELECT * FROM tracks WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in CLUSTER_FEATS) + ")"))
def q_standardize(spark, sf):
    """Cluster features of complete rows scaled to mean 0 and population std 1."""
    t = views.tracks(spark, sf).select("track_id", *CLUSTER_FEATS).na.drop(subset=CLUSTER_FEATS)
    z = standardize(t, CLUSTER_FEATS)
    return z.select("track_id", *[fround(c, 6).alias(c) for c in CLUSTER_FEATS])


@register("unpivot_means", with_views(["facts"], " UNION ALL ".join(
    f"SELECT release_year, '{c}' AS feature, round_even(favg({c}), 6) AS value FROM facts WHERE release_year IS NOT NULL "
    f"GROUP BY release_year HAVING count(*) >= 50" for c in ["energy", "danceability", "valence", "acousticness"])))
def q_unpivot_means(spark, sf):
    """Yearly feature means melted to (year, feature, value)."""
    feats = ["energy", "danceability", "valence", "acousticness"]
    m = period_means(views.facts(spark, sf), "release_year", feats)
    long = unpivot_long(m.select("release_year", *feats), ["release_year"], feats)
    return long.select("release_year", "feature", fround("value", 6).alias("value"))
