"""Rate-by-group queries over the fact view."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartwise.functions.columns import fround

from chartwise.plans import views
from chartwise.plans.oracle_views import with_views
from chartwise.plans.registry import register
from chartwise.operators.rates import explode_rates, flag_best, group_rates, top_bottom


def _genre_rates(spark, sf):
    f = views.facts(spark, sf)
    a = views.artists(spark, sf)
    r = explode_rates(f, a, "primary_artist_id", "artist_id", "genres", label="charted",
                      value="popularity_track", min_n=50)
    return r.select(F.col("element").alias("genre"), "n", F.col("positives").alias("charted"),
                    fround("avg_value", 6).alias("avg_pop"), fround("rate", 6).alias("chart_rate"))


GENRE_ORACLE = with_views(["facts"], """
SELECT genre, CAST(count(charted) AS BIGINT) AS n, CAST(sum(charted) AS BIGINT) AS charted,
  round_even(avg(popularity_track), 6) AS avg_pop, round_even(sum(charted) / count(charted), 6) AS chart_rate
FROM g GROUP BY genre HAVING count(charted) >= 50
""", extra_ctes="""
g AS (
  SELECT f.track_id, f.charted, f.popularity_track, e.genre
  FROM facts f JOIN (
    SELECT artist_id, unnest(regexp_extract_all(genres, '''([^'']*)''', 1)) AS genre FROM artists) e
  ON e.artist_id = f.primary_artist_id
  WHERE e.genre IS NOT NULL AND e.genre <> '')""")


@register("genre_rank", GENRE_ORACLE, headline=True)
def genre_rank(spark, sf):
    """Genres of the primary artist ranked by chart rate (n >= 50)."""
    return _genre_rates(spark, sf).orderBy(F.desc("chart_rate"), "genre")


@register("genre_top_bottom", with_views(["facts"], """
(SELECT genre, n, charted, avg_pop, chart_rate, 'top' AS section FROM gr ORDER BY chart_rate DESC, genre ASC LIMIT 15)
UNION ALL
(SELECT genre, n, charted, avg_pop, chart_rate, 'bottom' AS section FROM gr ORDER BY chart_rate ASC, genre DESC LIMIT 5)
""", extra_ctes=GENRE_ORACLE[GENRE_ORACLE.index("g AS ("):].split("\nSELECT genre")[0].rstrip().rstrip(",") + """,
gr AS (
  SELECT genre, CAST(count(charted) AS BIGINT) AS n, CAST(sum(charted) AS BIGINT) AS charted,
    round_even(avg(popularity_track), 6) AS avg_pop, round_even(sum(charted) / count(charted), 6) AS chart_rate
  FROM g GROUP BY genre HAVING count(charted) >= 50)"""))
def genre_top_bottom(spark, sf):
    """Top 15 and bottom 5 genres by chart rate (genre name breaks ties)."""
    return top_bottom(_genre_rates(spark, sf), "chart_rate", "genre", 15, 5)


# Fixed values that must equal the reference's: tier and bucket labels/edges.
COLLAB = ["Solo (1 artist)", "Duo (2 artists)", "Group (3+ artists)"]
FOLLOWER_TIERS = ["<100K followers", "100K–1M", "1M+ followers"]
DURATION_EDGES = [0, 2, 2.5, 3, 3.5, 4, 5, 6, 100]
DURATION_LABELS = ["<2m", "2–2.5m", "2.5–3m", "3–3.5m", "3.5–4m", "4–5m", "5–6m", "6m+"]


def collab_tier_col():
    n = F.col("n_artists")
    return F.when(n == 1, COLLAB[0]).when(n == 2, COLLAB[1]).otherwise(COLLAB[2])


@register("collab_tiers", with_views(["facts"], """
SELECT tier, CAST(count(*) AS BIGINT) AS n, CAST(sum(charted) AS BIGINT) AS charted,
  round_even(avg(charted), 4) AS chart_rate
FROM (SELECT charted, CASE WHEN n_artists = 1 THEN 'Solo (1 artist)' WHEN n_artists = 2 THEN 'Duo (2 artists)'
      ELSE 'Group (3+ artists)' END AS tier FROM facts) GROUP BY tier"""))
def collab_tiers(spark, sf):
    """Chart rate by number of credited artists (0 falls in the group tier, as in the reference)."""
    f = views.facts(spark, sf).withColumn("tier", collab_tier_col())
    r = group_rates(f, "tier", digits=4)
    return r.select("tier", "n", F.col("positives").alias("charted"), F.col("rate").alias("chart_rate"))


def follower_tier_col():
    x = F.col("followers")
    return F.when(x < 100_000, FOLLOWER_TIERS[0]).when(x < 1_000_000, FOLLOWER_TIERS[1]).otherwise(FOLLOWER_TIERS[2])


@register("follower_tiers", with_views(["facts"], """
SELECT tier, CAST(count(*) AS BIGINT) AS n, CAST(sum(charted) AS BIGINT) AS charted,
  round_even(avg(charted), 4) AS chart_rate, round_even(avg(followers), 6) AS avg_followers
FROM (SELECT charted, followers, CASE WHEN followers < 100000 THEN '<100K followers'
      WHEN followers < 1000000 THEN '100K–1M' ELSE '1M+ followers' END AS tier FROM facts) GROUP BY tier"""))
def follower_tiers(spark, sf):
    """Left-closed follower tiers <100K, 100K-1M, 1M+ with chart rate."""
    f = views.facts(spark, sf).withColumn("tier", follower_tier_col())
    r = group_rates(f, "tier", digits=4, extra={"avg_followers": fround(F.avg("followers"), 6)})
    return r.select("tier", "n", F.col("positives").alias("charted"), F.col("rate").alias("chart_rate"),
                    "avg_followers")


def _duration_case(col="duration_min"):
    parts = [f"WHEN {col} > {lo} AND {col} <= {hi} THEN {i}" for i, (lo, hi) in
             enumerate(zip(DURATION_EDGES[:-1], DURATION_EDGES[1:]))]
    return "CASE " + " ".join(parts) + " END"


@register("duration_buckets", with_views(["facts"], f"""
SELECT bucket, ordinal, n, chart_rate,
  (chart_rate = max(chart_rate) OVER () AND ordinal = min(CASE WHEN chart_rate = mx THEN ordinal END) OVER ()) AS is_optimal
FROM (
  SELECT (['<2m','2–2.5m','2.5–3m','3–3.5m','3.5–4m','4–5m','5–6m','6m+'])[b + 1] AS bucket, b AS ordinal,
    CAST(count(*) AS BIGINT) AS n, round_even(avg(charted), 4) AS chart_rate,
    max(round_even(avg(charted), 4)) OVER () AS mx
  FROM (SELECT charted, {_duration_case()} AS b FROM facts) WHERE b IS NOT NULL
  GROUP BY b HAVING count(*) >= 20)"""))
def duration_buckets(spark, sf):
    """Right-closed duration buckets (n >= 20) with the optimal (first best) bucket flagged."""
    from chartwise.functions.columns import right_closed_bin_index
    f = views.facts(spark, sf).withColumn("ordinal", right_closed_bin_index("duration_min", DURATION_EDGES))
    r = group_rates(f.filter(F.col("ordinal").isNotNull()), "ordinal", min_n=20, digits=4)
    r = r.withColumn("bucket", F.element_at(F.array(*[F.lit(x) for x in DURATION_LABELS]), F.col("ordinal") + 1))
    r = flag_best(r, "rate", "ordinal", flag="is_optimal")
    return r.select("bucket", "ordinal", "n", F.col("rate").alias("chart_rate"), "is_optimal")


@register("release_timing", with_views(["facts"], """
SELECT dimension, ordinal, name, n, chart_rate,
  (chart_rate = mx AND ordinal = min(CASE WHEN chart_rate = mx THEN ordinal END) OVER (PARTITION BY dimension)) AS is_best
FROM (
  SELECT dimension, ordinal, name, n, chart_rate, max(chart_rate) OVER (PARTITION BY dimension) AS mx FROM (
    SELECT 'month' AS dimension, release_month AS ordinal,
      (['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'])[release_month] AS name,
      CAST(count(*) AS BIGINT) AS n, round_even(avg(charted), 4) AS chart_rate
    FROM facts WHERE release_month IS NOT NULL GROUP BY release_month HAVING count(*) >= 20
    UNION ALL
    SELECT 'weekday', release_dow, (['Mon','Tue','Wed','Thu','Fri','Sat','Sun'])[release_dow + 1],
      CAST(count(*) AS BIGINT), round_even(avg(charted), 4)
    FROM facts WHERE release_dow IS NOT NULL GROUP BY release_dow HAVING count(*) >= 20))"""))
def release_timing(spark, sf):
    """Chart rate by release month and weekday (n >= 20), best of each flagged."""
    from chartwise.plans.q_prepare import DAYS, MONTHS
    from chartwise.functions.columns import ordinal_name
    f = views.facts(spark, sf)
    m = group_rates(f.filter(F.col("release_month").isNotNull()), "release_month", min_n=20, digits=4) \
        .select(F.lit("month").alias("dimension"), F.col("release_month").alias("ordinal"),
                ordinal_name("release_month", MONTHS).alias("name"), "n", "rate")
    d = group_rates(f.filter(F.col("release_dow").isNotNull()), "release_dow", min_n=20, digits=4) \
        .select(F.lit("weekday").alias("dimension"), F.col("release_dow").alias("ordinal"),
                ordinal_name("release_dow", DAYS, base=0).alias("name"), "n", "rate")
    r = flag_best(m.unionByName(d), "rate", "ordinal", partition=["dimension"])
    return r.select("dimension", "ordinal", "name", "n", F.col("rate").alias("chart_rate"), "is_best")


@register("group_rates", with_views(["facts"], """
SELECT key, explicit, CAST(count(charted) AS BIGINT) AS n, CAST(sum(charted) AS BIGINT) AS positives,
  round_even(avg(charted), 6) AS rate
FROM facts GROUP BY key, explicit"""))
def q_group_rates(spark, sf):
    """n, positives and rate per (key, explicit) group."""
    return group_rates(views.facts(spark, sf), ["key", "explicit"], digits=6)


LOG_EDGES = [i * 0.5 for i in range(17)]


@register("follower_buckets", with_views(["facts"], """
SELECT b AS bucket_index, b * 0.5::DOUBLE AS log_lo, b * 0.5::DOUBLE + 0.5::DOUBLE AS log_hi, b * 0.5::DOUBLE + 0.25::DOUBLE AS log_mid,
  format('{:>8} – {:<10}', format('{:,}', CAST(round_even(pow(10, b * 0.5::DOUBLE), 0) AS BIGINT)),
         format('{:,}', CAST(round_even(pow(10, b * 0.5::DOUBLE + 0.5::DOUBLE), 0) AS BIGINT))) AS label,
  CAST(round_even(pow(10, b * 0.5 + 0.25), 0) AS BIGINT) AS followers_approx,
  CAST(count(*) AS BIGINT) AS n, CAST(sum(charted) AS BIGINT) AS charted, round_even(avg(charted), 4) AS chart_rate
FROM (SELECT charted, CAST(ceil(log10(greatest(followers, 1.0)) / 0.5) AS INTEGER) - 1 AS b
      FROM facts WHERE followers > 0 AND log10(greatest(followers, 1.0)) > 0 AND log10(greatest(followers, 1.0)) <= 8)
GROUP BY b HAVING count(*) >= 100"""))
def follower_buckets(spark, sf):
    """Chart rate by half-decade log10(followers) bucket (followers > 0, n >= 100)."""
    from chartwise.functions.columns import right_closed_bin_index
    f = views.facts(spark, sf).filter(F.col("followers") > 0)
    f = f.withColumn("bucket_index", right_closed_bin_index(F.log10(F.greatest("followers", F.lit(1.0))), LOG_EDGES))
    r = group_rates(f.filter(F.col("bucket_index").isNotNull()), "bucket_index", min_n=100, digits=4)
    lo = F.col("bucket_index") * 0.5
    label = F.format_string("%8s – %-10s", F.format_number(F.pow(F.lit(10.0), lo), 0),
                            F.format_number(F.pow(F.lit(10.0), lo + 0.5), 0))
    return r.select("bucket_index", lo.alias("log_lo"), (lo + 0.5).alias("log_hi"), (lo + 0.25).alias("log_mid"), label.alias("label"),
                    fround(F.pow(F.lit(10.0), lo + 0.25), 0).cast("bigint").alias("followers_approx"),
                    "n", F.col("positives").alias("charted"), F.col("rate").alias("chart_rate"))


@register("join_artists", with_views(["facts"], """
SELECT track_id, primary_artist_id, followers, genres, popularity_track, popularity_artist FROM facts"""))
def q_join_artists(spark, sf):
    """Tracks left-joined to their primary artist; followers 0 when unmatched."""
    return views.facts(spark, sf).select("track_id", "primary_artist_id", "followers", "genres",
                                         "popularity_track", "popularity_artist")
