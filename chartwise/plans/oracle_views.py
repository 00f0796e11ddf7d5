"""DuckDB forms of the analog views, written independently of the Spark code.

Each oracle query inlines the views it needs as CTEs over the raw parquet
views (region nation customer supplier part orders lineitem events ...).
"""

from __future__ import annotations

CTES: dict[str, str] = {}

CTES["tracks_raw"] = """
tracks_raw AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS id,
    'Track#' || CAST(o.o_orderkey AS VARCHAR) AS name,
    CAST(floor(o.o_totalprice / 5000) AS INTEGER) AS popularity,
    CAST(l.dur * 2400 AS BIGINT) AS duration_ms,
    CASE WHEN o.o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS explicit,
    '[''' || array_to_string(l.sup, ''', ''') || ''']' AS id_artists,
    CASE WHEN o.o_orderkey % 4 = 0 THEN substr(strftime(o.o_orderdate, '%Y-%m-%d'), 1, 4)
         ELSE strftime(o.o_orderdate, '%Y-%m-%d') END AS release_date,
    l.q / 50 AS danceability,
    l.d100 / 10.0::DOUBLE AS energy,
    CAST(o.o_custkey % 12 AS INTEGER) AS key,
    -60.0::DOUBLE + 62.0::DOUBLE * (l.p / 105000) AS loudness,
    CAST(o.o_orderkey % 2 AS INTEGER) AS mode,
    (o.o_orderkey % 97) / 96.0::DOUBLE AS speechiness,
    (o.o_orderkey % 89) / 88.0::DOUBLE AS acousticness,
    (o.o_orderkey % 83) / 82.0::DOUBLE AS instrumentalness,
    (o.o_custkey % 79) / 78.0::DOUBLE AS liveness,
    l.t100 / 8.0::DOUBLE AS valence,
    260.0::DOUBLE * (1.0::DOUBLE - l.q / 50) AS tempo,
    CAST(least(l.nl, 5) AS INTEGER) AS time_signature,
    CASE o.o_orderstatus WHEN 'F' THEN 'folk' WHEN 'O' THEN 'opera' ELSE 'pop' END AS genre
  FROM orders o LEFT JOIN (
    SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) / count(*) AS q,
      sum(CAST(round(l_discount * 100) AS BIGINT)) / count(*) AS d100,
      sum(CAST(round(l_tax * 100) AS BIGINT)) / count(*) AS t100,
      sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / count(*) / 100.0::DOUBLE AS p,
      CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS dur, count(*) AS nl,
      list_sort(list(DISTINCT 'S' || CAST(l_suppkey AS VARCHAR))) AS sup
    FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey)"""

CTES["tracks"] = """
tracks AS (
  SELECT id AS track_id, name AS track_name, popularity, duration_ms, explicit, id_artists AS artist_ids,
    release_date, danceability, energy, key, loudness, mode, speechiness, acousticness, instrumentalness,
    liveness, valence, tempo, time_signature, genre,
    CASE WHEN popularity >= 70 THEN 1 ELSE 0 END AS charted,
    CASE WHEN loudness IS NULL THEN NULL ELSE greatest(0.0, least(1.0, (loudness + 60.0) / 60.0)) END AS loudness_norm,
    CASE WHEN tempo IS NULL THEN NULL ELSE greatest(0.0, least(1.0, (tempo - 40.0) / 180.0)) END AS tempo_norm,
    duration_ms / 60000.0::DOUBLE AS duration_min,
    energy * danceability AS energy_dance,
    CASE WHEN loudness IS NULL THEN NULL ELSE greatest(0.0, least(1.0, (loudness + 60.0) / 60.0)) END * energy AS loud_energy,
    0 AS markets_count,
    year(try_strptime(release_date, '%Y-%m-%d')) AS release_year,
    month(try_strptime(release_date, '%Y-%m-%d')) AS release_month,
    isodow(try_strptime(release_date, '%Y-%m-%d')) - 1 AS release_dow
  FROM tracks_raw)"""

CTES["artists"] = """
artists AS (
  SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS artist_id, s_name AS artist_name,
    CASE WHEN s_suppkey % 23 = 0 THEN 0.0::DOUBLE
         ELSE CAST(CAST(floor(greatest(s_acctbal, 0.0) * 1000) AS BIGINT) AS DOUBLE) END AS followers,
    CASE WHEN s_suppkey % 10 = 0 THEN '[]' ELSE '[''' || n_name || ''', ''' || r_name || ''']' END AS genres,
    CAST(s_suppkey % 100 AS INTEGER) AS popularity
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

CTES["facts"] = """
facts AS (
  SELECT t.track_id, t.track_name, t.popularity AS popularity_track, t.duration_ms, t.explicit, t.artist_ids,
    t.release_date, t.danceability, t.energy, t.key, t.loudness, t.mode, t.speechiness, t.acousticness,
    t.instrumentalness, t.liveness, t.valence, t.tempo, t.time_signature, t.genre, t.charted,
    t.loudness_norm, t.tempo_norm, t.duration_min, t.energy_dance, t.loud_energy, t.markets_count,
    t.release_year, t.release_month, t.release_dow,
    nullif(regexp_extract(t.artist_ids, '''([^'']+)''', 1), '') AS primary_artist_id,
    CASE WHEN t.artist_ids IS NULL THEN 1 ELSE len(regexp_extract_all(t.artist_ids, '''([^'']*)''', 1)) END AS n_artists,
    a.artist_id, coalesce(a.followers, 0.0) AS followers, a.genres, a.popularity AS popularity_artist
  FROM tracks t LEFT JOIN artists a ON a.artist_id = nullif(regexp_extract(t.artist_ids, '''([^'']+)''', 1), ''))"""

DEPENDS = {"tracks_raw": [], "tracks": ["tracks_raw"], "artists": [], "facts": ["tracks", "artists"]}


def _closure(names):
    out: list[str] = []

    def visit(n):
        for d in DEPENDS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)
    for n in names:
        visit(n)
    return out


def with_views(names, body: str, extra_ctes: str = "") -> str:
    """``WITH <needed analog views>[, extra] <body>``."""
    parts = [CTES[n].strip() for n in _closure(names)]
    if extra_ctes.strip():
        parts.append(extra_ctes.strip())
    return "WITH " + ",\n".join(parts) + "\n" + body


Z = 1.96
Z2 = Z * Z
CHI2_CRIT = 3.841458820694124


def _wilson_sql(s, n, lo: bool):
    p = f"(CASE WHEN {n} > 0 THEN {s} / {n} ELSE 0.0 END)"
    d = f"(1.0 + {Z2!r} / {n})"
    c = f"(({p} + {Z2!r} / (2.0 * {n})) / {d})"
    m = f"(({Z!r} * sqrt({p} * (1.0 - {p}) / {n} + {Z2!r} / (4.0 * {n} * {n}))) / {d})"
    inner = f"greatest(0.0, {c} - {m})" if lo else f"least(1.0, {c} + {m})"
    return f"CASE WHEN {n} > 0 THEN round_even({inner}, 4) ELSE 0.0 END"


def _tails_sql(x: str, scale: str, density, steps: int = 4000) -> str:
    """1 - 2 x the integral of an even density from 0 to |x| by Simpson's rule; ``density(u)`` times ``scale``."""
    u = f"(abs({x}) * i / {steps}.0)"
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END"
    area = f"abs({x}) / {steps}.0 / 3.0 * {scale} * list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * {density(u)}))"
    return f"CASE WHEN {x} IS NOT NULL THEN greatest(0.0, 1.0 - 2.0 * {area}) END"


def t_p_sql(t: str, v: str) -> str:
    """Two-sided Student-t tail from the density itself, independent of the library's incomplete beta."""
    scale = f"exp(lgamma(({v} + 1.0) / 2.0) - lgamma({v} / 2.0)) / sqrt({v} * pi())"
    return _tails_sql(f"least(abs({t}), 80.0 + 0.0 * {t})", scale, lambda u: f"pow(1.0 + {u} * {u} / {v}, -({v} + 1.0) / 2.0)")


def chi2_p_sql(x: str) -> str:
    """Upper tail of chi-square with one degree of freedom: both tails of the normal beyond its root."""
    return _tails_sql(f"least(sqrt({x}), 12.0 + 0.0 * {x})", "1.0 / sqrt(2.0 * pi())", lambda u: f"exp(-{u} * {u} / 2.0)")


def ab_sql(counts_sql: str, clamp: bool = False, keep: str = "", p: bool = False) -> str:
    """DuckDB A/B result from a subquery with group_a, group_b, n_a, s_a, n_b, s_b."""
    def cell(x):
        return f"greatest({x}, 1.0)" if clamp else x
    a, b = cell("sa"), cell("(na - sa)")
    c, d = cell("sb"), cell("(nb - sb)")
    chi = (f"CASE WHEN ({a} + {b}) * ({c} + {d}) * ({a} + {c}) * ({b} + {d}) > 0 THEN "
           f"({a} + {b} + {c} + {d}) * ({a} * {d} - {b} * {c}) * ({a} * {d} - {b} * {c}) / "
           f"(({a} + {b}) * ({c} + {d}) * ({a} + {c}) * ({b} + {d})) END")
    h = "round_even(abs(2.0 * asin(sqrt(greatest(0.0, ra))) - 2.0 * asin(sqrt(greatest(0.0, rb)))), 4)"
    return f"""
SELECT {keep} group_a, group_b, CAST(na AS BIGINT) AS n_a, CAST(nb AS BIGINT) AS n_b,
  round_even(ra, 4) AS chart_rate_a, round_even(rb, 4) AS chart_rate_b,
  {_wilson_sql('sa', 'na', True)} AS ci_a_lo, {_wilson_sql('sa', 'na', False)} AS ci_a_hi,
  {_wilson_sql('sb', 'nb', True)} AS ci_b_lo, {_wilson_sql('sb', 'nb', False)} AS ci_b_hi,
  round_even({chi}, 6) AS chi2, coalesce(({chi}) > {CHI2_CRIT!r}, false) AS significant,
  {h} AS cohen_h,
  CASE WHEN {h} < 0.2 THEN 'negligible' WHEN {h} < 0.5 THEN 'small' WHEN {h} < 0.8 THEN 'medium' ELSE 'large' END AS effect_size,
  CASE WHEN ra > rb THEN group_a ELSE group_b END AS winner,
  CASE WHEN rb > 0 THEN round_even((ra - rb) / rb, 4) END AS lift{f", round_even({chi2_p_sql(f'({chi})')}, 6) AS p_value" if p else ""}
FROM (SELECT *, CASE WHEN na > 0 THEN sa / na ELSE 0.0 END AS ra, CASE WHEN nb > 0 THEN sb / nb ELSE 0.0 END AS rb
      FROM (SELECT *, CAST(n_a AS DOUBLE) AS na, CAST(s_a AS DOUBLE) AS sa, CAST(n_b AS DOUBLE) AS nb,
            CAST(s_b AS DOUBLE) AS sb FROM ({counts_sql})))"""


def ab_counts_sql(table: str, pred_a: str, pred_b: str, name_a: str, name_b: str, min_n: int = 0,
                  label: str = "charted") -> str:
    where = f" WHERE n_a > {min_n} AND n_b > {min_n}" if min_n else ""
    return (f"SELECT * FROM (SELECT '{name_a}' AS group_a, '{name_b}' AS group_b, "
            f"count(*) FILTER (WHERE {pred_a}) AS n_a, coalesce(sum({label}) FILTER (WHERE {pred_a}), 0) AS s_a, "
            f"count(*) FILTER (WHERE {pred_b}) AS n_b, coalesce(sum({label}) FILTER (WHERE {pred_b}), 0) AS s_b "
            f"FROM {table}){where}")
