"""Tidy and derive (B1-B10, B18-B20) and the track x artist fact join.

All derivations are column expressions: one projection, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwise.functions.columns import (clip, list_literal_count, list_literal_first, round_opt)
from chartwise.operators.joins import dimension_join

# Fixed values that must equal the reference's: source -> internal column
# names, the chart threshold, and the columns the model never sees.
TRACK_RENAMES = {"id": "track_id", "name": "track_name", "artists": "artist_names", "id_artists": "artist_ids"}
ARTIST_RENAMES = {"id": "artist_id", "name": "artist_name"}
CHART_THRESHOLD = 70
DROP_COLUMNS = ["track_name", "artist_names", "album_name", "release_date", "artist_ids", "duration_ms",
                "loudness", "tempo", "track_id"]
NON_FEATURES = {"track_id", "charted", "popularity"}


def rename_present(df: DataFrame, mapping: dict) -> DataFrame:
    """B1: rename by map; names that are absent are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Add constant columns only where absent."""
    add = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(add) if add else df


def charted_flag(popularity, threshold: int = CHART_THRESHOLD):
    """B2: 1 if popularity >= threshold else 0 (NULL popularity counts as 0)."""
    return F.coalesce((F.col(popularity) >= threshold).cast("int"), F.lit(0))


def date_parts(df: DataFrame, src: str = "release_date", prefix: str = "release_") -> DataFrame:
    """Strict yyyy-MM-dd parse; year-only or bad strings become NULL parts."""
    d = F.try_to_date(F.col(src), "yyyy-MM-dd")
    return df.withColumns({
        f"{prefix}year": F.year(d),
        f"{prefix}month": F.month(d),
        f"{prefix}dow": F.weekday(d),
    })


def prepare_tracks(df: DataFrame, threshold: int = CHART_THRESHOLD, round_to: bool = False,
                   loud_energy: str = "norm", with_dates: bool = True) -> DataFrame:
    """Rename, label and derive the model/analysis columns.

    ``round_to=True`` rounds like the validating/preprocessing loaders
    (norms 4 dp, minutes 2 dp, products 4 dp); ``False`` keeps full precision
    like the analysis loaders.  ``loud_energy``: ``'norm'`` = loudness_norm *
    energy, ``'abs'`` = abs(loudness) * energy (the collector's definition).
    """
    df = rename_present(df, TRACK_RENAMES)
    have = set(df.columns)
    r4 = 4 if round_to else None
    r2 = 2 if round_to else None
    new = {}
    if "charted" not in have and "popularity" in have:
        new["charted"] = charted_flag("popularity", threshold)
    if "genre" not in have:
        new["genre"] = F.lit("unknown")
    if "loudness_norm" not in have and "loudness" in have:
        new["loudness_norm"] = round_opt(clip((F.col("loudness") + 60.0) / 60.0, 0.0, 1.0), r4)
    if "tempo_norm" not in have and "tempo" in have:
        new["tempo_norm"] = round_opt(clip((F.col("tempo") - 40.0) / 180.0, 0.0, 1.0), r4)
    if "duration_min" not in have and "duration_ms" in have:
        new["duration_min"] = round_opt(F.col("duration_ms") / 60000.0, r2)
    df = df.withColumns(new) if new else df
    have = set(df.columns)
    new = {}
    if "energy_dance" not in have and {"energy", "danceability"} <= have:
        new["energy_dance"] = round_opt(F.col("energy") * F.col("danceability"), r4)
    if "loud_energy" not in have and "energy" in have:
        base = F.abs(F.col("loudness")) if loud_energy == "abs" else F.col("loudness_norm")
        new["loud_energy"] = round_opt(base * F.col("energy"), r4)
    if "markets_count" not in have:
        new["markets_count"] = F.lit(0)
    df = df.withColumns(new) if new else df
    if with_dates and "release_date" in df.columns and "release_year" not in df.columns:
        df = date_parts(df)
    return df


def prepare_artists(df: DataFrame) -> DataFrame:
    """Rename and coerce followers to a number (bad text -> 0)."""
    df = rename_present(df, ARTIST_RENAMES)
    return df.withColumn("followers", F.coalesce(F.col("followers").try_cast("double"), F.lit(0.0)))


def with_artist_keys(tracks: DataFrame, list_col: str = "artist_ids", mode: str = "literal") -> DataFrame:
    """Primary artist id and artist count from the list column."""
    return tracks.withColumns({
        "primary_artist_id": list_literal_first(F.col(list_col), mode),
        "n_artists": list_literal_count(F.col(list_col), mode),
    })


def join_artists(tracks: DataFrame, artists: DataFrame, broadcast_max_rows: int = 1_000_000,
                 hot_min_rows: int = 1_000_000) -> DataFrame:
    """Tracks LEFT JOIN artists on the primary artist; popularity clash is
    suffixed ``_track`` / ``_artist``; missing followers become 0.

    The artist side is broadcast only after a row-count check; a larger one is
    joined by shuffle with artists holding >= ``hot_min_rows`` tracks salted (see ``joins.hot_key_join``).
    """
    if "primary_artist_id" not in tracks.columns:
        tracks = with_artist_keys(tracks)
    keep = [c for c in ("artist_id", "followers", "genres", "popularity") if c in artists.columns]
    dim = artists.select(*keep)
    if "popularity" in keep:
        tracks = tracks.withColumnRenamed("popularity", "popularity_track")
        dim = dim.withColumnRenamed("popularity", "popularity_artist")
    dim = dim.withColumn("primary_artist_id", F.col("artist_id"))
    out = dimension_join(tracks, dim, "primary_artist_id", "left", broadcast_max_rows, hot_min_rows)
    cols = [c for c in tracks.columns] + [c for c in dim.columns if c != "primary_artist_id"]
    return out.select(*cols).withColumn("followers", F.coalesce(F.col("followers"), F.lit(0.0)))


def drop_present(df: DataFrame, cols: Iterable[str] = DROP_COLUMNS) -> DataFrame:
    """Drop listed columns when present."""
    return df.drop(*[c for c in cols if c in df.columns])


def feature_columns(df: DataFrame, exclude: Iterable[str] = NON_FEATURES) -> list[str]:
    """Every column except ids and targets."""
    ex = set(exclude)
    return [c for c in df.columns if c not in ex]


def reindex(df: DataFrame, columns: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Fixed column list; missing columns become ``fill``."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(fill).cast("double").alias(c) for c in columns])
