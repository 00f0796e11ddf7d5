"""Shared views for the query catalogue: prepared tracks, artists, facts.

The fact view (orders x line aggregates x artists) feeds most analyses. A view is a lazy plan, so that the one pass of an
analysis reads and builds only the columns that it needs. What reads a view many times (a report of all analyses)
calls :func:`keep` first: its rows are then persisted MEMORY_AND_DISK and every query of the session on the same
view reads them, until :func:`clear`. A lost executor's blocks are built again from the lineage.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from chartwise.operators.prepare import (join_artists, prepare_artists, prepare_tracks,
                                         with_artist_keys)
from chartwise.sources.tables import artists_raw, tracks_raw

_CACHE: dict = {}


def _memo(spark: SparkSession, sf_dir: str, name: str, build):
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _CACHE:
        _CACHE[key] = build()
    return _CACHE[key]


def keep(view: DataFrame) -> DataFrame:
    """Persist a view's rows for queries that follow, until :func:`clear`."""
    return view.persist(StorageLevel.MEMORY_AND_DISK)


def clear() -> None:
    """Forget every view, and what is persisted of it."""
    for df in _CACHE.values():
        try:
            df.unpersist()
        except Exception:
            pass
    _CACHE.clear()


def tracks(spark: SparkSession, sf_dir: str, round_to: bool = False) -> DataFrame:
    return _memo(spark, sf_dir, f"tracks-{round_to}",
                 lambda: prepare_tracks(tracks_raw(spark, sf_dir), round_to=round_to))


def artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memo(spark, sf_dir, "artists", lambda: prepare_artists(artists_raw(spark, sf_dir)))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared tracks LEFT JOIN artists on the primary artist (followers 0 when absent)."""
    return _memo(spark, sf_dir, "facts",
                 lambda: join_artists(with_artist_keys(tracks(spark, sf_dir)), artists(spark, sf_dir)))
