"""Composed reports (A6, A7, H6): a frame in, one JSON document of sections out, typed numbers back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwise.operators.profile import category_breakdown, class_balance, corr_table, describe, duplicate_count, null_profile, quality_issues, range_profile

#: Section -> (column that names a record, or None where there is one record; its numbers).
VALIDATION = {
    "dataset_overview": (None, ["total_tracks", "total_columns"]),
    "missing_values": ("column", ["count", "pct"]),
    "out_of_range": ("column", ["out_of_range", "pct", "expected_lo", "expected_hi", "actual_min", "actual_max"]),
    "duplicates": (None, ["duplicates"]),
    "class_balance": (None, ["charted_count", "charted_pct", "non_charted_count", "non_charted_pct", "imbalance_ratio"]),
    "genre_breakdown": ("genre", ["count", "charted_rate", "avg_popularity"]),
    "feature_statistics": ("feature", ["mean", "std", "min", "q25", "median", "q75", "max"]),
    "correlation_with_chart": ("feature", ["r", "n"]),
    "quality_issues": ("subject", ["value"]),
    "quality_pass": (None, ["passed"]),
}


def validation_sections(tracks: DataFrame, columns: Sequence[str], features: Sequence[str], key: str = "track_id", label: str = "charted") -> dict[str, DataFrame]:
    """The ten sections of the validation report, each a small result."""
    nulls, ranges = null_profile(tracks, columns), range_profile(tracks)
    dups, balance = duplicate_count(tracks, [key]), class_balance(tracks, label)
    issues = quality_issues(nulls, ranges, dups, balance)
    return {
        "dataset_overview": tracks.agg(F.count(F.lit(1)).alias("total_tracks")).withColumn("total_columns", F.lit(len(tracks.columns))),
        "missing_values": nulls, "out_of_range": ranges, "duplicates": dups, "class_balance": balance,
        "genre_breakdown": category_breakdown(tracks), "feature_statistics": describe(tracks, features),
        "correlation_with_chart": corr_table(tracks, features, label), "quality_issues": issues,
        "quality_pass": issues.agg((F.count(F.lit(1)) == 0).cast("int").alias("passed")),
    }


def report_numbers(report: DataFrame, layout: dict = VALIDATION) -> DataFrame:
    """(section, id, metric, number) of a report that was read back; absent numbers have no row."""
    out = None
    for section, (name, numbers) in layout.items():
        fields = ", ".join([f"`{name}` string"] * (name is not None) + [f"`{n}` double" for n in numbers])
        rows = report.filter(F.col("section") == section).select(F.from_json("record", fields).alias("r"))
        items = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"r.`{n}`").alias("number")) for n in numbers])
        part = rows.select(F.lit(section).alias("section"), (F.col(f"r.`{name}`") if name else F.lit("all")).alias("id"), F.inline(items))
        out = part if out is None else out.unionByName(part)
    return out.filter(F.col("number").isNotNull())
