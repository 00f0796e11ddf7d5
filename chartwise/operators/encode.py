"""Encoding and cleaning (H5, H7, H8, K1-K3).

Label codes are numbered by range partition, for any number of values; one-hot categories become
columns, so their list is checked against a limit before it reaches the driver; medians are exact (selection-based,
bounded memory, see :mod:`chartwise.operators.quantiles`).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartwise.operators.joins import dimension_join
from chartwise.operators.moments import exact_sums, variance
from chartwise.operators.quantiles import exact_quantiles


def category_values(df: DataFrame, col: str, max_categories: int = 10_000) -> list:
    """Sorted distinct non-null values; fails beyond ``max_categories``."""
    vals = [r[0] for r in df.select(col).filter(F.col(col).isNotNull()).distinct().limit(max_categories + 1).collect()]
    if len(vals) > max_categories:
        raise ValueError(f"{col} has more than {max_categories} categories")
    return sorted(vals)


def label_mapping(df: DataFrame, col: str) -> DataFrame:
    """(category, code): the sorted distinct non-null values as text, numbered from 0, for any number of values.

    The distinct values are sorted by range partition and written once; a code is the value's rank in its
    partition plus the sizes of the partitions before it (a number per partition).
    """
    values = df.select(F.col(col).cast("string").alias("category")).filter(F.col("category").isNotNull()).distinct()
    ranged = values.repartitionByRange("category").withColumn("_p", F.spark_partition_id()).checkpoint()
    before, starts = 0, []
    for r in ranged.groupBy("_p").count().orderBy("_p").collect():
        starts.append((r["_p"], before))
        before += r["count"]
    starts = df.sparkSession.createDataFrame(starts, "_p int, _start long")
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("category")) - 1
    return ranged.withColumn("_r", rank).join(F.broadcast(starts), "_p").select("category", (F.col("_start") + F.col("_r")).cast("int").alias("code"))


def encode_labels(df: DataFrame, col: str, mapping: DataFrame, out: str) -> DataFrame:
    """``df`` with the code of ``col`` under a fitted mapping; null for values that it doesn't have."""
    return dimension_join(df.withColumn("_v", F.col(col).cast("string")), mapping.select(F.col("category").alias("_v"), F.col("code").alias(out)), "_v", "left").drop("_v")


def label_encode(df: DataFrame, col: str, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """H7: sorted distinct values -> 0..k-1.  Returns (encoded frame, mapping frame)."""
    mapping = label_mapping(df, col)
    return encode_labels(df, col, mapping, out or f"{col}_enc"), mapping


def one_hot(df: DataFrame, col: str, prefix: str, drop_first: bool = True, max_categories: int = 256,
            values: Sequence | None = None) -> DataFrame:
    """H8: 0/1 columns ``{prefix}_{value}`` for the sorted integer categories;
    ``drop_first`` drops the smallest (the reference's reference level)."""
    vals = list(values) if values is not None else category_values(
        df.select(F.col(col).cast("int").alias(col)), col, max_categories)
    keep = vals[1:] if drop_first else vals
    x = F.col(col).cast("int")
    return df.withColumns({f"{prefix}_{v}": (x == F.lit(v)).cast("int") for v in keep}).drop(col)


def medians(df: DataFrame, cols: Sequence[str]) -> dict:
    q = exact_quantiles(df, cols, [0.5])
    return {c: q[(c, 0.5)] for c in cols}


def fill_values(df: DataFrame, values: dict) -> DataFrame:
    """NULL (and NaN) -> value; integer columns filled with a fractional value become double."""
    out = {}
    for c, v in values.items():
        if c not in df.columns or v is None:
            continue
        x = F.col(c)
        if isinstance(v, float):
            is_float = df.schema[c].dataType.typeName() in ("double", "float")
            miss = (x.isNull() | F.isnan(x)) if is_float else x.isNull()
            out[c] = F.when(miss, F.lit(v)).otherwise(x.cast("double"))
        else:
            out[c] = F.coalesce(x, F.lit(v))
    return df.withColumns(out) if out else df


# Fixed values that must equal the reference's: which columns get which fill.
MEDIAN_FILL = ["danceability", "energy", "loudness_norm", "tempo_norm", "speechiness", "acousticness",
               "instrumentalness", "liveness", "valence", "energy_dance", "loud_energy", "key", "mode",
               "time_signature", "release_year"]
CONSTANT_FILL = {"genre": "unknown", "markets_count": 0, "explicit": 0, "duration_min": 0.0}


def impute(df: DataFrame, median_cols: Sequence[str] = MEDIAN_FILL, constants: dict = CONSTANT_FILL,
           fit_on: DataFrame | None = None) -> DataFrame:
    """K1/K2: median fill (medians of ``fit_on``, default the frame itself) plus constant fills."""
    cols = [c for c in median_cols if c in df.columns]
    med = medians(fit_on if fit_on is not None else df, cols)
    vals = {c: float(v) for c, v in med.items() if v is not None}
    vals.update({c: v for c, v in constants.items() if c in df.columns})
    return fill_values(df, vals)


def standardize(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """K3: (x - mean) / population std, from one pass of exact sums."""
    sums = exact_sums(df, {c: F.col(c) for c in cols}, [t for c in cols for t in ((c,), (c, c))])[()]
    exprs = {}
    for c in cols:
        one = sums[c,]
        spread = variance(one.n, one.total, sums[c, c].total)
        exprs[c + suffix] = (F.col(c) - F.lit(float(one.mean))) / F.lit(math.sqrt(spread)) if spread else F.lit(0.0)
    return df.withColumns(exprs)


def unpivot_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str = "feature",
                 val: str = "value") -> DataFrame:
    """H5: wide -> long."""
    return df.unpivot(list(ids), list(values), var, val)
