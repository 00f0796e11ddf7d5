"""Data-quality profile (E2-E8) and quality rules.

Each profile is ONE aggregate pass over the table (all columns at once);
only the 1-row result is reshaped into one row per column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from chartwise.functions.columns import fround
from chartwise.operators.moments import exact_sums, number, variance
from chartwise.operators.quantiles import exact_quantiles
from chartwise.operators.stattests import correlations

# Fixed values that must equal the reference's: expected value ranges and
# quality-rule limits.
EXPECTED_RANGES = {
    "danceability": (0.0, 1.0),
    "energy": (0.0, 1.0),
    "key": (0, 11),
    "loudness": (-60.0, 0.0),
    "mode": (0, 1),
    "speechiness": (0.0, 1.0),
    "acousticness": (0.0, 1.0),
    "instrumentalness": (0.0, 1.0),
    "liveness": (0.0, 1.0),
    "valence": (0.0, 1.0),
    "tempo": (30.0, 250.0),
    "time_signature": (1, 7),
    "popularity": (0, 100),
    "duration_ms": (10_000, 3_600_000),
}
AUDIO_FEATURES = ["danceability", "energy", "key", "loudness", "mode", "speechiness", "acousticness",
                  "instrumentalness", "liveness", "valence", "tempo", "time_signature"]
MAX_DUPLICATES = 0
MAX_NULL_PCT = 5
MAX_RANGE_PCT = 1
MAX_IMBALANCE = 10


def _is_float(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (DoubleType, FloatType))


def _missing(df: DataFrame, c: str):
    m = F.col(c).isNull()
    return (m | F.isnan(F.col(c))) if _is_float(df, c) else m


def _valid(df: DataFrame, c: str):
    """Numeric value with NaN as NULL (pandas skips both)."""
    x = F.col(c).try_cast("double") if not _is_float(df, c) else F.col(c)
    return F.when(~F.isnan(x), x)


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, count, pct) for columns with missing values; pct of all rows, 2 dp."""
    cols = list(cols or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count(F.when(_missing(df, c), 1)).alias(f"m{i}") for i, c in enumerate(cols)])
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("ordinal"), F.col(f"m{i}").alias("count"))
                      for i, c in enumerate(cols)])
    out = row.select("_n", F.inline(items))
    return (out.filter(F.col("count") > 0)
            .select("column", "ordinal", F.col("count").cast("bigint").alias("count"),
                    fround(F.col("count") / F.col("_n") * 100.0, 2).alias("pct")))


def range_profile(df: DataFrame, rules: dict | None = None) -> DataFrame:
    """Columns with values strictly outside [lo, hi]: count, pct of all rows, min, max."""
    rules = {c: r for c, r in (rules or EXPECTED_RANGES).items() if c in df.columns}
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, (c, (lo, hi)) in enumerate(rules.items()):
        v = _valid(df, c)
        aggs += [F.count(F.when((v < lo) | (v > hi), 1)).alias(f"o{i}"), F.min(v).alias(f"lo{i}"),
                 F.max(v).alias(f"hi{i}")]
    row = df.agg(*aggs)
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"o{i}").alias("out_of_range"),
                               F.lit(float(lo)).alias("expected_lo"), F.lit(float(hi)).alias("expected_hi"),
                               F.col(f"lo{i}").alias("actual_min"), F.col(f"hi{i}").alias("actual_max"))
                      for i, (c, (lo, hi)) in enumerate(rules.items())])
    out = row.select("_n", F.inline(items)).filter(F.col("out_of_range") > 0)
    return out.select("column", F.col("out_of_range").cast("bigint").alias("out_of_range"),
                      fround(F.col("out_of_range") / F.col("_n") * 100.0, 2).alias("pct"),
                      "expected_lo", "expected_hi",
                      fround("actual_min", 4).alias("actual_min"), fround("actual_max", 4).alias("actual_max"))


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first per key (a NULL key is one group); 1 row."""
    per_key = df.groupBy(*keys).count()
    return per_key.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def describe(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """E5: mean, sample std, min, quartiles (linear), max per feature (4 dp).

    Mean and deviation come from exact sums, quartiles from the radix selection in
    :mod:`chartwise.operators.quantiles`; minimum and maximum are its first and last rank.
    """
    cols = [c for c in (cols or AUDIO_FEATURES) if c in df.columns]
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    df = df.select(*cols)
    q = exact_quantiles(df, cols, probs)
    sums = exact_sums(df, {c: _valid(df, c) for c in cols}, [t for c in cols for t in ((c,), (c, c))])[()]
    rows = []
    for c in cols:
        one, squares = sums[c,], variance(sums[c,].n, sums[c,].total, sums[c, c].total, 1)
        low, *quartiles, high = (q[c, p] for p in probs)
        rows.append((c, number(one.mean), None if squares is None else math.sqrt(squares), low, *quartiles, high))
    out = df.sparkSession.createDataFrame(rows, "feature string, mean double, std double, min double, q25 double, median double, q75 double, max double").coalesce(1)
    return out.select("feature", *[fround(k, digits).alias(k)
                                   for k in ("mean", "std", "min", "q25", "median", "q75", "max")])


def class_balance(df: DataFrame, label: str = "charted") -> DataFrame:
    """Counts, % of rows (2 dp) and neg / max(pos, 1) ratio (2 dp); 1 row."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col(label) == 1, 1)).alias("c1"),
                 F.count(F.when(F.col(label) == 0, 1)).alias("c0"))
    c0 = F.when(F.col("c0") > 0, F.col("c0")).otherwise(F.lit(1))
    c1 = F.greatest(F.when(F.col("c1") > 0, F.col("c1")).otherwise(F.lit(1)), F.lit(1))
    return row.select(F.col("c1").cast("bigint").alias("charted_count"),
                      fround(F.col("c1") / F.col("_n") * 100.0, 2).alias("charted_pct"),
                      F.col("c0").cast("bigint").alias("non_charted_count"),
                      fround(F.col("c0") / F.col("_n") * 100.0, 2).alias("non_charted_pct"),
                      fround(c0.cast("double") / c1, 2).alias("imbalance_ratio"))


def category_breakdown(df: DataFrame, by: str = "genre", key: str = "track_id", label: str = "charted",
                       value: str = "popularity", digits: int = 4) -> DataFrame:
    """Per category: count(key), mean label, mean value (4 dp)."""
    return df.groupBy(by).agg(F.count(key).cast("bigint").alias("count"),
                              fround(F.avg(label), digits).alias("charted_rate"),
                              fround(F.avg(value), digits).alias("avg_popularity"))


def corr_table(df: DataFrame, cols: Sequence[str], target: str, null_policy: str = "pairwise",
               digits: int = 4) -> DataFrame:
    """Pearson r of each column with ``target`` in one pass.

    ``pairwise``: rows where both are present (NaN dropped); ``zero``: NULL
    features count as 0 (the reference's point-biserial form).  A constant
    side gives no r (row dropped) instead of a division error.
    """
    cols = [c for c in cols if c in df.columns]
    valid = {c: _valid(df, c) for c in cols}
    found, _ = correlations(df, valid if null_policy == "pairwise" else {c: F.coalesce(x, F.lit(0.0)) for c, x in valid.items()}, target)
    out = df.sparkSession.createDataFrame([(c, i, *found[c]) for i, c in enumerate(cols) if found[c][0] is not None],
                                          "feature string, ordinal int, r double, n long").coalesce(1)
    return out.select("feature", "ordinal", fround("r", digits).alias("r"), F.col("n").cast("bigint").alias("n"))


def quality_issues(nulls: DataFrame, ranges: DataFrame, dups: DataFrame, balance: DataFrame,
                   max_dups: int = MAX_DUPLICATES, max_null_pct: float = MAX_NULL_PCT,
                   max_range_pct: float = MAX_RANGE_PCT, max_imbalance: float = MAX_IMBALANCE) -> DataFrame:
    """One row per failed rule (kind, subject, value, message); the check passes with no rows."""
    d = dups.filter(F.col("duplicates") > max_dups).select(
        F.lit("duplicates").alias("kind"), F.lit("track_id").alias("subject"),
        F.col("duplicates").cast("double").alias("value"),
        F.concat(F.col("duplicates").cast("string"), F.lit(" rows repeat a key")).alias("message"))
    n = nulls.filter(F.col("pct") > max_null_pct).select(
        F.lit("missing").alias("kind"), F.col("column").alias("subject"), F.col("pct").alias("value"),
        F.concat(F.col("column"), F.lit(" lacks a value in "), F.col("pct").cast("string"), F.lit(" % of the rows")).alias("message"))
    r = ranges.filter(F.col("pct") > max_range_pct).select(
        F.lit("out_of_range").alias("kind"), F.col("column").alias("subject"), F.col("pct").alias("value"),
        F.concat(F.col("column"), F.lit(" leaves its range in "), F.col("pct").cast("string"), F.lit(" % of the rows")).alias("message"))
    b = balance.filter(F.col("imbalance_ratio") > max_imbalance).select(
        F.lit("imbalance").alias("kind"), F.lit("charted").alias("subject"), F.col("imbalance_ratio").alias("value"),
        F.concat(F.format_string("%.1f", F.col("imbalance_ratio")), F.lit(" negatives for each positive; oversampling may help")).alias("message"))
    return d.unionByName(n).unionByName(r).unionByName(b)
