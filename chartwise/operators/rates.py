"""Group -> n, positives, rate (E1) and the operators built on it:
exploded-dimension rates (H4, D3), top/bottom lists (G1), best bucket (E17).

Every grouping is a hash aggregate with map-side partial aggregation, so a
hot group costs one partial row per task, never one task for the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwise.functions.columns import fround, list_literal_elements
from chartwise.operators.joins import checked_broadcast


def group_rates(df: DataFrame, keys: Sequence[str] | str, label: str = "charted", min_n: int = 0,
                extra: dict | None = None, digits: int | None = None) -> DataFrame:
    """n = count(label), positives = sum(label), rate = positives / n, HAVING n >= min_n."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    aggs = [F.count(label).alias("n"), F.sum(label).cast("bigint").alias("positives")]
    aggs += [v.alias(k) for k, v in (extra or {}).items()]
    out = df.groupBy(*keys).agg(*aggs)
    rate = F.col("positives") / F.col("n")
    out = out.withColumn("rate", rate if digits is None else fround(rate, digits))
    return out.filter(F.col("n") >= min_n) if min_n else out


def explode_rates(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, list_col: str,
                  label: str = "charted", value: str | None = None, min_n: int = 0,
                  broadcast_max_rows: int = 1_000_000) -> DataFrame:
    """Rates per element of a list column on a dimension (e.g. genre of the primary artist).

    Facts are first reduced to one row per dimension key (n, positives, value
    sum/count); only that reduced table meets the exploded dimension, so the
    fan-out join runs on #keys x #elements rows instead of #facts x #elements,
    and a hot key is collapsed by partial aggregation before any shuffle.
    """
    per_key = facts.filter(F.col(fact_key).isNotNull()).groupBy(fact_key).agg(
        F.count(label).alias("_n"), F.sum(label).alias("_pos"),
        *([F.sum(value).alias("_vs"), F.count(value).alias("_vn")] if value else []))
    elems = (dim.select(F.col(dim_key).alias(fact_key),
                        F.explode(list_literal_elements(F.col(list_col))).alias("element"))
             .filter(F.col("element").isNotNull() & (F.col("element") != "")))
    joined = per_key.join(checked_broadcast(elems, broadcast_max_rows), fact_key, "inner")
    aggs = [F.sum("_n").cast("bigint").alias("n"), F.sum("_pos").cast("bigint").alias("positives")]
    if value:
        aggs.append((F.sum("_vs") / F.sum("_vn")).alias("avg_value"))
    out = joined.groupBy("element").agg(*aggs).withColumn("rate", F.col("positives") / F.col("n"))
    return out.filter(F.col("n") >= min_n) if min_n else out


def top_bottom(df: DataFrame, by: str, key: str, top: int = 15, bottom: int = 5) -> DataFrame:
    """G1: ``top`` rows by ``by`` desc and ``bottom`` rows by ``by`` asc (key breaks ties).

    Each side is a distributed TakeOrderedAndProject; no global window.
    """
    t = df.orderBy(F.desc(by), F.asc(key)).limit(top).withColumn("section", F.lit("top"))
    b = df.orderBy(F.asc(by), F.desc(key)).limit(bottom).withColumn("section", F.lit("bottom"))
    return t.unionByName(b)


def best_bucket(rates: DataFrame, label_col: str, rate_col: str, ordinal_col: str) -> DataFrame:
    """The first bucket (lowest ordinal) with the highest rate; 1 row."""
    return rates.agg(F.max_by(F.col(label_col), F.struct(F.col(rate_col), -F.col(ordinal_col))).alias("best"))


def flag_best(rates: DataFrame, rate_col: str, ordinal_col: str, partition: Sequence[str] = (),
              flag: str = "is_best") -> DataFrame:
    """Mark the first (lowest ordinal) maximum of ``rate_col`` on an aggregated table."""
    from pyspark.sql import Window
    w = Window.partitionBy(*partition) if partition else Window.partitionBy()
    best = F.max(F.struct(F.col(rate_col).alias("r"), (-F.col(ordinal_col)).alias("o"))).over(w)
    return rates.withColumn(flag, (best["r"] == F.col(rate_col)) & (-best["o"] == F.col(ordinal_col)))
