"""Join helpers: broadcast only behind a proven size bound, split hot keys.

``dimension_join`` broadcasts the dimension side only after counting at
most ``max_rows + 1`` of its rows.  Beyond the bound, ``hot_key_join`` reads the facts once and shuffles
them by (key, salt): a hot key (one artist holding a third of the tracks) is spread over as many salts as its count
asks for, and only its dimension rows are copied, once a salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def row_count_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows (reads at most max_rows + 1)."""
    return df.limit(max_rows + 1).count() <= max_rows


def checked_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``broadcast(df)`` if its size is proven small, else ``df`` unchanged."""
    return F.broadcast(df) if row_count_at_most(df, max_rows) else df


def dimension_join(fact: DataFrame, dim: DataFrame, key: str, how: str = "inner",
                   broadcast_max_rows: int = 1_000_000, hot_min_rows: int = 1_000_000,
                   max_hot_keys: int = 1000) -> DataFrame:
    """Fact-to-dimension equi-join on ``key`` (same name on both sides).

    A dimension of at most ``broadcast_max_rows`` rows is broadcast; a larger
    one goes through :func:`hot_key_join`, so a key holding a third of the
    facts never lands in a single shuffle partition.
    """
    if row_count_at_most(dim, broadcast_max_rows):
        return fact.join(F.broadcast(dim), key, how)
    return hot_key_join(fact, dim, key, how, hot_min_rows, max_hot_keys)


def hot_key_join(fact: DataFrame, dim: DataFrame, key: str, how: str = "inner",
                 hot_min_rows: int = 1_000_000, max_hot_keys: int = 1000) -> DataFrame:
    """Equi-join on ``key`` in which hot keys are salted; one scan of the facts joins all keys.

    Hot keys are those holding at least ``hot_min_rows`` fact rows; a map-side-combined count over the key column finds
    them first, the ``max_hot_keys`` largest come to the driver. A row's salt is a hash of the whole row, so tasks that are
    run again deal alike. Null keys join nothing and are spread likewise.
    """
    if how not in ("inner", "left"):
        raise ValueError("hot_key_join supports inner and left joins")
    spark = fact.sparkSession
    hot = (fact.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") >= hot_min_rows)
           .orderBy(F.desc("count"), key).limit(max_hot_keys).collect())
    salts = spark.createDataFrame([(r[0], -(-r[1] // hot_min_rows) + 1) for r in hot], T.StructType([T.StructField("_hot", fact.schema[key].dataType), T.StructField("_salts", T.IntegerType())]))
    salts = F.broadcast(salts)  # at most max_hot_keys rows
    whole_row = F.xxhash64(*[F.col(c) for c in fact.columns if not isinstance(fact.schema[c].dataType, (T.MapType, T.VariantType))])
    spread = F.when(F.col("_salts").isNotNull(), F.pmod(whole_row, F.col("_salts"))).when(F.col(key).isNull(), F.pmod(whole_row, F.lit(1 << 20))).otherwise(0)
    left = fact.join(salts, F.col(key) == F.col("_hot"), "left").withColumn("_salt", spread.cast("int")).drop("_hot", "_salts")
    if how == "inner":
        left = left.filter(F.col(key).isNotNull())
    right = (dim.join(salts, F.col(key) == F.col("_hot"), "left")
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_hot", "_salts"))
    return left.join(right, [key, "_salt"], how).drop("_salt")
