"""Table scans and the analog views that map the test star schema onto the
reference's shapes (raw tracks, artists, nested track records).

Every view is a lazy DataFrame built from the parquet tables, so filters and
column pruning of later operators reach the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def _s_id(c):
    return F.concat(F.lit("S"), F.col(c).cast("string"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order line summary: one row per l_orderkey (partial aggregation map-side).

    Money-like columns are summed as integer cents, so the per-order means are
    exact and identical in any engine (no dependence on summation order).
    """
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice"])

    def cents(c):
        return F.round(F.col(c) * 100).cast("bigint")
    g = li.groupBy("l_orderkey").agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("sq"), F.sum(cents("l_discount")).alias("sd"),
        F.sum(cents("l_tax")).alias("st"), F.sum(cents("l_extendedprice")).alias("sp"),
        F.count(F.lit(1)).alias("nl"), F.array_sort(F.collect_set(_s_id("l_suppkey"))).alias("sup"))
    n = F.col("nl").cast("double")
    return g.select("l_orderkey", (F.col("sq") / n).alias("q"), (F.col("sd") / n).alias("d100"),
                    (F.col("st") / n).alias("t100"), (F.col("sp") / n / 100.0).alias("p"),
                    F.col("sq").cast("double").alias("dur"), "nl", "sup")


def tracks_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference-shaped raw track table (source column names, list-literal ids).

    One row per order; audio features are per-order line averages, so orders
    without lines have NULL features, as the reference data has missing ones.
    """
    o = read_table(spark, sf_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
    lines = order_lines(spark, sf_dir)
    j = o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
    k = F.col("o_orderkey")
    ymd = F.date_format(F.col("o_orderdate"), "yyyy-MM-dd")
    return j.select(
        k.cast("string").alias("id"),
        F.concat(F.lit("Track#"), k.cast("string")).alias("name"),
        F.floor(F.col("o_totalprice") / 5000).cast("int").alias("popularity"),
        (F.col("dur") * 2400).cast("bigint").alias("duration_ms"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("explicit"),
        F.concat(F.lit("['"), F.array_join("sup", "', '"), F.lit("']")).alias("id_artists"),
        F.when(k % 4 == 0, F.substring(ymd, 1, 4)).otherwise(ymd).alias("release_date"),
        (F.col("q") / 50).alias("danceability"),
        (F.col("d100") / 10.0).alias("energy"),
        (F.col("o_custkey") % 12).cast("int").alias("key"),
        (F.lit(-60.0) + F.lit(62.0) * (F.col("p") / 105000)).alias("loudness"),
        (k % 2).cast("int").alias("mode"),
        ((k % 97) / 96.0).alias("speechiness"),
        ((k % 89) / 88.0).alias("acousticness"),
        ((k % 83) / 82.0).alias("instrumentalness"),
        ((F.col("o_custkey") % 79) / 78.0).alias("liveness"),
        (F.col("t100") / 8.0).alias("valence"),
        (F.lit(260.0) * (F.lit(1.0) - F.col("q") / 50)).alias("tempo"),
        F.least(F.col("nl"), F.lit(5)).cast("int").alias("time_signature"),
        F.when(F.col("o_orderstatus") == "F", "folk").when(F.col("o_orderstatus") == "O", "opera")
         .otherwise("pop").alias("genre"),
    )


def artists_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference-shaped artist table: followers as text (some unparsable), genres as list literal."""
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"])
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    key = F.col("s_suppkey")
    fol = F.floor(F.greatest(F.col("s_acctbal"), F.lit(0.0)) * 1000).cast("bigint").cast("string")
    return j.select(
        _s_id("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.when(key % 23 == 0, F.lit("n/a")).otherwise(fol).alias("followers"),
        F.when(key % 10 == 0, F.lit("[]"))
         .otherwise(F.concat(F.lit("['"), F.col("n_name"), F.lit("', '"), F.col("r_name"), F.lit("']"))).alias("genres"),
        (key % 100).cast("int").alias("popularity"),
    )


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bipartite incidence (part, order) that defines the part co-occurrence graph.

    Two parts are neighbours when one order holds both.  The graph is kept as
    incidence rows, never as all pairs, so traversal costs O(frontier degree).
    """
    return read_table(spark, sf_dir, "lineitem", ["l_partkey", "l_orderkey"]) \
        .select(F.col("l_partkey").alias("node"), F.col("l_orderkey").alias("hub"))
