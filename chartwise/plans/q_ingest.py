"""Scan, sink, ingest, graph and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartwise.operators.graph import bfs_expand
from chartwise.operators.ingest import distinct_union, incremental_append, keep_first, last_wins
from chartwise.operators.split import sample_n, stratified_split
from chartwise.plans import views
from chartwise.plans.oracle_views import with_views
from chartwise.plans.registry import register
from chartwise.session import scratch_dir
from chartwise.sources.files import read_csv, write_csv
from chartwise.sources.tables import part_edges, read_table


def u_sql(seed, *parts):
    """DuckDB form of ``uniform(seed, ...)``: first 32 bits of md5('seed:p1:p2...') / 2^32."""
    s = " || ':' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"(CAST(('0x' || substr(md5({s}), 1, 8)) AS BIGINT) / 4294967296.0)"


@register("scan_parquet", """
SELECT event_id, ts, user_id, value FROM events WHERE event_type = 'purchase' AND value > 10.0""")
def q_scan_parquet(spark, sf):
    """Parquet scan with pushed-down filters and a pruned column set."""
    e = read_table(spark, sf, "events")
    return e.filter((F.col("event_type") == "purchase") & (F.col("value") > 10.0)) \
        .select("event_id", "ts", "user_id", "value")


CSV_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType()),
                           T.StructField("price", T.DoubleType()), T.StructField("day", T.DateType())])


@register("csv_roundtrip", """
SELECT o_orderkey AS id, 'Order "' || o_orderpriority || '", ' || chr(10) || o_orderstatus AS title, o_totalprice AS price,
  CAST(o_orderdate AS DATE) AS day FROM orders""")
def q_csv_roundtrip(spark, sf):
    """Write a CSV with quoted, comma-holding text to the shared scratch folder and read it back."""
    o = read_table(spark, sf, "orders")
    df = o.select(F.col("o_orderkey").alias("id"),
                  F.concat(F.lit('Order "'), F.col("o_orderpriority"), F.lit('", \n'), F.col("o_orderstatus")).alias("title"),
                  F.col("o_totalprice").alias("price"), F.col("o_orderdate").cast("date").alias("day"))
    path = scratch_dir(spark, "csv-roundtrip")
    write_csv(df, path)
    return read_csv(spark, path, CSV_SCHEMA, multi_line=True)


NESTED_SCHEMA = ("struct<id:string,name:string,artists:array<struct<id:string,name:string>>,"
                 "album:struct<name:string,release_date:string>,popularity:int,explicit:boolean,"
                 "duration_ms:bigint,available_markets:array<string>>")


def packed_tracks(spark, sf):
    """Nested track records as JSON text, one per order (artists = its line suppliers, in line order)."""
    o = read_table(spark, sf, "orders")
    li = read_table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag"])
    arts = li.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_returnflag"))).alias("lines"))
    j = o.join(arts, o.o_orderkey == arts.l_orderkey, "left")
    rec = F.struct(
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat(F.lit("Track#"), F.col("o_orderkey").cast("string")).alias("name"),
        F.transform("lines", lambda x: F.struct(F.concat(F.lit("S"), x["l_suppkey"].cast("string")).alias("id"),
                                                F.concat(F.lit("Supplier#"), x["l_suppkey"].cast("string")).alias("name")))
         .alias("artists"),
        F.struct(F.col("o_orderstatus").alias("name"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("release_date"))
         .alias("album"),
        F.floor(F.col("o_totalprice") / 5000).cast("int").alias("popularity"),
        (F.col("o_orderpriority") == "1-URGENT").alias("explicit"),
        F.when(F.col("lines").isNotNull(), F.size("lines") * 60000).cast("bigint").alias("duration_ms"),
        F.transform(F.filter("lines", lambda x: x["l_returnflag"] != "N"), lambda x: x["l_returnflag"])
         .alias("available_markets"))
    return j.select(F.to_json(rec).alias("json"))


@register("nested_flatten", """
SELECT CAST(o.o_orderkey AS VARCHAR) AS track_id, 'Track#' || CAST(o.o_orderkey AS VARCHAR) AS track_name,
  coalesce(l.names, '') AS artist_names, coalesce(l.ids, '') AS artist_ids, o.o_orderstatus AS album_name,
  strftime(o.o_orderdate, '%Y-%m-%d') AS release_date, CAST(floor(o.o_totalprice / 5000) AS INTEGER) AS popularity,
  CASE WHEN o.o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS explicit,
  CAST(coalesce(l.n, 0) * 60000 AS BIGINT) AS duration_ms, CAST(coalesce(l.m, 0) AS INTEGER) AS markets_count
FROM orders o LEFT JOIN (
  SELECT l_orderkey, string_agg('Supplier#' || CAST(l_suppkey AS VARCHAR), ', ' ORDER BY l_linenumber, l_suppkey, l_returnflag) AS names,
    string_agg('S' || CAST(l_suppkey AS VARCHAR), ', ' ORDER BY l_linenumber, l_suppkey, l_returnflag) AS ids,
    count(*) AS n, count(*) FILTER (WHERE l_returnflag <> 'N') AS m
  FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey""")
def q_nested_flatten(spark, sf):
    """Parse nested JSON track records and flatten artists, album, flags and market counts."""
    from chartwise.operators.ingest import flatten_track_json
    return flatten_track_json(packed_tracks(spark, sf), "json", NESTED_SCHEMA)


@register("json_props", """
SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events""")
def q_json_props(spark, sf):
    """Typed field from a JSON text column (events.props)."""
    e = read_table(spark, sf, "events", ["event_id", "event_type", "props"])
    return e.select("event_id", "event_type", F.from_json("props", "k int")["k"].alias("k"))


def _membership(spark, sf):
    """Playlist membership analog: (playlist ordinal, genre, track) from returned line items."""
    li = read_table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag"])
    return li.filter(F.col("l_returnflag") == "R").select(
        F.col("l_orderkey").cast("string").alias("track_id"), F.col("l_linenumber").alias("playlist_ordinal"),
        F.concat(F.lit("pl"), F.col("l_linenumber").cast("string"), F.col("l_linestatus")).alias("genre"))


LAST_WINS_SQL = """
SELECT t.track_id, coalesce(m.genre, CASE WHEN t.expansion THEN 'mixed' ELSE 'unknown' END) AS genre
FROM (SELECT CAST(o_orderkey AS VARCHAR) AS track_id, o_orderstatus = 'P' AS expansion FROM orders) t
LEFT JOIN (SELECT track_id, max({'o': playlist_ordinal, 'g': genre}).g AS genre FROM (
    SELECT CAST(l_orderkey AS VARCHAR) AS track_id, l_linenumber AS playlist_ordinal,
      'pl' || CAST(l_linenumber AS VARCHAR) || l_linestatus AS genre FROM lineitem WHERE l_returnflag = 'R')
  GROUP BY track_id) m ON m.track_id = t.track_id"""


@register("last_wins_lookup", LAST_WINS_SQL)
def q_last_wins_lookup(spark, sf):
    """Genre per track: the last playlist wins; expansion-only tracks 'mixed', others 'unknown'."""
    lookup = last_wins(_membership(spark, sf), "track_id", "playlist_ordinal", "genre")
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_orderstatus"]).select(
        F.col("o_orderkey").cast("string").alias("track_id"), (F.col("o_orderstatus") == "P").alias("expansion"))
    j = o.join(lookup, "track_id", "left")
    return j.select("track_id", F.coalesce("genre", F.when(F.col("expansion"), "mixed").otherwise("unknown")).alias("genre"))


@register("inner_features", with_views(["tracks_raw"], f"""
SELECT m.id AS track_id, m.popularity, m.explicit, m.release_date, a.danceability, a.energy, a.valence,
  g.genre, CASE WHEN m.popularity >= 70 THEN 1 ELSE 0 END AS charted
FROM (SELECT id, popularity, explicit, release_date FROM tracks_raw) m
JOIN (SELECT id, danceability, energy, valence FROM tracks_raw WHERE danceability IS NOT NULL) a ON a.id = m.id
JOIN ({LAST_WINS_SQL}) g ON g.track_id = m.id"""))
def q_inner_features(spark, sf):
    """Metadata INNER JOIN audio features on the id, then the last-wins genre and the label."""
    from chartwise.sources.tables import tracks_raw
    raw = tracks_raw(spark, sf)
    meta = raw.select("id", "popularity", "explicit", "release_date")
    audio = raw.filter(F.col("danceability").isNotNull()).select("id", "danceability", "energy", "valence")
    j = meta.join(audio, "id", "inner").withColumnRenamed("id", "track_id")
    g = q_last_wins_lookup(spark, sf)
    return j.join(g, "track_id", "inner").withColumn("charted", (F.col("popularity") >= 70).cast("int"))


@register("distinct_union", """
SELECT o_custkey AS id FROM orders WHERE o_orderpriority = '1-URGENT'
UNION
SELECT c_custkey FROM customer WHERE c_acctbal > 5000""")
def q_distinct_union(spark, sf):
    """Distinct union of two id sets (urgent buyers, rich customers)."""
    a = read_table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("id"))
    b = read_table(spark, sf, "customer").filter(F.col("c_acctbal") > 5000).select(F.col("c_custkey").alias("id"))
    return distinct_union(a, b)


def _event_batches(spark, sf):
    """Two overlapping ingest batches over the whole events table, cut at 60 % and 40 % of its time span.

    The cut-offs are scalar subqueries evaluated by Spark (no timestamp passes
    through Python, so the session time zone cannot shift them).
    """
    e = read_table(spark, sf, "events", ["event_id", "ts", "user_id", "event_type", "value"])

    def cut(frac):
        return e.agg((F.min("ts") + (F.max("ts") - F.min("ts")) * F.lit(frac)).alias("t")).scalar()
    existing = e.filter(F.col("ts") < cut(0.6))
    incoming = e.filter(F.col("ts") >= cut(0.4)).withColumn("value", F.col("value") * 2.0)
    return existing, incoming


EVENT_BATCHES_SQL = """
bounds AS (SELECT min(ts) AS a, max(ts) AS b FROM events),
existing AS (SELECT event_id, ts, user_id, event_type, value FROM events, bounds WHERE ts < a + (b - a) * 0.6),
incoming AS (SELECT event_id, ts, user_id, event_type, value * 2.0 AS value FROM events, bounds WHERE ts >= a + (b - a) * 0.4)"""


@register("incremental_append", "WITH " + EVENT_BATCHES_SQL.strip() + """
SELECT * FROM existing
UNION ALL
SELECT * FROM incoming WHERE event_id NOT IN (SELECT event_id FROM existing)""")
def q_incremental_append(spark, sf):
    """Resume an ingest: skip known ids, append the rest, keep the first row per id."""
    existing, incoming = _event_batches(spark, sf)
    return incremental_append(existing, incoming, "event_id", order_col="ts")


@register("dedup_keep_first", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1""")
def q_dedup_keep_first(spark, sf):
    """One line per (order, line number): the earliest shipped (then smallest part, supplier, quantity)."""
    li = read_table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                                             "l_quantity"])
    return keep_first(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity"])


def _bfs_sql(depth=2, per_hop=500, max_nodes=5000, seed=42):
    ctes = ["inc AS (SELECT l_partkey AS node, l_orderkey AS hub FROM lineitem WHERE l_partkey IS NOT NULL AND l_orderkey IS NOT NULL)",
            "v0 AS (SELECT DISTINCT p_partkey AS node, 0 AS depth FROM part WHERE p_size = 1 AND p_partkey IS NOT NULL)",
            "f0 AS (SELECT node FROM v0)"]
    for d in range(1, depth + 1):
        ctes += [
            f"e{d} AS (SELECT node, row_number() OVER (ORDER BY u, node) AS prank FROM (SELECT node, {u_sql(seed, d, 'node')} AS u "
            f"FROM f{d - 1} ORDER BY u, node LIMIT {per_hop}))",
            f"h{d} AS (SELECT i.hub, min(e.prank) AS prank FROM e{d} e JOIN inc i ON i.node = e.node GROUP BY i.hub)",
            f"c{d} AS (SELECT i.node, min(h.prank) AS prank FROM h{d} h JOIN inc i ON i.hub = h.hub GROUP BY i.node)",
            f"n{d} AS (SELECT node, {d} AS depth FROM (SELECT node, row_number() OVER (ORDER BY prank, "
            f"{u_sql(seed, repr('c'), d, 'node')}, node) AS r FROM c{d} WHERE node NOT IN (SELECT node FROM v{d - 1})) "
            f"WHERE r <= {max_nodes} - (SELECT count(*) FROM v{d - 1}))",
            f"v{d} AS (SELECT * FROM v{d - 1} UNION ALL SELECT * FROM n{d})",
            f"f{d} AS (SELECT node FROM n{d})"]
    return "WITH " + ",\n".join(ctes) + f"\nSELECT node, depth FROM v{depth}"


@register("bfs_expand", _bfs_sql())
def q_bfs_expand(spark, sf):
    """Two-hop expansion of the part co-occurrence graph from the size-1 parts (500 per hop, 5,000 max)."""
    seeds = read_table(spark, sf, "part", ["p_partkey", "p_size"]).filter(F.col("p_size") == 1) \
        .select(F.col("p_partkey").alias("node"))
    return bfs_expand(part_edges(spark, sf), seeds, depth=2, per_hop=500, max_nodes=5000, seed=42)


@register("bfs_unbounded", """
WITH inc AS (SELECT DISTINCT l_partkey AS node, l_orderkey AS hub FROM lineitem WHERE l_partkey IS NOT NULL AND l_orderkey IS NOT NULL),
v0 AS (SELECT DISTINCT p_partkey AS node FROM part WHERE p_partkey <= 20),
n1 AS (SELECT DISTINCT b.node FROM inc a JOIN inc b USING (hub) WHERE a.node IN (SELECT node FROM v0) AND b.node NOT IN (SELECT node FROM v0)),
v1 AS (SELECT node FROM v0 UNION ALL SELECT node FROM n1),
n2 AS (SELECT DISTINCT b.node FROM inc a JOIN inc b USING (hub) WHERE a.node IN (SELECT node FROM n1) AND b.node NOT IN (SELECT node FROM v1))
SELECT node, 0 AS depth FROM v0 UNION ALL SELECT node, 1 FROM n1 UNION ALL SELECT node, 2 FROM n2""")
def q_bfs_unbounded(spark, sf):
    """Every part within two hops of the first twenty parts, without bounds."""
    seeds = read_table(spark, sf, "part", ["p_partkey"]).filter(F.col("p_partkey") <= 20).select(F.col("p_partkey").alias("node"))
    return bfs_expand(part_edges(spark, sf), seeds, depth=2)


def _split_sql(seed=42):
    return with_views(["tracks"], f"""
SELECT t.track_id, t.charted,
  CASE WHEN r < s.tr THEN 'train' WHEN r < s.tr + s.va THEN 'val' ELSE 'test' END AS split
FROM (SELECT track_id, charted, row_number() OVER (PARTITION BY charted ORDER BY {u_sql(seed, 'track_id')}, track_id) - 1 AS r
      FROM tracks) t JOIN sizes s ON s.c = t.charted""", extra_ctes="""
cls AS (SELECT charted AS c, count(*) AS nc FROM tracks GROUP BY charted),
tot AS (SELECT sum(nc) AS n, CAST(ceil(0.15::DOUBLE * sum(nc)) AS BIGINT) AS n_test FROM cls),
a1 AS (SELECT c, nc, nc / n * (n - n_test) AS cont, n - n_test AS n_tv FROM cls, tot),
a2 AS (SELECT *, floor(cont) AS fl, row_number() OVER (ORDER BY cont - floor(cont) DESC, c) AS rk FROM a1),
tv AS (SELECT c, nc, n_tv, CAST(fl AS BIGINT) + CASE WHEN rk <= n_tv - (SELECT sum(fl) FROM a2) THEN 1 ELSE 0 END AS tvc FROM a2),
nv AS (SELECT max(n_tv) AS n_tv, CAST(ceil(0.15::DOUBLE / (1.0::DOUBLE - 0.15::DOUBLE) * max(n_tv)) AS BIGINT) AS n_val FROM tv),
b1 AS (SELECT c, nc, tvc, tvc / nv.n_tv * (nv.n_tv - nv.n_val) AS cont, nv.n_tv - nv.n_val AS n_train FROM tv, nv),
b2 AS (SELECT *, floor(cont) AS fl, row_number() OVER (ORDER BY cont - floor(cont) DESC, c) AS rk FROM b1),
sizes AS (SELECT c, CAST(fl AS BIGINT) + CASE WHEN rk <= n_train - (SELECT sum(fl) FROM b2) THEN 1 ELSE 0 END AS tr,
  tvc - (CAST(fl AS BIGINT) + CASE WHEN rk <= n_train - (SELECT sum(fl) FROM b2) THEN 1 ELSE 0 END) AS va FROM b2)""")


@register("stratified_split", _split_sql())
def q_stratified_split(spark, sf):
    """Exact-size stratified 70/15/15 split of the tracks by the label (seed 42)."""
    t = views.tracks(spark, sf).select("track_id", "charted")
    return stratified_split(t, "track_id", "charted", 0.15, 0.15, seed=42)


@register("split_sizes", f"SELECT split, charted, CAST(count(*) AS BIGINT) AS n FROM ({_split_sql()}) GROUP BY split, charted")
def q_split_sizes(spark, sf):
    """Rows per (split, class) of the stratified split."""
    return q_stratified_split(spark, sf).groupBy("split", "charted").agg(F.count(F.lit(1)).alias("n"))


@register("sample_n", with_views(["tracks"], f"""
SELECT track_id, popularity, charted FROM tracks ORDER BY {u_sql(42, 'track_id')}, track_id LIMIT 2000"""))
def q_sample_n(spark, sf):
    """2,000 tracks without replacement, deterministic in the seed."""
    t = views.tracks(spark, sf).select("track_id", "popularity", "charted")
    return sample_n(t, "track_id", 2000, seed=42)


@register("write_splits", _split_sql())
def q_write_splits(spark, sf):
    """Write all splits as parquet partitioned by split, and read them back."""
    from chartwise.sources.files import write_partitioned
    t = views.tracks(spark, sf).select("track_id", "charted")
    s = stratified_split(t, "track_id", "charted")
    path = scratch_dir(spark, "splits")
    write_partitioned(s, path, "split")
    return spark.read.parquet(path)


@register("source_fallback", "SELECT r_regionkey, r_name FROM region")
def q_source_fallback(spark, sf):
    """The first source that exists: two absent candidates, then the region table."""
    from chartwise.sources.files import resolve_source
    base = sf.rstrip("/")
    return resolve_source(spark, [(f"{base}/absent.csv", "csv"), (f"{base}/absent.parquet", "parquet"), (f"{base}/region.parquet", "parquet")]).select("r_regionkey", "r_name")
