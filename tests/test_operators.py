"""Operator properties on small hand-made frames and the test tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartwise.operators.abtest import ab_test
from chartwise.operators.graph import bfs_expand
from chartwise.operators.ingest import incremental_append, keep_first
from chartwise.operators.joins import hot_key_join
from chartwise.operators.learn import knn_exact, roc_auc, smote
from chartwise.operators import quantiles
from chartwise.operators.quantiles import exact_quantiles
from chartwise.operators.split import assign_by_rank, sample_n, stratified_split, stratified_sizes

from folders import SF_SMALL


def _ab_frame(spark):
    rows = [(i, int(i % 3 == 0), int(i % 7 == 0)) for i in range(3000)]
    return spark.createDataFrame(rows, "id int, a int, y int")


def test_ab_closed_form_and_symmetry(spark):
    df = _ab_frame(spark)
    r = ab_test(df, F.col("a") == 1, F.col("a") == 0, "y", "A", "B").first()
    a = df.filter("a = 1").agg(F.count("*"), F.sum("y")).first()
    b = df.filter("a = 0").agg(F.count("*"), F.sum("y")).first()
    ct = np.array([[a[1], a[0] - a[1]], [b[1], b[0] - b[1]]], dtype=float)
    exp = ct.sum(1, keepdims=True) * ct.sum(0, keepdims=True) / ct.sum()
    chi2 = ((ct - exp) ** 2 / exp).sum()
    assert r["chi2"] == pytest.approx(chi2, abs=1e-6)
    s = ab_test(df, F.col("a") == 0, F.col("a") == 1, "y", "B", "A").first()
    assert s["chi2"] == r["chi2"] and s["cohen_h"] == r["cohen_h"]


def test_ab_zero_cells(spark):
    df = spark.createDataFrame([(1, 0)] * 40 + [(0, 0)] * 40, "a int, y int")
    plain = ab_test(df, F.col("a") == 1, F.col("a") == 0, "y", "A", "B").first()
    clamped = ab_test(df, F.col("a") == 1, F.col("a") == 0, "y", "A", "B", clamp_cells=True).first()
    assert plain["chi2"] is None and plain["significant"] is False
    assert clamped["chi2"] == 0.0 and plain["winner"] == "B" and plain["lift"] is None


def test_exact_quantiles_with_heavy_ties(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([np.zeros(5000), rng.normal(size=10000), np.full(100, np.nan)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(7)
    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    q = exact_quantiles(df, ["x"], probs)
    clean = vals[~np.isnan(vals)]
    for p in probs:
        assert q[("x", p)] == pytest.approx(float(np.quantile(clean, p)), abs=1e-12)


def test_split_is_exact_partition_and_stable(spark):
    df = spark.range(5000).select("id", (F.col("id") % 37 == 0).cast("int").alias("y"))
    a = stratified_split(df, "id", "y")
    counts = {(r["split"], r["y"]): r["count"] for r in a.groupBy("split", "y").count().collect()}
    n1 = df.filter("y = 1").count()
    sizes = stratified_sizes({1: n1, 0: 5000 - n1})
    for c, (tr, va, te) in sizes.items():
        assert (counts.get(("train", c), 0), counts.get(("val", c), 0), counts.get(("test", c), 0)) == (tr, va, te)
    assert a.count() == 5000 and a.select("id").distinct().count() == 5000
    b = stratified_split(df.repartition(13), "id", "y")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_assign_by_rank_null_class(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(200)], "id int, c int")
    out = assign_by_rank(df, "c", "id", {None: [10], 0: [10], 1: [10]}, ["a", "b"])
    assert out.count() == 200
    assert out.filter("split = 'a'").count() == 30


def test_sample_n_exact(spark):
    df = spark.range(3000)
    assert sample_n(df, "id", 123).count() == 123
    big = sample_n(df, "id", 1500, seed=42)
    assert big.count() == 1500
    assert sorted(r[0] for r in big.collect()) == sorted(r[0] for r in sample_n(df, "id", 1500).collect())


def test_auc_ties_and_reversal(spark):
    rows = [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.5, 0), (0.5, 1)]
    df = spark.createDataFrame(rows, "s double, y int")
    a = roc_auc(df, "s", "y", rows_per_partition=2).first()["auc"]
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    exp = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert a == pytest.approx(exp, abs=1e-6)
    b = roc_auc(df.withColumn("s", -F.col("s")), "s", "y", rows_per_partition=2).first()["auc"]
    assert a + b == pytest.approx(1.0, abs=2e-6)


def test_keep_first_of_a_hot_key(spark):
    rows = [(1 if i % 3 else i, i % 11, i) for i in range(3000)]   # key 1 holds two thirds
    df = spark.createDataFrame(rows, "k int, o int, v int")
    a = keep_first(df, ["k"], ["o", "v"])
    first = {}
    for k, o, v in rows:
        first[k] = min(first.get(k, (o, v)), (o, v))
    assert sorted(map(tuple, a.collect())) == sorted((k, o, v) for k, (o, v) in first.items())


def test_hot_key_join_equals_join(spark):
    fact = spark.createDataFrame([(1 if i % 2 else i % 50, i) for i in range(2000)], "k int, v int")
    dim = spark.createDataFrame([(k, f"d{k}") for k in range(0, 40)], "k int, d string")
    a = hot_key_join(fact, dim, "k", "left", hot_min_rows=100)
    b = fact.join(dim, "k", "left")
    assert sorted(map(tuple, a.select("k", "v", "d").collect())) == sorted(map(tuple, b.select("k", "v", "d").collect()))


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(120, 8))
    df = spark.createDataFrame([(i, [float(x) for x in X[i]]) for i in range(120)], "id long, v array<double>")
    got = knn_exact(df, "id", "v", 4, block_rows=25)
    res = {}
    for r in got.collect():
        res.setdefault(r["id"], []).append((r["rank"], r["neighbor_id"]))
    for i in range(120):
        d = np.sqrt(((X - X[i]) ** 2).sum(1))
        d[i] = np.inf
        assert [n for _, n in sorted(res[i])] == list(np.lexsort((np.arange(120), d))[:4])


def test_smote_points_between_base_and_neighbour(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)], int(i < 12)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    s = smote(df, "id", "v", "y", minority=1, k=3)
    out = s.collect()
    assert len(out) == 48 - 12
    vec = {r[0]: np.array(r[1]) for r in rows}
    for r in out:
        a, b = vec[r["base_id"]], vec[r["neighbor_id"]]
        assert np.allclose(np.array(r["vector"]), a + r["gap"] * (b - a))
        assert 0.0 <= r["gap"] < 1.0


def test_bfs_caps_and_monotone(spark):
    edges = spark.createDataFrame([(i, i // 3) for i in range(300)] + [(i, 1000 + i % 40) for i in range(0, 300, 2)],
                                  "node long, hub long")
    seeds = spark.createDataFrame([(0,), (1,)], "node long")
    d1 = bfs_expand(edges, seeds, depth=1, per_hop=500, max_nodes=10_000)
    d2 = bfs_expand(edges, seeds, depth=2, per_hop=500, max_nodes=10_000)
    s1 = {r[0] for r in d1.collect()}
    s2 = {r[0] for r in d2.collect()}
    assert s1 <= s2
    capped = bfs_expand(edges, seeds, depth=3, per_hop=5, max_nodes=25)
    assert capped.count() == 25
    assert capped.select("node").distinct().count() == 25


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert df.columns == ["genre", "n", "charted", "avg_pop", "chart_rate"]


def test_stream_append_equals_batch(spark):
    from chartwise.plans.q_ingest import q_incremental_append
    from chartwise.plans.q_stream import q_stream_incremental_append
    a = q_incremental_append(spark, SF_SMALL).select("event_id", "value")
    b = q_stream_incremental_append(spark, SF_SMALL).select("event_id", "value")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_resolve_source_fallback(spark, tmp_path):
    from chartwise.sources.files import resolve_source
    missing = str(tmp_path / "nope.csv")
    pq = str(tmp_path / "ckpt.parquet")
    spark.range(5).write.parquet(pq)
    assert resolve_source(spark, [(missing, "csv"), (pq, "parquet")]).count() == 5
    with pytest.raises(FileNotFoundError):
        resolve_source(spark, [(missing, "csv")])


def test_block_topk_certified_matches_brute_force_with_duplicates():
    from chartwise.operators.neighbours import block_topk
    rng = np.random.default_rng(11)
    X = np.vstack([rng.normal(size=(200, 16)), np.zeros((30, 16)), rng.normal(size=(20, 16)) * 1e4])
    ids = np.arange(len(X), dtype=np.int64)
    q, n, d = block_topk(X, X, ids, ids, 5, True)
    for i in range(len(X)):
        full = np.sqrt(((X - X[i]) ** 2).sum(1))
        full[i] = np.inf
        exp = np.lexsort((ids, full))[:5]
        assert list(n[q == i]) == list(exp)


def test_join_artists_hot_key_path_equals_broadcast_path(spark):
    from chartwise.operators.prepare import join_artists
    tracks = spark.createDataFrame(
        [(str(i), "['S1']" if i % 3 == 0 else f"['S{i % 40}', 'S2']", i % 100) for i in range(3000)],
        "track_id string, artist_ids string, popularity int")
    artists = spark.createDataFrame([(f"S{i}", float(i * 10), "['x']", i) for i in range(1, 35)],
                                    "artist_id string, followers double, genres string, popularity int")
    a = join_artists(tracks, artists)                                          # broadcast
    b = join_artists(tracks, artists, broadcast_max_rows=5, hot_min_rows=500)  # hot-key split + shuffle
    assert a.columns == b.columns
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.count() == 3000


def test_rates_with_a_third_of_rows_in_one_group(spark):
    from chartwise.operators.rates import group_rates
    rows = [("hot" if i % 3 == 0 else f"g{i % 97}", i % 5 == 0) for i in range(9000)]
    df = spark.createDataFrame([(g, int(y)) for g, y in rows], "g string, y int").repartition(16)
    out = {r["g"]: (r["n"], r["positives"]) for r in group_rates(df, "g", "y").collect()}
    assert out["hot"] == (3000, sum(1 for i in range(0, 9000, 3) if i % 5 == 0))
    assert sum(n for n, _ in out.values()) == 9000


def test_exact_quantiles_refinement_rounds(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vals = np.concatenate([np.full(6000, 0.5), rng.exponential(size=12000), rng.integers(0, 5, 2000).astype(float)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(9)
    probs = [0.05, 0.3, 0.5, 0.77, 0.999]
    q = exact_quantiles(df, ["x"], probs)
    monkeypatch.setattr(quantiles, "KEEP", 0)  # all four passes
    assert exact_quantiles(df, ["x"], probs, keep=False) == q
    for p in probs:
        assert q[("x", p)] == pytest.approx(float(np.quantile(vals, p)), abs=1e-12)


def test_auc_grouped_many_partitions(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(np.round(rng.normal() + y * 0.7 * (g + 1), 2)), int(y))
            for g in range(3) for y in rng.integers(0, 2, 700)]
    df = spark.createDataFrame(rows, "g int, s double, y int")
    got = {r["g"]: r["auc"] for r in roc_auc(df, "s", "y", group=["g"], rows_per_partition=37).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")   # groups span Arrow batches
    try:
        got2 = {r["g"]: r["auc"] for r in roc_auc(df, "s", "y", group=["g"], rows_per_partition=500).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got2 == got
    for g in range(3):
        pos = np.array([s for gg, s, y in rows if gg == g and y == 1])
        neg = np.array([s for gg, s, y in rows if gg == g and y == 0])
        exp = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
        assert got[g] == pytest.approx(exp, abs=1e-6)
