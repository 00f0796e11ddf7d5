"""Operators whose work must stay bounded: pivots, radix selection, exact sums, rank cuts, salts, keyed state, shared passes."""

import math
import statistics
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartwise.operators import iterative, joins, moments, neighbours, quantiles, split
from chartwise.operators.iterative import GRID, kmeans, lloyd, logistic_newton, on_grid
from chartwise.operators.neighbours import knn_exact
from chartwise.operators.quantiles import exact_quantiles, ordered_bits, value_of
from chartwise.operators.split import assign_by_rank, sample_n, sample_per_class
from chartwise.functions.columns import uniform


# ------------------------------------------------------------- neighbours

def brute(ids, X, k):
    out = {}
    for i, x in zip(ids, X, strict=True):
        d = np.sqrt(((X - x) ** 2).sum(axis=1))
        near = sorted((float(d[j]), ids[j]) for j in range(len(ids)) if ids[j] != i)[:k]
        out |= {(i, r): (n, pytest.approx(v, abs=1e-9)) for r, (v, n) in enumerate(near, 1)}
    return out


def vectors(spark, ids, X, id_type="long"):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in zip(ids, X, strict=True)], f"id {id_type}, v array<double>")


def clustered(rng, n, dims=4):
    return rng.normal(size=(20, dims))[rng.integers(0, 20, n)] * 10 + rng.normal(size=(n, dims)) * 0.3


@pytest.mark.parametrize("kind", ["clustered", "spread", "copies", "grid", "few", "texts"])
def test_pivots_find_the_same_neighbours_as_brute_force(spark, kind):
    rng = np.random.default_rng(8)
    n, k, id_type = 600, 5, "long"
    ids = [int(i) for i in rng.permutation(5000)[:n]]
    X = {"clustered": lambda: clustered(rng, n), "spread": lambda: rng.normal(size=(n, 8)),
         "copies": lambda: np.where(np.arange(n)[:, None] % 3 == 0, 1.0, clustered(rng, n)),  # a third is one vector
         "grid": lambda: rng.integers(0, 5, (n, 2)).astype(float), "few": lambda: rng.normal(size=(n, 3)), "texts": lambda: clustered(rng, n)}[kind]()
    if kind == "few":
        ids, X = ids[:4], X[:4]
    if kind == "texts":
        ids, id_type = [f"id-{i}" for i in ids], "string"
    got = {(r["id"], r["rank"]): (r["neighbor_id"], r["distance"]) for r in knn_exact(vectors(spark, ids, X, id_type), "id", "v", k, block_rows=40).collect()}
    assert got == brute(ids, X, k)


def test_rows_without_a_vector_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0, 1.0]), (3, [0.0, 2.0])], "id long, v array<double>")
    assert sorted((r["id"], r["neighbor_id"]) for r in knn_exact(df, "id", "v", 2).collect()) == [(2, 3), (3, 2)]
    assert knn_exact(df.limit(0), "id", "v", 2).count() == 0


def test_visits_per_row_stay_flat_when_the_data_grow_tenfold(spark):
    rng = np.random.default_rng(9)

    def copies(n):
        rows = vectors(spark, list(range(n)), rng.uniform(size=(n, 2)))
        _, found = neighbours.own_blocks(rows, 5, 100, 42, True)
        return found.agg(F.avg(F.size("visits"))).first()[0]
    small, large = copies(1500), copies(15000)
    assert large < 1.3 * small + 1


# ---------------------------------------------------------------- quantiles

def test_ordered_bits_are_an_order():
    values = np.array([-math.inf, -1e300, -1.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, math.inf])
    keys = ordered_bits(values)
    assert (np.diff(keys.astype(object)) >= 0).all() and keys[4] == keys[5]
    assert [value_of(int(k)) for k in keys] == values.tolist()
    assert int(ordered_bits(np.array([math.nan]))[0]) > int(keys[-1])


def test_quantiles_take_at_most_four_passes_for_all_columns(spark, monkeypatch):
    rng = np.random.default_rng(10)
    X = np.stack([rng.normal(size=4000), rng.exponential(size=4000) * 1e-9, np.where(rng.random(4000) < 0.4, 7.0, rng.normal(size=4000)), rng.integers(-3, 3, 4000)], axis=1)
    df = spark.createDataFrame(X.tolist(), "a double, b double, c double, d double").repartition(6)
    passes = []
    digits, fetched = quantiles.digits, quantiles.fetched
    monkeypatch.setattr(quantiles, "digits", lambda *a: passes.append("digits") or digits(*a))
    monkeypatch.setattr(quantiles, "fetched", lambda *a: passes.append("fetched") or fetched(*a))
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    want = {(c, p): float(np.quantile(X[:, i], p)) for i, c in enumerate("abcd") for p in probs}
    assert exact_quantiles(df, list("abcd"), probs) == pytest.approx(want, rel=1e-15)
    assert passes == ["digits", "fetched"]
    passes.clear()
    monkeypatch.setattr(quantiles, "KEEP", 0)
    assert exact_quantiles(df, list("abcd"), probs) == pytest.approx(want, rel=1e-15)
    assert passes == ["digits"] * 4


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (math.nan,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5]) == {("x", 0.5): None}
    assert exact_quantiles(df.limit(0), ["x"], [0.5]) == {("x", 0.5): None}


# --------------------------------------------------------------------- sums

def test_sums_are_exact_and_free_of_order(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=900) * 10.0 ** rng.integers(-12, 12, 900), [1e15, -1e15, 0.1, 5e-324, -0.0]])
    y = rng.normal(size=len(x)) * 10.0 ** rng.integers(-6, 6, len(x))
    rows = [(i % 3, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(None, 1.0, 2.0), (0, None, 1.0), (1, math.nan, 1.0), (2, math.inf, 1.0)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    terms = [("x",), ("x", "x"), ("x", "y")]
    factors = {"x": F.col("x"), "y": F.col("y")}
    found = [moments.exact_sums(d, factors, terms, by=["g"]) for d in (df.coalesce(1), df.repartition(9))]
    assert found[0] == found[1]
    for g in (0, 1, 2, None):
        own = [(Fraction(a), Fraction(b)) for k, a, b in rows if k == g and a is not None and math.isfinite(a)]
        sums = found[0][g,]
        assert sums["x",] == (len(own), sum(a for a, _ in own))
        assert sums["x", "y"].n == len(own)
        # exact but for products below the smallest normal numbers
        assert abs(sums["x", "y"].total - sum(a * b for a, b in own)) < Fraction(1, 10 ** 290)
        assert abs(sums["x", "x"].total - sum(a * a for a, _ in own)) < Fraction(1, 10 ** 290)
    assert moments.exact_sums(df.limit(0), factors, terms) == {(): {t: (0, 0) for t in terms}}


def test_moments_match_the_statistics_module(spark):
    rng = np.random.default_rng(12)
    x = [float(v) for v in rng.normal(size=500) + 1e6]
    y = [float(v) for v in rng.normal(size=500)]
    s = moments.exact_sums(spark.createDataFrame(list(zip(x, y, strict=True)), "x double, y double"), {"x": F.col("x"), "y": F.col("y")},
                           [("x",), ("y",), ("x", "x"), ("y", "y"), ("x", "y")])[()]
    assert float(moments.variance(500, s["x",].total, s["x", "x"].total, 1)) == statistics.variance(x)
    r = moments.correlation(500, s["x",].total, s["y",].total, s["x", "x"].total, s["y", "y"].total, s["x", "y"].total)
    assert r == pytest.approx(statistics.correlation(x, y), abs=1e-9)


# -------------------------------------------------------------------- ranks

def order_of(df, key="id", seed=42):
    return [r[0] for r in df.select(key).orderBy(uniform(seed, F.col(key)), key).collect()]


@pytest.mark.parametrize("keep", [100_000, 3])
def test_samples_are_the_first_by_hash(spark, monkeypatch, keep):
    monkeypatch.setattr(split, "KEEP", keep)  # 3: the second histogram
    df = spark.range(3000).withColumn("c", F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 2))
    order = order_of(df)
    for n in (0, 1, 1234, 2999, 3000, 5000):
        assert sorted(r[0] for r in sample_n(df, "id", n).select("id").collect()) == sorted(order[:n])
    sizes = {None: 7, 0: 10_000, 1: 100}
    got = sample_per_class(df, "c", "id", sizes)
    for c, n in sizes.items():
        own = df.filter(F.col("c").eqNullSafe(F.lit(c)))
        assert sorted(r[0] for r in got.filter(F.col("c").eqNullSafe(F.lit(c))).select("id").collect()) == sorted(order_of(own)[:n])


def test_rank_cuts_neither_join_nor_shuffle_rows(spark):
    df = spark.range(2000).withColumn("c", F.col("id") % 2)
    out = assign_by_rank(df, "c", "id", {0: [100, 300], 1: [1, 2]}, ["a", "b", "d"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    counts = {(r["c"], r["split"]): r["count"] for r in out.groupBy("c", "split").count().collect()}
    assert counts == {(0, "a"): 100, (0, "b"): 200, (0, "d"): 700, (1, "a"): 1, (1, "b"): 1, (1, "d"): 998}


# -------------------------------------------------------------------- joins

@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_hot_key_is_spread_in_one_scan_of_the_facts(spark, tmp_path, how):
    rows = [(None if i % 11 == 0 else 7 if i % 3 else i % 200, i) for i in range(6000)]
    spark.createDataFrame(rows, "k int, x int").write.parquet(str(tmp_path / "facts"))
    fact = spark.read.parquet(str(tmp_path / "facts"))
    dim = spark.createDataFrame([(k, f"d{k}") for k in range(0, 150)] + [(7, "second")], "k int, name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = joins.hot_key_join(fact, dim, "k", how, hot_min_rows=300)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.split("Initial Plan")[0].count("FileScan") == 1
        got = sorted(map(tuple, out.select("k", "x", "name").collect()), key=repr)
        sizes = out.filter("k = 7").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == sorted(map(tuple, fact.join(F.broadcast(dim), "k", how).select("k", "x", "name").collect()), key=repr)
    assert out.columns == ["k", "x", "name"] and len(sizes) > 1


# --------------------------------------------------------------------- fits

def test_newton_finds_the_penalised_optimum(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=2000).round(1)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(1.3 * x - 2)))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y, strict=True)], "x double, y int").repartition(5)
    w, b = logistic_newton(df, "x", "y")
    p = 1 / (1 + np.exp(-(w * x + b)))
    assert abs((p - y).sum()) < 1e-6 and abs(((p - y) * x).sum() + w) < 1e-6
    assert logistic_newton(df.filter("y = 1"), "x", "y") == (0.0, 30.0)
    assert logistic_newton(df.limit(0), "x", "y") == (0.0, 0.0)


def test_restarts_share_passes_and_equal_plain_lloyd(spark, monkeypatch):
    rng = np.random.default_rng(14)
    X = np.rint(clustered(rng, 900, dims=3) * GRID) / GRID
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(X)], "id long, a double, b double, c double").repartition(4)
    starts = np.stack([X[rng.permutation(900)[:4]] for _ in range(5)])
    monkeypatch.setattr(iterative, "REST", 0.0)
    rows = on_grid(df, list("abc"))
    centres, cost = lloyd(rows, list("abc"), starts, rounds=6)
    again, _ = lloyd(rows.repartition(7), list("abc"), starts, rounds=6)
    assert np.array_equal(centres, again)
    for r in range(5):
        c = starts[r].copy()
        for _ in range(6):
            own = ((X[:, None, :] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.stack([X[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(4)])
        assert centres[r] == pytest.approx(c, abs=1e-9)
    best, least = kmeans(df, "id", list("abc"), 4, restarts=6)
    assert best.shape == (4, 3) and 0 < least <= cost.min() * 1.5
    assert kmeans(df, "id", list("abc"), 4, restarts=6)[1] == least


# ------------------------------------------------------------------- stream

def test_a_batch_reads_the_keys_that_it_holds(spark, tmp_path):
    """Twenty batches of as many new and old keys: what a batch reads of the state doesn't grow with what was written."""
    from chartwise.streaming.ingest import stream_dedup_append
    src, out, ckpt = (str(tmp_path / d) for d in ("src", "out", "ckpt"))
    rng = np.random.default_rng(15)
    seen, want, known = [], {}, []
    for batch in range(20):
        keys = [int(k) for k in rng.choice(seen, 50)] if seen else []
        new = list(range(batch * 1000, batch * 1000 + 400))
        rows = [(k, batch * 10_000 + i, f"b{batch}") for i, k in enumerate(keys + new + new[:100])]
        for k, t, v in rows:
            if k not in want:
                want[k] = (t, v)
        seen += new
        spark.createDataFrame(rows, "k long, t long, v string").coalesce(1).write.mode("append").parquet(f"{src}/f={batch}")
        q = stream_dedup_append(spark, src + "/*", spark.createDataFrame([], "k long, t long, v string").schema, "k", "t", out, ckpt, 1000)
        state = q.lastProgress["stateOperators"][0]
        known.append((state["numRowsTotal"], state["customMetrics"]["rocksdbTotalBytesRead"]))
    got = {r["k"]: (r["t"], r["v"]) for r in spark.read.parquet(out).collect()}
    assert got == want and spark.read.parquet(out).count() == len(want)
    assert known[-1][0] == len(want)
    assert known[-1][1] <= 2 * max(b for _, b in known[2:6]) + 20_000
