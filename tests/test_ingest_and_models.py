"""Streaming ingest without loss, the fitted preparation, text keys, label codes, null groups and plan shapes."""

import contextlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartwise.functions.columns import uniform
from chartwise.operators.encode import label_encode
from chartwise.operators.graph import bfs_expand
from chartwise.operators.ingest import incremental_append, keep_first
from chartwise.operators.joins import hot_key_join
from chartwise.operators.learn import roc_auc, smote
from chartwise.operators.models import Training, evaluate, load_scorer, score
from chartwise.operators.permutation import permutation_importance, permuted, row_numbers, runs, shift_of
from chartwise.operators.preparation import Preparation, read_meta
from chartwise.plans import ORACLES, QUERIES, views
from chartwise.session import scratch_dir
from chartwise.streaming.ingest import stream_dedup_append

from folders import SF_SMALL


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_stream_keeps_the_first_row_however_late(spark):
    shape = T.StructType([T.StructField("k", T.StringType()), T.StructField("ts", T.StringType()), T.StructField("v", T.IntegerType())])
    landing, out, mark = (scratch_dir(spark, n) for n in ("late-in", "late-out", "late-mark"))
    batches = [[("a", "2024-01-01", 1), ("b", "2024-01-03", 2), ("b", "2024-01-02", 3)],   # two rows of a key in a batch
               [("c", "1990-01-01", 4), ("a", "2029-01-01", 5), (None, "2024-01-01", 6)],  # late; a repeat years on; a null key
               [(None, "2023-01-01", 7), ("c", "1980-01-01", 8), ("d", "2024-01-01", 9)]]
    for i, rows in enumerate(batches):  # each landing restarts the query
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(f"{landing}/part={i}")
        stream_dedup_append(spark, landing, shape, "k", "ts", out, mark)
    got = {(r["k"], r["v"]) for r in spark.read.parquet(out).collect()}
    assert got == {("a", 1), ("b", 3), ("c", 4), (None, 6), ("d", 9)}


def test_append_leaves_existing_rows_alone(spark):
    old = spark.createDataFrame([(i, i % 7) for i in range(100)], "k int, v int")
    new = spark.createDataFrame([(i, -i) for i in range(90, 110)] + [(105, -999), (None, 1), (None, 2)], "k int, v int")
    got = {(r["k"], r["v"]) for r in incremental_append(old, new, "k", "v").collect()}
    assert got == {(i, i % 7) for i in range(100)} | {(i, -i) for i in range(100, 110) if i != 105} | {(105, -999), (None, 1)}
    text = plan(incremental_append(old, new, "k", "v"))
    assert text.count("SortAggregate") + text.count("HashAggregate") <= 2 * 2  # one aggregate, of the new rows


def test_keep_first_carries_each_column_once(spark):
    df = spark.createDataFrame([(1, 2, "x", 3.0)], "k int, o int, a string, b double")
    text = plan(keep_first(df, ["k"], ["o"]))
    assert "min(struct(o" in text and "_row" not in text and "Window" not in text


def test_label_codes_of_many_values(spark):
    values = [f"v{i:06d}" for i in range(20_000)]
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 5 + [("v000000",)] * 9000, "g string").repartition(7)
    out, mapping = label_encode(df, "g")
    assert mapping.count() == 20_000 and out.count() == df.count()
    assert out.filter("g IS NOT NULL AND g_enc <> CAST(substr(g, 2) AS INT)").count() == 0
    assert out.filter("g IS NULL AND g_enc IS NOT NULL").count() == 0


def test_auc_of_a_null_group(spark):
    df = spark.createDataFrame([("a", 0.1, 0), ("a", 0.9, 1), (None, 0.9, 0), (None, 0.1, 1)], "g string, s double, y int")
    assert {r["g"]: r["auc"] for r in roc_auc(df, "s", "y", group=["g"]).collect()} == {"a": 1.0, None: 0.0}


def test_null_keys_stay_out_of_the_shuffle(spark):
    fact = spark.createDataFrame([(None, i) for i in range(500)] + [(i % 5, i) for i in range(100)], "k int, v int")
    dim = spark.createDataFrame([(k, f"d{k}") for k in range(4)], "k int, d string")
    for how in ("left", "inner"):
        got = sorted(map(str, hot_key_join(fact, dim, "k", how, hot_min_rows=10).collect()))
        assert got == sorted(map(str, fact.join(dim, "k", how).collect()))


def test_smote_of_text_keys(spark):
    rng = np.random.default_rng(3)
    rows = [(f"track-{i:03d}", int(i < 20), [float(x) for x in rng.normal(size=3)]) for i in range(80)]
    df = spark.createDataFrame(rows, "id string, y int, v array<double>")
    out = smote(df, "id", "v", "y").collect()
    vectors = {r[0]: np.array(r[2]) for r in rows}
    assert len(out) == 40
    for r in out:
        a, b = vectors[r["base_id"]], vectors[r["neighbor_id"]]
        assert np.allclose(r["vector"], a + r["gap"] * (b - a))


def test_unbounded_search_finds_everything(spark):
    edges = spark.createDataFrame([(i, i // 2) for i in range(40)] + [(i + 1, i // 2) for i in range(40)], "node int, hub int")
    seeds = spark.createDataFrame([(0,)], "node int")
    assert bfs_expand(edges, seeds, depth=50).count() == 41


def test_preparation_is_the_published_layout(spark):
    t = views.tracks(spark, SF_SMALL).withColumn("time_signature", F.expr("element_at(array(0, 1, 3, 4, 5), 1 + pmod(hash(track_id), 5))"))
    ones = [f for f in Preparation.fit(t).features if f.startswith(("key_", "ts_"))]
    assert ones == [*[f"key_{i}" for i in range(1, 12)], "ts_1", "ts_3", "ts_4", "ts_5"]


def test_preparation_keeps_codes_on_other_frames(spark):
    t = views.tracks(spark, SF_SMALL)
    path = scratch_dir(spark, "prep")
    fitted = Preparation.fit(t)
    fitted.save(path, n_train=7)
    ready = Preparation.load(spark, path)
    assert ready.features == fitted.features and read_meta(spark, path)["n_train"] == 7
    codes = {r["category"]: r["code"] for r in ready.genres.collect()}
    known = sorted(codes)[-1]
    other = spark.createDataFrame([("x", known, 0.5), ("y", "never seen", 0.5), ("z", None, None)], "track_id string, genre string, energy double")
    got = {r["row_key"]: r for r in ready.transform(other).collect()}
    assert set(ready.features) <= set(got["x"].asDict())
    assert got["x"]["genre_enc"] == codes[known] and got["y"]["genre_enc"] is None
    assert got["z"]["genre_enc"] == (codes.get("unknown")) and got["z"]["energy"] == pytest.approx(ready.medians["energy"])
    assert got["x"]["danceability"] == 0.0


def test_training_saves_the_chosen_model(spark):
    small = {"rf": {"numTrees": 5, "maxDepth": 4}, "gbt": {"maxIter": 3, "maxDepth": 2}}
    t = views.tracks(spark, SF_SMALL, round_to=True)
    run = Training(t, small, fit_rows=400)
    path = scratch_dir(spark, "saved")
    kind = run.save(path)
    meta, scorer = load_scorer(spark, path)
    assert meta["best_model"] == kind == run.best()[0] and meta["feature_cols"] == run.feats
    assert meta["n_train"] + meta["n_val"] + meta["n_test"] == t.count()
    scored = scorer(t)
    assert scored.count() == t.count() and scored.filter("score < 0 OR score > 1 OR score IS NULL").count() == 0
    held = run.split.filter("split = 'val'").drop("split")
    drops = permutation_importance(lambda df: score(run.model("rf"), df), held, run.feats, "row_key", "charted")
    assert {r["feature"] for r in drops.collect()} == set(run.feats)
    for oversample in (True,):
        assert run.model("gbt", oversample).stages[-1].getNumTrees == 3


@pytest.mark.parametrize("fit_rows", [300, None])
def test_saved_metadata_tell_fitted_rows_from_the_split(spark, fit_rows):
    run = Training(views.tracks(spark, SF_SMALL, round_to=True), {"rf": {"numTrees": 2, "maxDepth": 2}, "gbt": {"maxIter": 1, "maxDepth": 2}}, fit_rows=fit_rows)
    path = scratch_dir(spark, "saved")
    run.save(path)
    meta, _ = load_scorer(spark, path)
    counts = {r["charted"]: r["count"] for r in run.train.groupBy("charted").count().collect()}
    taken = {c: min(n, fit_rows or n) for c, n in counts.items()}
    assert meta["fit_rows"] == fit_rows and meta["n_fit"] == sum(taken.values()) <= meta["n_train"]
    assert meta["charted_rate_fit"] == round(taken[1] / meta["n_fit"], 4)


def labelled(spark, n=3000):
    """Prepared-looking tracks whose label depends on two features; some 6 % positive."""
    t = views.tracks(spark, SF_SMALL, round_to=True)
    grown = t.withColumn("_c", F.explode(F.sequence(F.lit(1), F.lit(1 + n // max(1, t.count()))))).withColumn("track_id", F.concat_ws("-", "track_id", "_c")).drop("_c")
    u = uniform(3, F.lit("e"), F.col("track_id"))
    return (grown.withColumn("energy", F.round(u, 6)).withColumn("valence", F.round(uniform(3, F.lit("v"), F.col("track_id")), 6))
            .withColumn("charted", (F.col("energy") * 0.7 + F.col("valence") * 0.3 > 0.85).cast("int")))


def test_fitted_models_beat_chance_and_repeat(spark):
    small = {"rf": {"numTrees": 12, "maxDepth": 6}, "gbt": {"maxIter": 8, "maxDepth": 3}}
    t = labelled(spark).checkpoint()
    first, again = Training(t, small, fit_rows=300), Training(t.repartition(5), small, fit_rows=300)
    held = first.split.filter("split = 'test'")
    for kind in ("rf", "gbt"):
        auc = evaluate(first.model(kind), held).first()["auc"]
        assert auc > 0.9
        a, b = (sorted((r["row_key"], round(r["score"], 9)) for r in score(run.model(kind), run.split.filter("split = 'test'")).select("row_key", "score").collect()) for run in (first, again))
        assert [k for k, _ in a] == [k for k, _ in b]
        assert evaluate(again.model(kind), again.split.filter("split = 'test'")).first()["auc"] == pytest.approx(auc, abs=0.05)


def test_model_queries_run_on_one_training(spark, monkeypatch):
    from chartwise.plans import q_models
    monkeypatch.setattr(q_models, "PARAMS", {"rf": {"numTrees": 3, "maxDepth": 3}, "gbt": {"maxIter": 2, "maxDepth": 2}})
    monkeypatch.setattr(q_models, "_TRAINED", {})
    n = views.tracks(spark, SF_SMALL).count()
    got = {name: QUERIES[name](spark, SF_SMALL).collect() for name in ("rf_train", "gbt_train", "smote_rf_train", "best_model", "importance_rank", "permutation_importance",
                                                                      "batch_score", "score_sparse", "stream_score", "model_results")}
    run = next(iter(q_models._TRAINED.values()))
    assert all({r["split"] for r in got[name]} == {"val", "test"} for name in ("rf_train", "gbt_train", "smote_rf_train"))
    assert len(got["importance_rank"]) == len(got["permutation_importance"]) == len(run.feats)
    assert len(got["batch_score"]) == len(got["score_sparse"]) == len(got["stream_score"]) == n
    numbers = {(r["section"], r["id"], r["metric"]): r["number"] for r in got["model_results"]}
    assert {s for s, _, _ in numbers} == {"split", "rf.metrics", "rf.importances", "gbt.metrics", "gbt.importances"}
    for kind in ("rf", "gbt"):
        of = {r["split"]: r for r in got[f"{kind}_train"]}
        for split in ("val", "test"):
            assert all(numbers[f"{kind}.metrics", split, m] == pytest.approx(of[split][m]) for m in ("tn", "fp", "fn", "tp", "accuracy"))


def test_oversampling_draws_from_all_positive_train_rows(spark):
    run = Training(labelled(spark, 1500).checkpoint(), {"rf": {"numTrees": 2, "maxDepth": 2}}, fit_rows=None)
    rows = run.rows("rf", True)
    counts = {r["charted"]: r["count"] for r in rows.groupBy("charted").count().collect()}
    assert counts[0] == counts[1] == run.counts[0]
    assert rows.filter("charted = 1 AND row_key IS NOT NULL").count() == run.counts[1]
    bounded = Training(labelled(spark, 1500).checkpoint(), {}, fit_rows=200)
    taken = {r["charted"]: r["count"] for r in bounded.rows("rf", True).groupBy("charted").count().collect()}
    assert taken == {0: 200, 1: 200}


@pytest.mark.parametrize("width", [7, 50, 1000])
def test_permuted_features_are_shifts_of_the_hash_order(spark, width):
    n = 123
    df = spark.createDataFrame([(i, i % 2, float(i), None if i % 10 == 0 else -float(i)) for i in range(n)], "id long, y int, a double, b double").repartition(4)
    order = [r["id"] for r in df.orderBy(uniform(42, F.col("id")), "id").collect()]
    got = {}
    for r in permuted(df, ["a", "b"], "id", width=width).collect():
        got[r["_f"], r["id"]] = (r["a"], r["b"])
    assert len(got) == 3 * n
    own = {i: (float(i), None if i % 10 == 0 else -float(i)) for i in range(n)}
    for k, f in enumerate("ab"):
        shift = shift_of(f, n, 42)
        assert 0 < shift < n
        for at, i in enumerate(order):
            source = order[(at + shift) % n]
            assert got[k, i] == tuple(own[source if j == k else i][j] for j in range(2))
            assert got[-1, i] == own[i]


def test_runs_cover_every_row_once():
    for n, width, shift in [(10, 3, 4), (10, 10, 9), (1, 5, 0), (25, 4, 24)]:
        goes = {}
        for first in range(0, n, width):
            size = min(width, n - first)
            for to, place, a, b in runs(first, size, shift, n, width):
                for j in range(a, b):
                    goes[first + j] = to * width + place + j - a
        assert goes == {j: (j - shift) % n for j in range(n)}


def test_rows_are_numbered_in_order(spark):
    df = spark.createDataFrame([(f"k{(i * 37) % 101:03d}",) for i in range(101)], "k string").repartition(5)
    order = [r["k"] for r in df.orderBy(uniform(42, F.col("k")), "k").collect()]
    out, n = row_numbers(df, "k")
    assert n == 101 and sorted((r["_i"], r["k"]) for r in out.collect()) == list(enumerate(order))


def test_no_query_with_an_oracle_is_empty():
    """At sf0.01, where a comparison of nothing with nothing would prove nothing."""
    import duckdb
    import os
    con = duckdb.connect()
    for f in os.listdir("/root/testdata/sf0.01"):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{f}')")
    empty = [name for name, sql in ORACLES.items() if con.execute(f"SELECT count(*) FROM (SELECT 1 FROM ({sql}) LIMIT 1)").fetchone()[0] == 0]
    assert empty == []


def test_single_file_csv_is_split_unless_multi_line(spark):
    from chartwise.sources.files import read_csv, write_csv
    path = scratch_dir(spark, "csv")
    write_csv(spark.range(20_000).selectExpr("id", "'x, y' AS t").coalesce(1), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        assert read_csv(spark, path, "id long, t string").rdd.getNumPartitions() > 1
        assert read_csv(spark, path, "id long, t string", multi_line=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert QUERIES["csv_roundtrip"](spark, SF_SMALL).filter("title LIKE '%\\n%'").count() > 0
