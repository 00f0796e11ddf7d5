"""Golden checks against the reference's published artifacts."""

import pytest
from pyspark.sql import functions as F

from chartwise.functions.stats import t_two_sided_p
from chartwise.operators.encode import one_hot
from chartwise.operators.learn import metrics_from_confusion
from chartwise.operators.split import stratified_sizes
from chartwise.operators.trends import feature_trends, largest_jump

import golden as G


@pytest.mark.parametrize("name", list(G.CONFUSION))
def test_metrics_from_published_confusion(name):
    (tn, fp), (fn, tp) = G.CONFUSION[name][0]
    got = metrics_from_confusion(tn, fp, fn, tp)
    assert got == G.CONFUSION[name][1]


def test_metrics_operator_matches(spark):
    from chartwise.operators.learn import classification_metrics
    (tn, fp), (fn, tp) = G.CONFUSION["rf_val"][0]
    rows = [(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn + [(1, 1)] * tp
    df = spark.createDataFrame(rows, "label int, prediction int")
    r = classification_metrics(df).first().asDict()
    for k, v in G.CONFUSION["rf_val"][1].items():
        assert r[k] == v


def test_split_sizes_golden():
    sizes = stratified_sizes(G.SPLIT_INPUT, 0.15, 0.15)
    totals = tuple(sum(s[i] for s in sizes.values()) for i in range(3))
    assert totals == G.SPLIT_TOTALS
    assert sizes[1] == G.SPLIT_POSITIVES


def test_class_balance_golden(spark):
    from chartwise.operators.profile import class_balance
    df = spark.range(G.TOTAL_ROWS).select((F.col("id") < G.SPLIT_INPUT[1]).cast("int").alias("charted"))
    r = class_balance(df).first()
    assert r["charted_pct"] == G.CLASS_BALANCE["charted_pct"]
    assert r["imbalance_ratio"] == G.CLASS_BALANCE["imbalance_ratio"]


def test_breakpoint_golden(spark):
    rows = [(0.25 + 0.5 * i, float(rate)) for i, (_, n, rate) in enumerate(G.FOLLOWER_BUCKETS)]
    b = spark.createDataFrame(rows, "mid double, rate double")
    r = largest_jump(b).first()
    assert r["breakpoint_followers"] == G.BREAKPOINT_FOLLOWERS
    assert r["breakpoint_jump"] == G.BREAKPOINT_JUMP_FROM_ROUNDED


def test_trend_slopes_and_pvalues_golden(spark):
    feats = list(G.DECADE_MEANS)
    rows = [(d, *[G.DECADE_MEANS[f][i] for f in feats]) for i, d in enumerate(G.DECADES)]
    m = spark.createDataFrame(rows, "decade int, " + ", ".join(f"{f} double" for f in feats))
    out = {r["feature"]: r for r in feature_trends(m, "decade", feats).collect()}
    for f, (slope, p) in G.TRENDS.items():
        assert out[f]["slope"] == pytest.approx(slope, abs=1e-6)
        assert t_two_sided_p(out[f]["_t"], out[f]["_df"]) == pytest.approx(p, abs=3e-4)


def test_hit_tiers_cover_all_rows():
    assert sum(G.HIT_TIER_N) == G.TOTAL_ROWS


def test_one_hot_names_golden(spark):
    df = spark.createDataFrame([(k, ts) for k in range(12) for ts in (0, 1, 3, 4, 5)], "key int, time_signature int")
    out = one_hot(one_hot(df, "key", "key"), "time_signature", "ts")
    assert [c for c in out.columns if c.startswith("key_")] == G.ONE_HOT_KEY
    assert [c for c in out.columns if c.startswith("ts_")] == G.ONE_HOT_TS
