"""Model queries (rows-only checks): training, selection, importances,
permutation importance, persisted batch scoring, sparse scoring, single-feature
logistic fit, k-means restarts (K4, K6-K13, A11)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from chartwise.functions.columns import fround
from chartwise.operators.encode import MEDIAN_FILL, standardize
from chartwise.operators.iterative import assign_pass, kmeans, lloyd, logistic_newton, on_grid, profile_by_size
from chartwise.operators.learn import assign_centres, roc_auc
from chartwise.operators.models import KINDS, Training, evaluate, importances, load_scorer, score, sparse_input
from chartwise.operators.permutation import permutation_importance
from chartwise.operators.preparation import TARGET, Preparation
from chartwise.operators.reports import report_numbers
from chartwise.operators.split import sample_n
from chartwise.plans import views
from chartwise.plans.oracle_views import with_views
from chartwise.plans.q_encode import CLUSTER_FEATS
from chartwise.plans.q_ingest import u_sql
from chartwise.plans.registry import register
from chartwise.session import scratch_dir
from chartwise.sources.files import read_report, write_report

# Fixed values that must equal the reference's: the sizes of its forest and of its boosted trees.
PARAMS = {"rf": {"numTrees": 300, "maxDepth": 20, "minInstancesPerNode": 2},
          "gbt": {"maxIter": 400, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8, "minInstancesPerNode": 5}}

#: Rows of the single-feature fit at most, the reference's bound; its AUC is over all rows.
LOGIT_ROWS = 100_000
_TRAINED: dict = {}


def trained(spark, sf) -> Training:
    """One training run per session and folder, on every row of the train split; a model is fitted when a query first asks for it.
    The run of another folder is forgotten: its models and what is broadcast of them take the driver's memory."""
    key = (spark.sparkContext.applicationId, sf.rstrip("/"))
    if key not in _TRAINED:
        _TRAINED.clear()
        _TRAINED[key] = Training(views.tracks(spark, sf, round_to=True), PARAMS)
    return _TRAINED[key]


def _metrics(spark, sf, kind, name, oversample=False):
    t = trained(spark, sf)
    held = t.split.filter(F.col("split").isin("val", "test"))
    return evaluate(t.model(kind, oversample), held, group=["split"]).withColumn("model", F.lit(name))


def _frame_sql():
    """The prepared model frame: fills, genre code, categories without their smallest, in feature order."""
    medians = [c for c in MEDIAN_FILL if c not in ("key", "time_signature")]
    ones = ", ".join([f"CAST(k = {v} AND k > (SELECT min(k) FROM c) AS DOUBLE) AS key_{v}" for v in range(1, 12)]
                     + [f"CAST(ts = {v} AND ts > (SELECT min(ts) FROM c) AS DOUBLE) AS ts_{v}" for v in (2, 3, 4, 5)])
    filled = ", ".join(f"round_even(coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont({c}, 0.5) FROM tracks)), 6) AS {c}" for c in medians)
    return with_views(["tracks"], f"""
SELECT track_id, {", ".join(medians)}, duration_min, explicit, markets_count, genre_enc, {ones} FROM c""", extra_ctes=f"""
c AS (SELECT track_id, {filled}, coalesce(duration_min, 0.0) AS duration_min, CAST(coalesce(explicit, 0) AS DOUBLE) AS explicit,
  CAST(coalesce(markets_count, 0) AS DOUBLE) AS markets_count, CAST((SELECT count(DISTINCT coalesce(x.genre, 'unknown')) FROM tracks x WHERE coalesce(x.genre, 'unknown') < coalesce(tracks.genre, 'unknown')) AS DOUBLE) AS genre_enc,
  CAST(trunc(coalesce(key, (SELECT quantile_cont(key, 0.5) FROM tracks))) AS INTEGER) AS k,
  CAST(trunc(coalesce(time_signature, (SELECT quantile_cont(time_signature, 0.5) FROM tracks))) AS INTEGER) AS ts FROM tracks)""")


@register("model_frame", _frame_sql())
def q_model_frame(spark, sf):
    """Every feature of every track under the fitted preparation, saved and loaded again."""
    t = views.tracks(spark, sf)
    path = scratch_dir(spark, "preparation")
    Preparation.fit(t).save(path)
    ready = Preparation.load(spark, path)
    out = ready.transform(t).withColumnRenamed("row_key", "track_id").drop("charted")
    return out.select("track_id", *[(fround(c, 6).alias(c) if c in MEDIAN_FILL else F.col(c)) for c in ready.features])


@register("rf_train")
def q_rf_train(spark, sf):
    """Random forest (balanced class weights) fitted on the train split; val and test metrics."""
    return _metrics(spark, sf, "rf", "random_forest")


@register("gbt_train")
def q_gbt_train(spark, sf):
    """Gradient-boosted trees (positive-class weight neg/pos); val and test metrics."""
    return _metrics(spark, sf, "gbt", "gbt")


@register("smote_rf_train")
def q_smote_rf_train(spark, sf):
    """Random forest on SMOTE-oversampled train rows (plus balanced weights); val and test metrics."""
    return _metrics(spark, sf, "rf", "random_forest_smote", oversample=True)


@register("best_model")
def q_best_model(spark, sf):
    """The model with the best validation AUC to four digits (first listed on ties)."""
    return spark.createDataFrame([trained(spark, sf).best()], "best_model string, best_val_auc double")


@register("importance_rank")
def q_importance_rank(spark, sf):
    """Impurity importances of the random forest, all features."""
    t = trained(spark, sf)
    return spark.createDataFrame([(i + 1, f, float(v)) for i, (f, v) in enumerate(importances(t.model("rf"), t.feats))],
                                 "rank int, feature string, importance double")


@register("permutation_importance")
def q_permutation_importance(spark, sf):
    """Validation AUC drop per permuted feature for the random forest."""
    t = trained(spark, sf)
    held = t.split.filter(F.col("split") == "val").drop("split")
    return permutation_importance(lambda df: score(t.model("rf"), df), held, t.feats, "row_key", TARGET)


@register("model_results")
def q_model_results(spark, sf):
    """Both models' sizes, val and test metrics, confusion matrices and importances as one JSON document, read back."""
    t = trained(spark, sf)
    t.fit_all()
    held = t.split.filter(F.col("split").isin("val", "test"))
    sections = {}
    for kind in KINDS:
        sections[f"{kind}.metrics"] = evaluate(t.model(kind), held, group=["split"])
        sections[f"{kind}.importances"] = spark.createDataFrame([(f, float(v)) for f, v in importances(t.model(kind), t.feats)], "feature string, importance double")
    sections["split"] = t.split.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg(TARGET).alias("charted_rate"))
    path = scratch_dir(spark, "model-results")
    write_report(sections, path)
    layout = {"split": ("split", ["n", "charted_rate"])}
    for kind in KINDS:
        layout |= {f"{kind}.metrics": ("split", ["tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "f1", "auc"]), f"{kind}.importances": ("feature", ["importance"])}
    return report_numbers(read_report(spark, path), layout)


@register("batch_score")
def q_batch_score(spark, sf):
    """Save the chosen model with its preparation to shared storage, load both, score every raw track."""
    path = scratch_dir(spark, "model")
    trained(spark, sf).save(path)
    _, scorer = load_scorer(spark, path)
    return scorer(views.tracks(spark, sf, round_to=True)).select("row_key", fround("score", 6).alias("probability"), "prediction")


@register("score_sparse")
def q_score_sparse(spark, sf):
    """Score rows that carry only a few audio features (others 0, interactions recomputed) with the chosen model."""
    t = trained(spark, sf)
    partial = t.frame.select("row_key", "energy", "danceability", "loudness_norm", "valence", "acousticness")
    return score(t.model(t.best()[0]), sparse_input(partial, t.feats)).select("row_key", fround("score", 6).alias("probability"))


#: Newton steps in the SQL of the logistic fit, enough for it to rest.
SQL_STEPS = 12


def _logit_sql():
    steps = ["s0 AS MATERIALIZED (SELECT ln(sum(p) / (sum(n) - sum(p))) AS b, 0.0::DOUBLE AS w FROM zs)"]
    for i in range(SQL_STEPS):
        steps.append(f"""g{i} AS MATERIALIZED (SELECT any_value(b) AS b, any_value(w) AS w, sum(n * q - p) AS g0, sum((n * q - p) * x) + any_value(w) AS g1,
  sum(n * q * (1 - q)) AS h00, sum(n * q * (1 - q) * x) AS h01, sum(n * q * (1 - q) * x * x) + 1.0 AS h11
  FROM (SELECT x, n, p, b, w, 1.0 / (1.0 + exp(-(x * w + b))) AS q FROM zs, s{i})),
s{i + 1} AS MATERIALIZED (SELECT b - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b, w - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS w FROM g{i})""")
    return with_views(["facts"], f"""
SELECT round_even(any_value(w), 4) AS coef, round_even(any_value(b), 4) AS intercept, round_even(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc,
  CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
FROM s{SQL_STEPS}, (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM (SELECT x * (SELECT sign(w) FROM s{SQL_STEPS}) AS v, count(*) FILTER (WHERE charted = 1) AS pos, count(*) FILTER (WHERE charted = 0) AS neg FROM z GROUP BY 1))""",
        extra_ctes=f"""lf AS (SELECT track_id, charted, log10(greatest(followers, 1.0)) AS l FROM facts WHERE followers > 0),
z AS MATERIALIZED (SELECT track_id, charted, (l - avg(l) OVER ()) / stddev_pop(l) OVER () AS x FROM lf),
zs AS MATERIALIZED (SELECT x, CAST(count(*) AS DOUBLE) AS n, CAST(sum(charted) AS DOUBLE) AS p
  FROM (SELECT * FROM z ORDER BY {u_sql(42, 'track_id')}, track_id LIMIT {LOGIT_ROWS}) GROUP BY x),
""" + ",\n".join(steps))


@register("logit_single", _logit_sql())
def q_logit_single(spark, sf):
    """Logistic regression on standardised log10(followers), fitted on at most LOGIT_ROWS rows; AUC over all rows."""
    f = views.facts(spark, sf).filter(F.col("followers") > 0) \
        .select("track_id", "charted", F.log10(F.greatest("followers", F.lit(1.0))).alias("log_followers")).checkpoint()
    z = standardize(f, ["log_followers"])
    coef, intercept = logistic_newton(sample_n(z, "track_id", LOGIT_ROWS, seed=42), "log_followers", "charted")
    side = 1.0 if coef >= 0 else -1.0  # probabilities order as the feature does
    auc = roc_auc(z.withColumn("score", F.col("log_followers") * side), "score", "charted")
    return auc.select(fround(F.lit(coef), 4).alias("coef"), fround(F.lit(intercept), 4).alias("intercept"), "auc", "n_pos", "n_neg")


def _scaled(spark, sf):
    t = views.tracks(spark, sf).select("track_id", "key", "charted", "popularity", *CLUSTER_FEATS).na.drop(subset=CLUSTER_FEATS).checkpoint()
    return standardize(t.withColumns({f"z_{c}": F.col(c) for c in CLUSTER_FEATS}), [f"z_{c}" for c in CLUSTER_FEATS])


@register("kmeans_fit")
def q_kmeans_fit(spark, sf):
    """k-means (k = 4) on standardised features, best of 10 seeded restarts, clusters numbered by size."""
    zc = [f"z_{c}" for c in CLUSTER_FEATS]
    z = _scaled(spark, sf)
    centres, _ = kmeans(z, "track_id", zc, k=4, restarts=10, seed=42)
    return profile_by_size(assign_centres(z, zc, centres.tolist()), "cluster", CLUSTER_FEATS)


#: Rounds of the k-means query from given starts.
ROUNDS = 3


def _rounds_sql():
    zc = [f"z_{c}" for c in CLUSTER_FEATS]
    scaled = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z_{c}" for c in CLUSTER_FEATS)
    means = ", ".join(f"avg({c}) AS {c}" for c in zc)
    apart = " + ".join(f"(z.{c} - s.{c}) * (z.{c} - s.{c})" for c in zc)
    steps = [f"s0 AS MATERIALIZED (SELECT g, {means} FROM z GROUP BY g)"]
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT track_id, g FROM (SELECT z.track_id, s.g, row_number() OVER (PARTITION BY z.track_id ORDER BY {apart}, s.g) AS rn FROM z, s{i} s) WHERE rn = 1)")
        steps.append(f"s{i + 1} AS MATERIALIZED (SELECT a.g, {means} FROM z JOIN a{i} a ON a.track_id = z.track_id GROUP BY a.g)")
    return with_views(["tracks"], f"""SELECT CAST(s.g AS INTEGER) AS start, CAST(n AS BIGINT) AS n, {", ".join(f"round_even(s.{c}, 4) AS {c}" for c in zc)}
FROM s{ROUNDS} s JOIN (SELECT g, count(*) AS n FROM a{ROUNDS} GROUP BY g) USING (g)""",
        extra_ctes=f"""z AS MATERIALIZED (SELECT track_id, key % 4 AS g, {scaled} FROM tracks WHERE key IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL" for c in CLUSTER_FEATS)}),
""" + ",\n".join(steps))


@register("kmeans_rounds", _rounds_sql())
def q_kmeans_rounds(spark, sf):
    """Three rounds of k-means from given starts (means of the key % 4 groups): centres, and rows that they attract."""
    zc = [f"z_{c}" for c in CLUSTER_FEATS]
    t = views.tracks(spark, sf).select("track_id", "key", *CLUSTER_FEATS).na.drop(subset=["key", *CLUSTER_FEATS]).checkpoint()
    z = standardize(t.withColumns({f"z_{c}": F.col(c) for c in CLUSTER_FEATS}), zc)
    starts = z.groupBy((F.col("key") % 4).alias("g")).agg(*[F.avg(c).alias(c) for c in zc]).orderBy("g").collect()
    rows = on_grid(z.select("track_id", *zc), zc).checkpoint()
    centres, _ = lloyd(rows, zc, np.array([[[r[c] for c in zc] for r in starts]]), rounds=ROUNDS)
    size = {c: n for (_, c), (n, _, _) in assign_pass(rows, zc, centres).items()}
    out = [(r["g"], size.get(i, 0), *[float(v) for v in centres[0, i]]) for i, r in enumerate(starts)]
    found = spark.createDataFrame(out, "start int, n long, " + ", ".join(f"{c} double" for c in zc))
    return found.select("start", "n", *[fround(c, 4).alias(c) for c in zc])
