"""Evaluation, neighbour, oversampling, clustering and attribution queries
with SQL oracles (E23, E24, D6, K4 given centres, K5, K11 linear)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartwise.functions.columns import fround
from chartwise.operators.encode import standardize
from chartwise.operators.learn import (assign_centres, classification_metrics, cluster_profile, knn_exact,
                                       linear_attribution, roc_auc, smote)
from chartwise.operators.permutation import permutation_importance
from chartwise.operators.scoring import LINEAR_WEIGHTS, linear_score
from chartwise.plans import views
from chartwise.plans.oracle_views import with_views
from chartwise.plans.q_encode import CLUSTER_FEATS
from chartwise.plans.q_ingest import u_sql
from chartwise.plans.q_trends import LIN_SQL
from chartwise.plans.registry import register
from chartwise.sources.tables import read_table

PRED_THRESHOLD = 0.35
SCORE_SQL = f"greatest(0.02, least(0.96, 0.15::DOUBLE + {LIN_SQL}))"


@register("classification_metrics", with_views(["facts"], f"""
SELECT CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp,
  round_even((tp + tn) / (tn + fp + fn + tp), 4) AS accuracy,
  round_even(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 4) AS precision,
  round_even(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 4) AS recall,
  round_even(CASE WHEN tp > 0 THEN 2.0 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))) ELSE 0.0 END, 4) AS f1
FROM (SELECT CAST(count(*) FILTER (WHERE charted = 0 AND p = 0) AS DOUBLE) AS tn,
             CAST(count(*) FILTER (WHERE charted = 0 AND p = 1) AS DOUBLE) AS fp,
             CAST(count(*) FILTER (WHERE charted = 1 AND p = 0) AS DOUBLE) AS fn,
             CAST(count(*) FILTER (WHERE charted = 1 AND p = 1) AS DOUBLE) AS tp
      FROM (SELECT charted, CASE WHEN {SCORE_SQL} >= {PRED_THRESHOLD} THEN 1 ELSE 0 END AS p FROM facts))"""))
def q_classification_metrics(spark, sf):
    """Confusion matrix and accuracy/precision/recall/F1 of the linear score at 0.35."""
    s = linear_score(views.facts(spark, sf)).withColumn("prediction", (F.col("score") >= PRED_THRESHOLD).cast("int"))
    return classification_metrics(s, "charted", "prediction")


@register("roc_auc", with_views(["facts"], f"""
SELECT round_even(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc,
  CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
FROM (SELECT s, pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT s, count(*) FILTER (WHERE charted = 1) AS pos, count(*) FILTER (WHERE charted = 0) AS neg
            FROM (SELECT {SCORE_SQL} AS s, charted FROM facts) GROUP BY s))"""))
def q_roc_auc(spark, sf):
    """ROC-AUC of the linear score for the label, ties counted half."""
    s = linear_score(views.facts(spark, sf))
    return roc_auc(s, "score", "charted")


MINORITY_SQL = "mi AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label = 0)"
KNN_SQL = """
kk AS (SELECT least(5, count(*) - 1) AS k FROM mi),
nn AS (SELECT vec_id, rank, neighbor_id, distance FROM (
  SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.v, b.v) AS distance,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank
  FROM mi a, mi b WHERE a.vec_id <> b.vec_id), kk WHERE rank <= k)"""


def _minority(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return e.filter(F.col("label") == 0).select("vec_id", "embedding")


@register("knn_minority", "WITH " + MINORITY_SQL + "," + KNN_SQL + """
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbor_id, round_even(distance, 6) AS distance FROM nn""")
def q_knn_minority(spark, sf):
    """Exact 5 nearest minority neighbours of every minority embedding (label 0)."""
    mi = _minority(spark, sf)
    m = mi.count()
    nn = knn_exact(mi, "vec_id", "embedding", min(5, m - 1))
    return nn.withColumn("distance", fround("distance", 6))


@register("smote", "WITH " + MINORITY_SQL + "," + KNN_SQL + f""",
cnt AS (SELECT count(*) FILTER (WHERE label = 0) AS m, count(*) FILTER (WHERE label <> 0) AS big FROM embeddings),
base AS (SELECT mi.vec_id, mi.v, (big - m) // m + CASE WHEN row_number() OVER (ORDER BY {u_sql(42, 'mi.vec_id')}, mi.vec_id) <= (big - m) % m
           THEN 1 ELSE 0 END AS c FROM mi, cnt),
draws AS (SELECT vec_id, v, j, CAST(floor({u_sql(42, "'n'", 'vec_id', 'j')} * (SELECT k FROM kk)) + 1 AS INTEGER) AS rank,
            {u_sql(42, "'g'", 'vec_id', 'j')} AS gap
          FROM (SELECT vec_id, v, unnest(range(c)) AS j FROM base))
SELECT d.vec_id AS base_id, CAST(d.j AS INTEGER) AS j, nn.neighbor_id, round_even(d.gap, 6) AS gap,
  round_even(d.v[1] + d.gap * (b.v[1] - d.v[1]), 6) AS v0, round_even(d.v[2] + d.gap * (b.v[2] - d.v[2]), 6) AS v1
FROM draws d JOIN nn ON nn.vec_id = d.vec_id AND nn.rank = d.rank JOIN mi b ON b.vec_id = nn.neighbor_id""")
def q_smote(spark, sf):
    """SMOTE: synthetic minority embeddings until the classes balance (label 0 vs the rest)."""
    e = read_table(spark, sf, "embeddings").withColumn("minor", (F.col("label") == 0).cast("int"))
    s = smote(e, "vec_id", "embedding", "minor", minority=1, k=5, seed=42)
    return s.select("base_id", "j", "neighbor_id", fround("gap", 6).alias("gap"),
                    fround(F.col("vector")[0], 6).alias("v0"), fround(F.col("vector")[1], 6).alias("v1"))


def _cluster_sql():
    feats = CLUSTER_FEATS
    z = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z_{c}" for c in feats)
    cen = ", ".join(f"avg(z_{c}) AS c_{c}" for c in feats)
    d2 = " + ".join(f"(z.z_{c} - c.c_{c}) * (z.z_{c} - c.c_{c})" for c in feats)
    means = ", ".join(f"avg({c}) AS m_{c}" for c in feats)
    unn = f"unnest([{', '.join(repr(c) for c in feats)}]) AS f"
    vals = f"unnest([{', '.join(f'm_{c}' for c in feats)}]) AS m"
    ords = f"unnest(range({len(feats)})) AS o"
    return f"""
WITH {_views_ctes()},
base AS (SELECT * FROM tracks WHERE {' AND '.join(f'{c} IS NOT NULL' for c in feats)}),
z AS (SELECT track_id, charted, popularity, {', '.join(feats)}, key % 4 AS g, {z} FROM base),
c AS (SELECT g, {cen} FROM z GROUP BY g),
a AS (SELECT track_id, g AS cluster FROM (
        SELECT z.track_id, c.g, row_number() OVER (PARTITION BY z.track_id ORDER BY {d2}, c.g) AS rn FROM z, c) WHERE rn = 1),
p AS (SELECT a.cluster, count(*) AS n, avg(z.charted) AS r, avg(z.popularity) AS pop, {means}
      FROM z JOIN a ON a.track_id = z.track_id GROUP BY a.cluster),
l AS (SELECT cluster, {unn}, {vals}, {ords} FROM p),
t AS (SELECT cluster, string_agg(f, ', ' ORDER BY m DESC, o) FILTER (WHERE rk <= 3) AS top_features,
        min(f) FILTER (WHERE rl = 1) AS low_feature
      FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY m DESC, o) AS rk,
                   row_number() OVER (PARTITION BY cluster ORDER BY m, o) AS rl FROM l) GROUP BY cluster)
SELECT p.cluster, CAST(p.n AS BIGINT) AS n, round_even(p.r, 4) AS chart_rate, round_even(p.pop, 2) AS avg_popularity,
  t.top_features, t.low_feature, {', '.join(f'round_even(p.m_{c}, 4) AS mean_{c}' for c in feats)}
FROM p JOIN t ON t.cluster = p.cluster"""


def _views_ctes():
    from chartwise.plans.oracle_views import CTES
    return ",\n".join(CTES[n].strip() for n in ("tracks_raw", "tracks"))


@register("cluster_profile", _cluster_sql())
def q_cluster_profile(spark, sf):
    """Assign standardised tracks to given centres (means of key % 4 groups) and profile each cluster."""
    t = views.tracks(spark, sf).select("track_id", "charted", "popularity", "key", *CLUSTER_FEATS) \
        .na.drop(subset=CLUSTER_FEATS)
    zcols = [f"z_{c}" for c in CLUSTER_FEATS]
    z = standardize(t.withColumns({f"z_{c}": F.col(c) for c in CLUSTER_FEATS}), zcols)
    cen_rows = z.groupBy((F.col("key") % 4).alias("g")).agg(*[F.avg(c).alias(c) for c in zcols]).orderBy("g").collect()
    centres = [[r[c] for c in zcols] for r in cen_rows]
    ids = [r["g"] for r in cen_rows]
    a = assign_centres(z, zcols, centres, out="_ci")
    a = a.withColumn("cluster", F.element_at(F.array(*[F.lit(int(i)) for i in ids]), F.col("_ci") + 1))
    return cluster_profile(a, "cluster", CLUSTER_FEATS)


@register("linear_attribution", with_views(["facts"], " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round_even(avg(abs({w!r}::DOUBLE * (coalesce({f}, 0.0) - m))), 6) AS mean_abs_contribution, "
    f"round_even(avg({w!r}::DOUBLE * (coalesce({f}, 0.0) - m)), 6) AS mean_contribution "
    f"FROM facts, (SELECT avg(coalesce({f}, 0.0)) AS m FROM facts)" for f, w in LINEAR_WEIGHTS.items())))
def q_linear_attribution(spark, sf):
    """Exact attribution of the linear score: mean |w (x - mean)| and mean signed term per feature."""
    return linear_attribution(views.facts(spark, sf), LINEAR_WEIGHTS)


#: Features whose values the permutation query moves.
MOVED = list(LINEAR_WEIGHTS)[:4]


def _permutation_sql():
    def score(moved):
        terms = " + ".join(f"{w!r}::DOUBLE * coalesce({'b' if f == moved else 'a'}.{f}, 0.0)" for f, w in LINEAR_WEIGHTS.items())
        return f"greatest(0.02, least(0.96, 0.15::DOUBLE + {terms}))"

    def auc(moved):
        rows = f"r a JOIN r b ON b.i = (a.i + 1 + CAST(floor({u_sql(42, chr(39) + 'shift' + chr(39), chr(39) + moved + chr(39))} * (a.n - 1)) AS BIGINT)) % a.n" if moved else "r a"
        return f"""(SELECT round_even(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM (SELECT s, count(*) FILTER (WHERE charted = 1) AS pos, count(*) FILTER (WHERE charted = 0) AS neg FROM (SELECT {score(moved)} AS s, a.charted FROM {rows}) GROUP BY s)))"""
    parts = " UNION ALL ".join(f"SELECT '{f}' AS feature, {auc(f)} AS auc" for f in MOVED)
    return with_views(["facts"], f"SELECT feature, auc, base_auc, round_even(base_auc - auc, 6) AS auc_drop FROM ({parts}), (SELECT {auc(None)} AS base_auc)",
                      extra_ctes=f"r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {u_sql(42, 'track_id')}, track_id) - 1 AS i, count(*) OVER () AS n FROM facts)")


@register("permutation_linear", _permutation_sql())
def q_permutation_linear(spark, sf):
    """Permutation importance of the linear score: AUC drop for each of four features whose values change places."""
    rest = [f for f in LINEAR_WEIGHTS if f not in MOVED]
    f = views.facts(spark, sf).select("track_id", "charted", *LINEAR_WEIGHTS)
    drops = permutation_importance(linear_score, f, MOVED, "track_id", "charted", keep=rest)
    return drops.withColumn("auc_drop", fround("auc_drop", 6))
