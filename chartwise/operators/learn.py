"""Evaluation, neighbours, oversampling, clustering and attribution.

Scale notes
-----------
* ROC-AUC: scores are first reduced to one row per distinct score, then
  range-partitioned by score into ordered partitions of bounded size; running
  negative counts are computed inside each partition and offset by the totals
  of the preceding partitions (a prefix sum in two phases).  No window ever
  spans all rows, and a score shared by a third of the rows is one row.
* kNN: see :mod:`chartwise.operators.neighbours`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartwise.operators.joins import checked_broadcast
from chartwise.operators.neighbours import knn_exact
from chartwise.functions.columns import fround, uniform


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                           group: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 (4 dp; 0 where undefined)."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    g = df.groupBy(*group).agg(F.count(F.when((y == 0) & (p == 0), 1)).alias("tn"),
                               F.count(F.when((y == 0) & (p == 1), 1)).alias("fp"),
                               F.count(F.when((y == 1) & (p == 0), 1)).alias("fn"),
                               F.count(F.when((y == 1) & (p == 1), 1)).alias("tp"))
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, F.lit(2.0) * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return g.select(*group, *[F.col(c).cast("bigint").alias(c) for c in ("tn", "fp", "fn", "tp")],
                    fround((tp + tn) / (tn + fp + fn + tp), 4).alias("accuracy"), fround(prec, 4).alias("precision"),
                    fround(rec, 4).alias("recall"), fround(f1, 4).alias("f1"))


def metrics_from_confusion(tn: int, fp: int, fn: int, tp: int) -> dict:
    """Plain-number form of E23 (for tests against published confusion matrices)."""
    prec = tp / (tp + fp) if tp + fp else 0.0
    rec = tp / (tp + fn) if tp + fn else 0.0
    f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
    return {"accuracy": round((tp + tn) / (tn + fp + fn + tp), 4), "precision": round(prec, 4),
            "recall": round(rec, 4), "f1": round(f1, 4)}


def _running_negatives(group: Sequence[str]):
    """Per range partition (rows sorted by group, score): negatives strictly below each
    score inside the partition, carried across Arrow batches.  Rows of a group are
    contiguous, so only the first group of a batch can continue the previous one."""
    def run(batches):
        last_key, last_total = None, 0
        for pdf in batches:
            if pdf.empty:
                continue
            neg = pdf["_neg"].to_numpy(np.int64)
            if group:
                g = pdf[list(group)]
                new_block = (g != g.shift()).any(axis=1).to_numpy()
                new_block[0] = True
                block = np.cumsum(new_block) - 1
                cs = pd.Series(neg).groupby(block).cumsum().to_numpy()
                below = cs - neg
                first_key = tuple(g.iloc[0])
                if last_key is not None and first_key == last_key:
                    below[block == 0] += last_total
                key = tuple(g.iloc[-1])
                tail = int(cs[-1]) + (last_total if (block[-1] == 0 and last_key == key) else 0)
                last_key, last_total = key, tail
            else:
                cs = np.cumsum(neg)
                below = last_total + cs - neg
                last_total += int(cs[-1])
            yield pdf.assign(_below=below)
    return run


def roc_auc(df: DataFrame, score: str, label: str, group: Sequence[str] = (),
            rows_per_partition: int = 1_000_000) -> DataFrame:
    """Exact ROC-AUC with ties counted half, per ``group`` (Mann-Whitney form).

    Distributed prefix sum: one row per (group, distinct score) with its positive
    and negative counts; that table is range-partitioned by (group, score) into
    ~rows / ``rows_per_partition`` ordered partitions and sorted inside each;
    running negatives are computed inside every partition (vectorised, no
    further shuffle) and offset by the totals of the preceding partitions (a
    table of one row per partition and group).  No task holds more than one
    range partition, and a score shared by a third of the rows is one row.
    """
    group = list(group)
    d = df.select(*group, F.col(score).cast("double").alias("_s"), F.col(label).cast("int").alias("_y")) \
        .filter(F.col("_s").isNotNull() & F.col("_y").isNotNull())
    per = d.groupBy(*group, "_s").agg(F.count(F.when(F.col("_y") == 1, 1)).alias("_pos"),
                                      F.count(F.when(F.col("_y") == 0, 1)).alias("_neg"))
    # the distinct-score table feeds several passes: write it once so an
    # expensive upstream (model scoring) is not evaluated again
    per = per.checkpoint()
    n_parts = max(1, math.ceil(per.count() / rows_per_partition))
    # range bounds come from sampling, so the partitioned table is written once:
    # the running sums and the partition totals must see the same partitions
    ordered = per.repartitionByRange(n_parts, *group, "_s").sortWithinPartitions(*group, "_s") \
        .withColumn("_pid", F.spark_partition_id()).checkpoint()
    schema = T.StructType(list(ordered.schema.fields) + [T.StructField("_below", T.LongType())])
    within = ordered.mapInPandas(_running_negatives(group), schema)
    tot = ordered.groupBy(*group, "_pid").agg(F.sum("_neg").alias("_pneg"))
    wp = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.withColumn("_off", F.coalesce(F.sum("_pneg").over(wp), F.lit(0))).drop("_pneg")
    # a NULL group is a group; the offsets (one row per range partition and group) are broadcast if counted to be few
    off = checked_broadcast(off.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_pid").alias("_opid"), "_off"), 1_000_000)
    same = F.col("_pid") == F.col("_opid")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    j = within.join(off, same)
    below = F.col("_off") + F.col("_below")
    out = j.groupBy(*group).agg(F.sum(F.col("_pos") * (below + F.col("_neg") / 2.0)).alias("_w"),
                                F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                 F.col("_w") / (F.col("n_pos").cast("double") * F.col("n_neg").cast("double")))
    return out.select(*group, fround(auc, 6).alias("auc"), F.col("n_pos").cast("bigint").alias("n_pos"),
                      F.col("n_neg").cast("bigint").alias("n_neg"))


def smote(df: DataFrame, id_col: str, vec_col: str, label: str, minority=1, k: int = 5, seed: int = 42,
          neighbours: DataFrame | None = None) -> DataFrame:
    """K5: synthetic minority rows until both classes have the same count.

    As in the original SMOTE, every minority row is a base for need // m
    synthetic rows, and need % m rows (the first by uniform(seed, 'b', id))
    get one more.  For base x and draw j the neighbour is among its k nearest
    minority neighbours at rank 1 + floor(u * k) and the new point is
    x + g * (neighbour - x) with g = uniform(seed, 'g', id, j).
    Returns (base_id, j, neighbor_id, gap, vector).
    """
    from chartwise.operators.split import assign_by_rank
    id_type = df.schema[id_col].dataType.simpleString()
    mino = df.filter(F.col(label) == minority).select(F.col(id_col).alias("id"),
                                                      F.col(vec_col).cast("array<double>").alias("v"))
    counts = df.agg(F.count(F.when(F.col(label) == minority, 1)).alias("m"),
                    F.count(F.when(F.col(label) != minority, 1)).alias("M")).first()
    m, M = counts["m"], counts["M"]
    need = M - m
    spark = df.sparkSession
    mino = mino.checkpoint()  # read by the search, the ranking and both ends of the draws
    if m < 2 or need <= 0:
        return spark.createDataFrame([], f"base_id {id_type}, j int, neighbor_id {id_type}, gap double, vector array<double>")
    kk = min(k, m - 1)
    nn = neighbours if neighbours is not None else knn_exact(mino, "id", "v", kk, seed=seed)
    per, extra = divmod(need, m)
    one = mino.withColumn("_one", F.lit(1))
    ranked = assign_by_rank(one, "_one", "id", {1: [extra]}, ["extra", "base"], seed=seed, out="_x") \
        if extra else one.withColumn("_x", F.lit("base"))
    cnt = F.lit(per) + F.when(F.col("_x") == "extra", 1).otherwise(0)
    draws = ranked.filter(cnt > 0).select("id", "v", F.explode(F.sequence(F.lit(0), cnt - 1)).alias("j"))
    draws = draws.withColumn("rank", (F.floor(uniform(seed, F.lit("n"), F.col("id"), F.col("j")) * kk) + 1).cast("int")) \
        .withColumn("gap", uniform(seed, F.lit("g"), F.col("id"), F.col("j")))
    nb = nn.select(F.col(nn.columns[0]).alias("id"), "rank", "neighbor_id")
    j = draws.join(nb, ["id", "rank"]).join(mino.select(F.col("id").alias("neighbor_id"), F.col("v").alias("nv")),
                                            "neighbor_id")
    vec = F.zip_with("v", "nv", lambda a, b: a + F.col("gap") * (b - a))
    return j.select(F.col("id").alias("base_id"), F.col("j").cast("int").alias("j"), "neighbor_id", "gap",
                    vec.alias("vector"))


def assign_centres(df: DataFrame, cols: Sequence[str], centres: Sequence[Sequence[float]], out: str = "cluster") -> DataFrame:
    """K4 (given centres): nearest centre by Euclidean distance; ties to the lower index."""
    dists = []
    for i, c in enumerate(centres):
        d2 = None
        for f, v in zip(cols, c):
            t = (F.col(f) - F.lit(float(v))) * (F.col(f) - F.lit(float(v)))
            d2 = t if d2 is None else d2 + t
        dists.append(F.struct(d2.alias("d"), F.lit(i).alias("i")))
    return df.withColumn(out, F.array_min(F.array(*dists))["i"])


def cluster_profile(df: DataFrame, cluster: str, feats: Sequence[str], label: str = "charted",
                    value: str = "popularity", top: int = 3) -> DataFrame:
    """K4/F6 profile: n, label rate, mean value, the ``top`` highest and the lowest feature means."""
    g = df.groupBy(cluster).agg(F.count(F.lit(1)).cast("bigint").alias("n"), F.avg(label).alias("_r"),
                                F.avg(value).alias("_p"), *[F.avg(f).alias(f"_m{i}") for i, f in enumerate(feats)])
    arr = F.array(*[F.struct(F.col(f"_m{i}").alias("m"), F.lit(-i).alias("o"), F.lit(f).alias("f"))
                    for i, f in enumerate(feats)])
    hi = F.slice(F.sort_array(arr, asc=False), 1, top)
    lo = F.array_min(F.array(*[F.struct(F.col(f"_m{i}").alias("m"), F.lit(i).alias("o"), F.lit(f).alias("f"))
                               for i, f in enumerate(feats)]))
    return g.select(cluster, "n", fround("_r", 4).alias("chart_rate"), fround("_p", 2).alias("avg_popularity"),
                    F.array_join(F.transform(hi, lambda s: s["f"]), ", ").alias("top_features"),
                    lo["f"].alias("low_feature"),
                    *[fround(f"_m{i}", 4).alias(f"mean_{f}") for i, f in enumerate(feats)])


def linear_attribution(df: DataFrame, weights: dict) -> DataFrame:
    """K11 (linear): mean |w (x - mean x)| and mean w (x - mean x) per feature (NULL x as 0)."""
    feats = list(weights)
    x = {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in feats}
    means = df.agg(*[F.avg(x[f]).alias(f"m{i}") for i, f in enumerate(feats)]).first()
    contrib = {f: F.lit(float(weights[f])) * (x[f] - F.lit(means[f"m{i}"])) for i, f in enumerate(feats)}
    row = df.agg(*[F.avg(F.abs(contrib[f])).alias(f"a{i}") for i, f in enumerate(feats)],
                 *[F.avg(contrib[f]).alias(f"s{i}") for i, f in enumerate(feats)])
    items = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"a{i}").alias("a"), F.col(f"s{i}").alias("s"))
                      for i, f in enumerate(feats)])
    return row.select(F.inline(items)).select("feature", fround("a", 6).alias("mean_abs_contribution"),
                                              fround("s", 6).alias("mean_contribution"))
