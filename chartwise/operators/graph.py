"""Bounded breadth-first expansion over an incidence graph.

Nodes are neighbours when they share a hub (artist - related artist, part -
order).  The graph stays as (node, hub) incidence rows: each hop joins the
expanded frontier to its hubs and the hubs back to their nodes, so the cost
is proportional to the frontier's degree and no all-pairs edge list is ever
built.  Caps of the reference (expand at most ``per_hop`` frontier nodes,
stop at ``max_nodes``) are applied exactly, in a deterministic order given by
``uniform(seed, ...)`` in place of a random shuffle.  Each hop's result is
checkpointed to the shared checkpoint directory, which cuts the lineage of
the loop and lets a lost executor's work be recovered from storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartwise.functions.columns import uniform
from chartwise.session import ensure_checkpoint_dir


def bfs_expand(incidence: DataFrame, seeds: DataFrame, depth: int = 2, per_hop: int | None = None,
               max_nodes: int | None = None, seed: int = 42, node: str = "node", hub: str = "hub") -> DataFrame:
    """Return (node, depth) for the seeds (depth 0) and every node discovered.

    Hop d: the frontier is ordered by uniform(seed, d, node) and its first
    ``per_hop`` nodes are expanded, in that order (their rank is the priority
    of what they discover).  New nodes are ordered by (best parent rank,
    uniform(seed, 'c', d, node), node) and admitted until ``max_nodes`` are
    known. Both bounds are off by default: then every node within ``depth`` hops is found, and no order is needed.
    """
    spark = incidence.sparkSession
    ensure_checkpoint_dir(spark)
    inc = incidence.select(F.col(node).alias("node"), F.col(hub).alias("hub")).filter(
        F.col("node").isNotNull() & F.col("hub").isNotNull())
    visited = seeds.select(F.col(node).alias("node")).filter(F.col("node").isNotNull()).distinct() \
        .withColumn("depth", F.lit(0)).checkpoint()
    n_visited = visited.count()
    frontier = visited.select("node")
    for d in range(1, depth + 1):
        room = None if max_nodes is None else max_nodes - n_visited
        if room is not None and room <= 0:
            break
        if per_hop is None:
            expanded = frontier.withColumn("prank", F.lit(0))
        else:
            expanded = (frontier.withColumn("u", uniform(seed, F.lit(d), F.col("node")))
                        .orderBy("u", "node").limit(per_hop))
            # rank of each expanded node: a window over at most per_hop rows
            expanded = expanded.withColumn("prank", F.row_number().over(Window.orderBy("u", "node")))
        hubs = expanded.join(inc, "node").groupBy("hub").agg(F.min("prank").alias("prank"))
        cand = hubs.join(inc, "hub").groupBy("node").agg(F.min("prank").alias("prank"))
        cand = cand.join(visited.select("node"), "node", "left_anti")
        if room is not None:
            cand = cand.withColumn("u", uniform(seed, F.lit("c"), F.lit(d), F.col("node"))).orderBy("prank", "u", "node").limit(room)
        new = cand.select("node", F.lit(d).alias("depth")).checkpoint()
        n_new = new.count()
        if n_new == 0:
            break
        visited = visited.unionByName(new).checkpoint()
        n_visited += n_new
        frontier = new.select("node")
    return visited
