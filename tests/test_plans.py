"""Physical-plan checks: pushdown, pruning, broadcast choices, no global windows on raw rows."""

import contextlib
import io


from chartwise.operators.ingest import keep_first
from chartwise.operators.split import stratified_split
from chartwise.plans import QUERIES, views
from chartwise.sources.tables import read_table

from folders import SF_SMALL


def plan(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def executed_plan(df):
    df.write.format("noop").mode("overwrite").save()
    return plan(df)


def test_scan_pushdown_and_pruning(spark):
    p = plan(QUERIES["scan_parquet"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(event_type), IsNotNull(value), EqualTo(event_type,purchase), GreaterThan(value,10.0)]" in p
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in p
    assert "props" not in p.split("ReadSchema")[1].split("\n")[0]


def test_fact_view_prunes_lineitem_and_broadcasts_checked_dimension(spark):
    p = plan(views.facts(spark, SF_SMALL))
    li = [line for line in p.splitlines() if line.startswith("ReadSchema: struct<l_orderkey")]
    assert li and all("l_comment" not in x and "l_shipdate" not in x for x in li)
    assert "BroadcastHashJoin LeftOuter" in p


def test_genre_rank_joins_preaggregated_facts(spark):
    p = executed_plan(QUERIES["genre_rank"](spark, SF_SMALL))
    # per-artist partial + final aggregate before the exploded-genre join
    head = p.split("BroadcastHashJoin Inner")[1]
    assert "HashAggregate" in head.split("\n")[1] or "HashAggregate" in head


def test_exact_split_has_no_single_partition_exchange(spark):
    t = views.tracks(spark, SF_SMALL).select("track_id", "charted").checkpoint()
    p = executed_plan(stratified_split(t, "track_id", "charted"))
    assert "SinglePartition" not in p
    assert "Window" not in p and "Join" not in p and "Exchange" not in p  # rows are labelled where they are


def test_keep_first_is_an_aggregate_not_a_window(spark):
    li = read_table(spark, SF_SMALL, "lineitem", ["l_orderkey", "l_linenumber", "l_shipdate", "l_partkey"])
    p = plan(keep_first(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey"]))
    assert "Window" not in p
    assert "HashAggregate" in p or "ObjectHashAggregate" in p or "SortAggregate" in p


def test_group_rates_use_partial_aggregation(spark):
    p = plan(QUERIES["collab_tiers"](spark, SF_SMALL))
    assert p.count("HashAggregate") >= 2  # partial (map side) + final


def test_no_cross_or_nested_loop_joins_in_any_oracle_query(spark):
    import __spark_entry__ as entry
    qs = entry.queries()
    bad = {}
    for name in sorted(set(entry.oracle_sql()) - {"analysis_report", "advanced_report"}):  # they run the others
        p = plan(qs[name](spark, SF_SMALL))
        hits = [k for k in ("CartesianProduct", "BroadcastNestedLoopJoin") if k in p]
        if hits:
            bad[name] = hits
    assert not bad, bad
