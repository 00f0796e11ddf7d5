"""Streaming queries (rows-only checks): streamed ingest with de-duplication,
streamed scoring.  Both must equal their batch counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartwise.operators.models import score
import chartwise.plans.q_ingest  # noqa: F401  (its oracle is used here)
from chartwise.plans.registry import ORACLES, register
from chartwise.session import scratch_dir
from chartwise.streaming.ingest import stream_dedup_append, stream_transform


@register("stream_incremental_append", ORACLES["incremental_append"])
def q_stream_incremental_append(spark, sf):
    """Incremental ingest as a resumable stream: the first batch lands and is processed,
    then the overlapping second batch lands and the same query resumes from its
    checkpoint; an event id already seen is dropped (the earlier row wins)."""
    from chartwise.plans.q_ingest import _event_batches
    existing, incoming = _event_batches(spark, sf)
    landing = scratch_dir(spark, "stream-in")
    out, ckpt = scratch_dir(spark, "stream-out"), scratch_dir(spark, "stream-ckpt")
    schema = existing.schema
    existing.write.mode("overwrite").parquet(f"{landing}/batch=0")
    stream_dedup_append(spark, landing, schema, "event_id", "ts", out, ckpt, max_files_per_trigger=1000)
    incoming.write.mode("overwrite").parquet(f"{landing}/batch=1")
    stream_dedup_append(spark, landing, schema, "event_id", "ts", out, ckpt, max_files_per_trigger=1000)
    return spark.read.parquet(out).drop("batch")


@register("stream_score")
def q_stream_score(spark, sf):
    """Every prepared row streamed through the chosen model."""
    from chartwise.plans.q_models import trained
    t = trained(spark, sf)
    rows = t.frame
    landing = scratch_dir(spark, "score-in")
    rows.write.mode("overwrite").parquet(landing)
    out, ckpt = scratch_dir(spark, "score-out"), scratch_dir(spark, "score-ckpt")
    model = t.model(t.best()[0])
    stream_transform(spark, landing, rows.schema,
                     lambda df: score(model, df).select("row_key", "score", "prediction"), out, ckpt,
                     max_files_per_trigger=spark.sparkContext.defaultParallelism)  # a micro-batch has a file for each core
    return spark.read.parquet(out)
