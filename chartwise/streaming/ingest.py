"""Structured Streaming forms of incremental ingest (A8) and batch scoring.

Both read files with a file source and run with ``trigger(availableNow=True)``: everything present is processed in
bounded micro-batches, progress lives in the checkpoint location on shared storage, and a restarted query
resumes where it stopped.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB: a batch reads and writes the keys that it holds."""
    old = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(STATE_STORE) if old is None else spark.conf.set(STATE_STORE, old)


def stream_dedup_append(spark: SparkSession, source_dir: str, schema: StructType, key: str, order: str,
                        out_dir: str, checkpoint_dir: str, max_files_per_trigger: int = 1):
    """A8 streaming: the first row of a key wins, however late or old its repeats are; returns the finished query.

    The state holds, per key, the smallest (time of the micro-batch, ``order``, other columns): earlier batches win, and
    within a batch the first by ``order``, combined map-side, so a hot key is one row a task. Of the keys that a batch
    touches, those whose row is of this batch are new; they are written to the folder ``batch=<id>``. The written table is
    never read and nothing is forgotten (no watermark). A batch that is run again after a failure has the time of its
    first run from the offset log and overwrites its folder, so its rows appear once. Null keys are one key, as in
    :func:`chartwise.operators.ingest.keep_first`. The driver's clock must not run backwards between runs.
    """
    def append(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out_dir}/batch={batch}")

    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir)
    rest = [c for c in schema.names if c not in (key, order)]
    first = (src.withColumn("_seen", F.current_timestamp()).groupBy(key).agg(F.min(F.struct("_seen", order, *rest)).alias("_m"))
             .filter(F.col("_m._seen") == F.current_timestamp()))
    fresh = first.select(*[F.col(c) if c == key else F.col("_m")[c].alias(c) for c in schema.names])
    with keyed_state(spark):
        q = (fresh.writeStream.outputMode("update").foreachBatch(append).option("checkpointLocation", checkpoint_dir)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return q


def stream_transform(spark: SparkSession, source_dir: str, schema: StructType, transform, out_dir: str,
                     checkpoint_dir: str, max_files_per_trigger: int = 1) -> None:
    """K12 streaming: a stateless transform (e.g. a fitted pipeline) over arriving files."""
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(source_dir))
    q = (transform(src).writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
