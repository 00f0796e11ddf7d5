"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartwise.session import ensure_checkpoint_dir

#: Stands for a null id while rows are grouped and joined; smaller than any id in use.
NULL_ID = -(1 << 63)

_LANDED: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint folder, removed when the interpreter ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"
    _LANDED.append((spark, path))
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`scratch` gave."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def land(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written to shared storage: lineage ends here, so a lost executor costs a reread."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clear() -> None:
    for spark, path in _LANDED:
        try:
            if spark.sparkContext._jsc is not None:
                discard(spark, path)
        except Exception:  # the session is gone: its shared folder outlives it
            return


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def aside(docs: DataFrame, **own: Column) -> DataFrame:
    """``docs`` with all its columns packed into one, ``row``, beside an operator's own, so that no names clash."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in own.items()])


def back(packed: DataFrame, columns: list[str], **results: Column) -> DataFrame:
    """The columns that :func:`aside` packed and the results, which take the place of columns of the same name."""
    return packed.select(*[F.col("row").getField(c).alias(c) for c in columns if c not in results], *[c.alias(n) for n, c in results.items()])


def doc_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the whole text (null: empty), under names of our own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def id_key(id_col: str):
    """The id as a long that is never null."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
