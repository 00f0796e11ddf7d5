"""File sources and sinks: CSV, partitioned parquet, JSON reports, model folders.

Paths are expected on shared storage (the checkpoint folder's file system in
tests); every write is a Spark job, nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A5: header line, RFC-4180 quoting (embedded quotes doubled)."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None, multi_line: bool = False) -> DataFrame:
    """A1: header, quoted fields with commas and quotes; explicit schema (no inference pass).

    Files are split among tasks. ``multi_line`` allows line ends inside quotes, for which a file is read by one task.
    """
    r = (spark.read.option("header", True).option("quote", '"').option("escape", '"')
         .option("multiLine", multi_line).option("mode", "PERMISSIVE"))
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", True)
    return r.csv(path)


def write_partitioned(df: DataFrame, path: str, by: str, mode: str = "overwrite") -> None:
    """A4: one job writes every split; readers prune partitions by ``by``."""
    df.write.mode(mode).partitionBy(by).parquet(path)


def resolve_source(spark: SparkSession, candidates) -> DataFrame:
    """A3: first existing source among (path, format) candidates; error if none exists."""
    for path, fmt in candidates:
        try:
            return read_csv(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError("No dataset found among: " + ", ".join(p for p, _ in candidates))


def write_report(sections: dict, path: str, mode: str = "overwrite") -> None:
    """A report as JSON lines (section, record) - each section is a small result DataFrame."""
    out = None
    for name, df in sections.items():
        part = df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("record"))
        out = part if out is None else out.unionByName(part)
    # sections are computed in their own tasks; only their few records meet in the document
    out.repartition(1).sortWithinPartitions("section", "record").write.mode(mode).json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Read a report written by :func:`write_report`."""
    return spark.read.schema("section string, record string").json(path)
