"""Corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing; each stage is written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartwise.llm import decontam, line_dedup, packing, simhash, toxicity
from chartwise.llm.common import aside, back, land, quoted
from chartwise.sources.tables import read_table


def narrow(docs: DataFrame, *own: str) -> DataFrame:
    """``docs`` as the columns ``own`` and all others packed into ``row``, so that no names clash with an operator's."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns if c not in own]).alias("row"), *own)


def restored(found: DataFrame, columns: list[str], **own: Column) -> DataFrame:
    """The columns of documents again, those of ``own`` as given."""
    return found.select(*[(own[c] if c in own else F.col("row").getField(c)).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the given labels, doesn't reject (score under 0.5). Texts are judged
    whole; null and empty ones have no toxic window; an empty table or labels of one class reject accordingly."""
    model = toxicity.learn(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return restored(toxicity.score(narrow(docs, "text"), model).filter("__score < 0.5"), docs.columns, text=F.col("text"))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the lines that at least three of them hold, which stay in the largest id. ``n_chars`` follows
    the text. Odd rows: see :func:`line_dedup.dedup_lines`; a null text becomes an empty one."""
    new = {"doc_id": F.col("doc_id"), "text": F.col("__text"), "n_chars": F.length("__text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return restored(line_dedup.dedup_lines(narrow(docs, "doc_id", "text")), docs.columns, **new)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id (of rows without an id or with the same, any one).
    Rows are told apart by numbers of their own, so repeated and null ids are no matter; empty texts are a group."""
    rows = land(aside(docs, rid=F.monotonically_increasing_id(), doc=F.col("doc_id"), text=F.col("text")), "numbered")
    groups = simhash.near_duplicates(rows.select("rid", "text"), size=4, radius=4, id_col="rid").select(F.col("doc_id").alias("rid"), "component_id")
    stays = (rows.select("rid", "doc").join(groups, "rid")
             .groupBy("component_id").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "rid")).alias("s")).select(F.col("s.rid").alias("rid")))
    return back(rows.join(stays, "rid", "left_semi"), docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs. Odd rows: see :func:`decontam.hits`."""
    found, _ = decontam.hits(narrow(docs, "doc_id", "text"), read_table(spark, sf_dir, "benchmark"), width=10)
    return restored(found.filter("__n_hit = 0"), docs.columns, doc_id=F.col("doc_id"), text=F.col("text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens; the last stage. Odd rows: see :func:`packing.pack`."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), room=1024, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
