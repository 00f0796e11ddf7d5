"""The quality classifier: scores recomputed from the vectors, held-out accuracy, odd rows."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartwise.llm import classifier
from chartwise.sources.tables import read_table

SF = "/root/testdata/sf0.01"


def plain_score(model, text):
    """The average of all vectors of a text, one after another, through the layer."""
    total, n, last = np.array(model.vectors[classifier.TEXT]), 1, None
    for word in (text or "").translate({c: " " for c in range(9, 14)}).split(" "):
        if not word:
            continue
        for bucket in classifier.word_features([word])[1]:
            total, n = total + model.vectors[bucket], n + 1
        if word == last:
            total, n = total + model.vectors[classifier.AGAIN], n + 1
        last = word
    a, b = total / n @ model.layer + model.bias
    return 1 / (1 + math.exp(min(700, a - b)))


@pytest.fixture(scope="module")
def model(spark):
    return classifier.learn(read_table(spark, SF, "documents"), read_table(spark, SF, "labels"), "quality")


def test_scores_are_those_of_the_vectors(spark, make, odd_rows, model):
    rows = [(i, t) for i, t in enumerate(t for _, t in odd_rows)]
    want = {i: plain_score(model, t) for i, t in rows}
    for parts in (1, 5):
        got = classifier.score(make(spark, rows, parts).withColumn("score", F.lit("clash")).withColumn("a.b", F.lit(1)), model).collect()
        assert len(got) == len(rows)
        assert all(abs(r.score - want[r.doc_id]) < 1e-9 for r in got)
    assert abs(model.score(rows[20][1]) - want[20]) < 1e-9


def test_held_out_accuracy(spark, model):
    texts = read_table(spark, SF, "documents").join(read_table(spark, SF, "labels"), "doc_id").select("doc_id", "text", "quality").collect()
    rest = [(model.score(r.text or ""), r.quality) for r in texts if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    pairs = [(a > b) + 0.5 * (a == b) for a, y in rest if y == 1 for b, z in rest if z == 0]
    assert len(rest) > 50 and np.mean(pairs) > 0.97
    assert np.mean([(s >= 0.3) == y for s, y in rest]) > 0.95


def test_learning_is_bounded_repeatable_and_blind_to_held_out_rows(spark, model, monkeypatch):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = classifier.learn(docs.repartition(7), turned.repartition(3), "quality")
    assert np.array_equal(again.vectors, model.vectors) and np.array_equal(again.layer, model.layer)
    monkeypatch.setattr(classifier, "SAMPLE_BYTES", 40_000)
    texts, _ = classifier.sample(docs, labels, "doc_id", "text", "quality")
    assert 1 < len(texts) and sum(len(t.encode()) for t in texts) <= 40_000
    monkeypatch.setattr(classifier, "SAMPLE_ROWS", 9)
    assert len(classifier.sample(docs, labels, "doc_id", "text", "quality")[0]) <= 9


def test_labels_of_one_class_none_and_empty_tables(spark, make):
    docs = make(spark, [(1, "some words"), (2, None), (None, "")])
    labels = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, 0), (6, None)], "doc_id long, quality int")
    learnt = classifier.learn(docs, labels, "quality")
    assert all(r.score > 0.99 for r in classifier.score(docs, learnt).collect())
    blank = classifier.learn(docs, labels.limit(0), "quality")
    assert all(r.score == 0.5 for r in classifier.score(docs, blank).collect())
    assert classifier.score(make(spark, []), blank).count() == 0
