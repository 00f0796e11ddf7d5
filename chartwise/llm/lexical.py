"""Ranked lexical search, reversed: an inverted index over the items' terms is broadcast and documents stream through it.

One pass cuts every whole text into terms and keeps, per document, how often it holds each term that some item
has; the collection's statistics are aggregates of that table. The second pass scores batches of documents
against the broadcast index and updates one bounded heap per item; the heaps of all tasks are merged in two
rounds. Items are taken in blocks of about BLOCK_BYTES of text (or one longer item), so neither the index nor the
driver's share of it grows with the items; every block streams the documents once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartwise.llm.common import NULL_ID, doc_columns, land
from chartwise.llm.vocab import close, slices

#: Bytes of item text in a block; cells of a batch's score table; pairs of term occurrence and item expanded at once.
BLOCK_BYTES, CELLS, EXPANDED = 8 << 20, 2_000_000, 2_000_000

#: Sums of contributions up to this one are exact in doubles.
EXACT = 1 << 53


def letters() -> np.ndarray:
    """Byte -> byte: digits, letters (A-Z lower-cased) and bytes of other characters; the rest become blanks."""
    return np.array([b if b >= 128 or chr(b).isalnum() else 32 for b in (b + 32 if 65 <= b <= 90 else b for b in range(256))], dtype="u1")


LETTERS = letters()


def cut(texts: pa.Array) -> pa.ListArray:
    """The terms of each text (null: none), with empty strings among them."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype="i4")[texts.offset: texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype="u1")[ends[0]: ends[-1]] if data is not None else np.zeros(0, "u1")
    return pc.split_pattern(pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer((ends - ends[0]).astype("i4")), pa.py_buffer(LETTERS[raw].tobytes())]), " ")


class Index(NamedTuple):
    """Terms of a block's items; the items (by position) with term t are items[first[t]:first[t + 1]]."""

    terms: pa.Array
    first: np.ndarray
    items: np.ndarray
    rows: np.ndarray  # row number of each item
    largest: int      # terms of the item that has most


def indexed(rows: list, texts: list) -> Index:
    units = cut(pa.array(texts, pa.string()))
    flat = units.flatten()
    item = np.repeat(np.arange(len(units)), np.diff(units.offsets.to_numpy()))
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    flat = flat.filter(pa.array(full)).dictionary_encode()
    pairs = np.unique(flat.indices.to_numpy(zero_copy_only=False).astype("i8") * max(1, len(units)) + item[full])
    term, item = np.divmod(pairs, max(1, len(units)))
    first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(flat.dictionary)))]).astype("i8")
    return Index(flat.dictionary, first, item, np.array(rows, "i8"), int(np.bincount(item).max(initial=0)))


def counted(docs: DataFrame, index) -> DataFrame:
    """doc_id, n (terms with repeats), and the index's terms in the text with their occurrences."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        close()
        known = index.value.terms
        for part in slices(batches):
            units = cut(part.column("text"))
            flat = units.flatten().dictionary_encode()
            codes = flat.indices.to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(units)), np.diff(units.offsets.to_numpy()))
            blank = pc.index(flat.dictionary, "").as_py()
            n = np.bincount(doc if blank < 0 else doc[codes != blank], minlength=len(units))
            place = pc.fill_null(pc.index_in(flat.dictionary, known), -1).to_numpy(zero_copy_only=False)[codes]
            hit = place >= 0
            keys, tf = np.unique(doc[hit] * max(1, len(known)) + place[hit], return_counts=True)
            at = np.concatenate([[0], np.cumsum(np.bincount(keys // max(1, len(known)), minlength=len(units)))]).astype("i4")
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "n": pa.array(n, pa.int64()),
                "terms": pa.ListArray.from_arrays(pa.array(at), pa.array(keys % max(1, len(known)), pa.int32())),
                "tfs": pa.ListArray.from_arrays(pa.array(at), pa.array(tf, pa.int64()))})

    return docs.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>")


class Heaps:
    """The ``size`` best (score, document) of each item: highest score first, then the smallest id."""

    def __init__(self, n_items: int, size: int):
        self.size = size
        self.item, self.score, self.doc = (np.zeros(0, "i8") for _ in range(3))
        self.least = np.ones(n_items, "i8")  # what a document must reach

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        item, score, doc = np.concatenate([self.item, item]), np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, "i8")
        place = np.arange(len(item)) - np.repeat(starts, np.diff(np.r_[starts, len(item)]))
        last = place == self.size - 1
        self.least[item[last]] = score[last]
        kept = place < self.size
        self.item, self.score, self.doc = item[kept], score[kept], doc[kept]


def sums(keys: np.ndarray, values: np.ndarray, n: int, bound: int) -> np.ndarray:
    """Exact sums per key: in one part if no sum passes what a double holds exactly, else in two."""
    if bound < EXACT:
        return np.bincount(keys, weights=values, minlength=n).astype("i8")
    high = np.bincount(keys, weights=values >> 26, minlength=n).astype("i8")
    return (high << 26) + np.bincount(keys, weights=values & ((1 << 26) - 1), minlength=n).astype("i8")


def scored(rows: DataFrame, index, weights, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """Each task's heaps: place (its number), row (the item's), score, doc_id."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        close()
        found, weight = index.value, weights.value
        n_items = len(found.rows)
        heaps, width = Heaps(n_items, top), np.diff(found.first)
        bound = found.largest * int(weight.max(initial=0)) * 1_000_000
        for batch in batches:
            ids = pc.fill_null(batch.column("doc_id"), NULL_ID).to_numpy(zero_copy_only=False)
            n = batch.column("n").to_numpy(zero_copy_only=False)
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            lists = batch.column("terms")
            term = lists.flatten().to_numpy(zero_copy_only=False)
            tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            doc = np.repeat(np.arange(len(ids)), np.diff(ends))
            worth = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
            made = np.concatenate([[0], np.cumsum(width[term])])
            at = 0
            while at < len(ids):
                # as many documents as fit the score table and the expansion, at least one
                fit = int(np.searchsorted(made[ends], made[ends[at]] + EXPANDED, side="right")) - 1
                to = min(len(ids), at + max(1, CELLS // max(1, n_items)), max(at + 1, fit))
                a, b = int(ends[at]), int(ends[to])
                times = width[term[a:b]]
                take = np.repeat(found.first[term[a:b]] - (made[a:b] - made[a]), times) + np.arange(int(made[b] - made[a]))
                key = found.items[take] * (to - at) + np.repeat(doc[a:b] - at, times)
                total = sums(key, np.repeat(worth[a:b], times), n_items * (to - at), bound).reshape(n_items, to - at)
                item, col = np.nonzero(total >= heaps.least[:, None])
                if len(item):
                    heaps.add(item, total[item, col], ids[at + col])
                at = to
        yield pa.RecordBatch.from_pydict({
            "place": pa.array(np.full(len(heaps.item), TaskContext.get().partitionId()), pa.int64()), "row": pa.array(found.rows[heaps.item], pa.int64()),
            "score": pa.array(heaps.score, pa.int64()), "doc_id": pa.array(heaps.doc, pa.int64())})

    return rows.mapInArrow(score, "place long, row long, score long, doc_id long")


def search(docs: DataFrame, items: DataFrame, top: int = 10, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per item its ``top`` documents with a score above 0: item_id, rank (from 1), doc_id, score.

    Equal scores rank by ascending document id, null ids first. Null and empty texts have no terms, so neither
    such documents nor such items appear. Rows that repeat an id are documents (items) of their own. Empty tables
    give an empty result; other columns aren't read. Texts of any length are cut whole.
    """
    spark = docs.sparkSession
    docs = doc_columns(docs, id_col, text_col)
    items = land(items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                              F.monotonically_increasing_id().alias("row")), "items")
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-n_bytes // BLOCK_BYTES))
    heaps = []
    for block in range(n_blocks):
        own = items.filter(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == block).select("row", "text").toArrow()
        found = indexed(own["row"].to_pylist(), own["text"].to_pylist())
        index = spark.sparkContext.broadcast(found)
        rows = land(counted(docs, index), "term-counts")
        n_docs, n_terms = rows.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = rows.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # at most the block's terms
        df = np.zeros(len(found.terms), "i8")
        df[held["term"].to_numpy()] = held["count"].to_numpy()
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], "i8")
        heaps.append(scored(rows, index, spark.sparkContext.broadcast(weights), n_docs, max(1, n_terms), top))
    best = F.col("score").desc(), F.col("doc_id").asc()
    every = reduce(DataFrame.unionAll, heaps)
    # a task's heaps meet those of some other tasks first, so no group holds the heaps of all
    some = Window.partitionBy("row", F.col("place") % 64).orderBy(*best)
    every = every.withColumn("r", F.row_number().over(some)).filter(F.col("r") <= top)
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*best))).filter(F.col("rank") <= top)
    return ranked.join(items.select("row", "item_id"), "row").select(
        "item_id", "rank", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "score")
