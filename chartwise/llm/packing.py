"""Best-fit packing of documents into fixed-length sequences, without a global sort.

Each partition packs its own pieces by best-fit decreasing. Nearly full sequences are final; the underfull ones
become items of their own size for the next round, in which groups of them are best-fit packed again, and so
on up the tree until a round ends in one group or joins almost nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwise.llm.common import doc_columns, land
from chartwise.llm.vocab import UnitIds, opened, slices, with_end

#: Bytes of text that a task encodes at once: the arrays of a slice take some fifteen times its bytes.
SLICE = 1 << 20

#: Pieces that a task packs at once, underfull bins of a merge group, and free tokens at which a bin is nearly full.
PACK, GROUP, SLACK = 262_144, 8192, 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, closed boolean"


def best_fit(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item by best-fit decreasing; ties by position, so the result is repeatable."""
    bins, offsets = np.empty(len(sizes), dtype="i8"), np.empty(len(sizes), dtype="i8")
    free: list[list[int]] = [[] for _ in range(room + 1)]
    open_rooms = made = 0  # a bit for each amount of room that some bin has left
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = open_rooms >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                open_rooms ^= 1 << left
        else:
            left, b, made = room, made, made + 1
        bins[i], offsets[i] = b, room - left
        if left > size:
            free[left - size].append(b)
            open_rooms |= 1 << (left - size)
    return bins, offsets


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, room: int) -> DataFrame:
    """Cut, packed within the task."""
    def packed(rows: list[tuple], first_bin: int) -> tuple[pa.RecordBatch, int]:
        doc, piece, start, length, crc = map(list, zip(*rows, strict=True))
        sizes = np.array(length, dtype="i8")
        bins, offsets = best_fit(sizes, room)
        fill = np.bincount(bins, weights=sizes).astype("i8")
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
            "ids_crc32": pa.array(crc, pa.int64()), "bin": pa.array(bins + first_bin, pa.int64()), "offset": pa.array(offsets, pa.int64()), "closed": pa.array(fill[bins] >= room - SLACK)}), first_bin + len(fill)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit_ids, rows, next_bin = opened(UnitIds, tokenizer_path), [], TaskContext.get().partitionId() << 32
        for part in slices(batches, size=SLICE):
            first, ids = with_end(*unit_ids.encode(part.column("text")), end_id)
            raw = memoryview(ids.astype("<u4").tobytes())
            for doc, a, b in zip(part.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                edges = [a, *range(a + ((b - a) % room or room), b + 1, room)]
                rows += [(doc, k, x - a, y - x, zlib.crc32(raw[4 * x:4 * y])) for k, (x, y) in enumerate(zip(edges, edges[1:], strict=False))]
            if len(rows) >= PACK:
                batch, next_bin = packed(rows, next_bin)
                rows = []
                yield batch
        if rows:
            yield packed(rows, next_bin)[0]

    return docs.mapInArrow(cut, PIECES)


def merger(mark: int, last: bool, room: int):
    """Best-fit of one group of underfull bins, each an item of its fill; the members' bases move along."""
    def merge(group: pd.DataFrame) -> pd.DataFrame:
        g = int(group["g"].iloc[0])
        group = group.sort_values(["sequence", "bin"], kind="stable")
        items, at = np.unique(group["sequence"].to_numpy(), return_inverse=True)
        fills = np.bincount(at, weights=group["fill"]).astype("i8")
        bins, offsets = best_fit(fills, room)
        total = np.bincount(bins, weights=fills).astype("i8")
        group["base"] = group["base"].to_numpy() + offsets[at]
        group["sequence"] = mark + (g << 24) + bins[at]
        group["closed"] = (total[bins[at]] >= room - SLACK) | last
        return group[["bin", "fill", "sequence", "base", "closed"]]

    return merge


def merged(open_bins: DataFrame, room: int) -> DataFrame:
    """bin -> (sequence, base) for underfull bins (bin, fill), merged round by round."""
    spark = open_bins.sparkSession
    shape = "bin long, fill long, sequence long, base long"
    state = land(open_bins.select("bin", "fill", F.col("bin").alias("sequence"), F.lit(0).cast("long").alias("base")), "bins")
    done, n, level = [], state.count(), 1
    while n:
        groups = -(-n // GROUP)
        by = state.withColumn("g", F.pmod(F.xxhash64("sequence", F.lit(level)), F.lit(groups)))
        result = land(by.groupBy("g").applyInPandas(merger(level << 56, groups == 1, room), shape + ", closed boolean"), "bins")
        left = result.filter("not closed").agg(F.countDistinct("sequence")).first()[0]
        if left > 0.98 * n:  # hardly two of them fit together any more
            done.append(result.drop("closed"))
            break
        done.append(result.filter("closed").drop("closed"))
        state, n, level = result.filter("not closed").drop("closed"), left, level + 1
    out = spark.createDataFrame([], shape)
    for part in done:
        out = out.unionByName(part)
    return out


def pack(docs: DataFrame, tokenizer_path: str, room: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents of more than ``room`` ids are cut; their first piece is the shorter one. A null text is one
    piece that holds the end id; null and repeated ids are packed like others; an empty table gives an empty
    one; other columns aren't read.
    """
    cut = land(pieces(doc_columns(docs, id_col, text_col), tokenizer_path, end_id, room), "pieces")
    open_bins = cut.filter("not closed").groupBy("bin").agg(F.sum("length").alias("fill"))
    to = merged(open_bins, room).select("bin", "sequence", "base")
    final = cut.filter("closed").withColumn("sequence_id", F.col("bin"))
    rest = (cut.filter("not closed").join(to, "bin").withColumn("sequence_id", F.col("sequence"))
            .withColumn("offset", F.col("offset") + F.col("base")))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return final.select(*columns).unionByName(rest.select(*columns))
