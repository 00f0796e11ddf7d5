"""Exact linear-interpolated quantiles (pandas/numpy ``quantile``) by radix selection at any scale.

A double's bits, with those of negative numbers turned, order as the numbers do. A pass counts, for every column and
every prefix still of interest at once, how many rows have each value of the next DIGIT bits; histograms add up
map-side and by a shuffle, and the digit that holds each wanted rank extends its prefix. Sixteen bits a digit make four
passes for 64 bits whatever the data; as soon as the rows left under all prefixes are at most KEEP, one pass fetches
their values instead. A value held by a third of all rows is one bin; the driver sees bins, never rows without a bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits that a pass tells apart; rows whose values are fetched at once.
DIGIT, KEEP = 16, 100_000


def lerp(a: float, b: float, t: float) -> float:
    """numpy's linear interpolation (the form with the t >= 0.5 branch)."""
    d = b - a
    return b - d * (1.0 - t) if t >= 0.5 else a + d * t


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """uint64 keys in the order of the doubles; -0.0 is 0.0 and NaN comes last."""
    bits = (values + 0.0).view("u8")
    bits = np.where(np.isnan(values), np.uint64(0x7FF8000000000000), bits)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def value_of(key: int) -> float:
    """The double of a key."""
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.array([bits], "u8").view("f8")[0])


def digits(df: DataFrame, prefixes: dict[int, list[int]], level: int, nan_as_null: bool) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """{(column, prefix): (digits in order, rows of each)} after ``level`` digits; all columns in one pass.

    At most 2^DIGIT rows for each prefix come to the driver."""
    shared = df.sparkSession.sparkContext.broadcast({c: np.array(sorted(p), "u8") for c, p in prefixes.items()})
    rest, mask = np.uint64(64 - DIGIT * (level + 1)), np.uint64((1 << DIGIT) - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {c: [] for c in shared.value}

        def added(parts: list[np.ndarray]) -> np.ndarray:
            table = np.concatenate(parts)
            keys, place = np.unique(table[:, 0], return_inverse=True)
            return np.stack([keys, np.bincount(place, weights=table[:, 1]).astype("u8")], axis=1)

        for batch in batches:
            for c, known in shared.value.items():
                keys = keys_of(batch.column(c), nan_as_null)
                if level:
                    head = keys >> (rest + np.uint64(DIGIT))
                    at = np.minimum(np.searchsorted(known, head), len(known) - 1)
                    keys = keys[known[at] == head]
                # (prefix, digit) is the key without its last bits
                found, n = np.unique(keys >> rest, return_counts=True)
                held[c].append(np.stack([found, n.astype("u8")], axis=1))
                if len(held[c]) > 16:
                    held[c] = [added(held[c])]
        out = [(c, added(parts)) for c, parts in held.items() if parts]
        yield pa.RecordBatch.from_pydict({
            "c": pa.array(np.repeat([c for c, _ in out], [len(t) for _, t in out]).astype("i4")),
            "k": pa.array(np.concatenate([t[:, 0] for _, t in out] or [np.zeros(0, "u8")]).view("i8")), "n": pa.array(np.concatenate([t[:, 1] for _, t in out] or [np.zeros(0, "u8")]).astype("i8"))})

    found = df.mapInArrow(count, "c int, k long, n long").groupBy("c", "k").agg(F.sum("n").alias("n")).toArrow()
    c, k, n = found["c"].to_numpy(), found["k"].to_numpy().view("u8"), found["n"].to_numpy()
    order = np.lexsort((k, c))
    c, k, n = c[order], k[order], n[order]
    out = {}
    for column, known in prefixes.items():
        own = c == column
        for prefix in known:
            mine = own & (k >> np.uint64(DIGIT) == np.uint64(prefix)) if level else own
            out[column, prefix] = k[mine] & mask, n[mine]
    return out


def keys_of(column: pa.Array, nan_as_null: bool) -> np.ndarray:
    values = column.drop_null().to_numpy(zero_copy_only=False)
    return ordered_bits(values[~np.isnan(values)] if nan_as_null else values)


def fetched(df: DataFrame, prefixes: dict[int, list[int]], level: int, nan_as_null: bool) -> dict[int, np.ndarray]:
    """Sorted keys of the rows under the prefixes, which are known to be few."""
    shared = df.sparkSession.sparkContext.broadcast({c: np.array(sorted(p), "u8") for c, p in prefixes.items()})
    rest = np.uint64(64 - DIGIT * level)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, known in shared.value.items():
                keys = keys_of(batch.column(c), nan_as_null)
                keys = keys[np.isin(keys >> rest, known)]
                yield pa.RecordBatch.from_pydict({"c": pa.array(np.full(len(keys), c, "i4")), "k": pa.array(keys.view("i8"))})

    found = df.mapInArrow(pick, "c int, k long").toArrow()
    c, k = found["c"].to_numpy(), found["k"].to_numpy().view("u8")
    return {column: np.sort(k[c == column]) for column in prefixes}


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], nan_as_null: bool = True, keep: bool = True) -> dict:
    """{(col, p): value} (None for a column without values). The passes read ``cols`` alone: at most four, of two stages
    each. ``keep`` persists those columns meanwhile (False: each pass reads ``df`` again, for a plain scan)."""
    cols, probs = list(dict.fromkeys(cols)), list(probs)
    narrow = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    if not keep:
        return selected(narrow, cols, probs, nan_as_null)
    narrow = narrow.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return selected(narrow, cols, probs, nan_as_null)
    finally:
        narrow.unpersist()


def selected(narrow: DataFrame, cols: list[str], probs: list[float], nan_as_null: bool) -> dict:
    """The passes of :func:`exact_quantiles` over columns c0, c1, ..."""
    result: dict = {(c, p): None for c in cols for p in probs}
    # (column, rank) -> (prefix, rank under it)
    open_ranks: dict[tuple[int, int], tuple[int, int]] = {}
    wanted: dict[tuple[str, float], tuple[int, int, int, float]] = {}
    keys: dict[tuple[int, int], int] = {}
    level = 0
    while True:
        prefixes: dict[int, list[int]] = {}
        for (column, _), (prefix, _) in open_ranks.items():
            if prefix not in prefixes.setdefault(column, []):
                prefixes[column].append(prefix)
        bins = digits(narrow, prefixes if level else {i: [0] for i in range(len(cols))}, level, nan_as_null)
        if not level:
            for i, c in enumerate(cols):
                n = int(bins[i, 0][1].sum())
                for p in probs if n else ():
                    h = (n - 1) * p
                    low = int(math.floor(h))
                    wanted[c, p] = (i, low, min(low + 1, n - 1), h - low)
                    open_ranks |= {(i, low): (0, low), (i, min(low + 1, n - 1)): (0, min(low + 1, n - 1))}
        left = {}
        for name, (prefix, rank) in open_ranks.items():
            digit, n = bins[name[0], prefix]
            ends = np.cumsum(n)
            at = int(np.searchsorted(ends, rank, side="right"))
            open_ranks[name] = (prefix << DIGIT | int(digit[at]), rank - int(ends[at] - n[at]))
            left[name[0], open_ranks[name][0]] = int(n[at])
        level += 1
        if DIGIT * level == 64 or not open_ranks:
            keys = {name: prefix for name, (prefix, _) in open_ranks.items()}
            break
        if sum(left.values()) <= KEEP:
            prefixes = {}
            for column, prefix in left:
                prefixes.setdefault(column, []).append(prefix)
            found = fetched(narrow, prefixes, level, nan_as_null)
            for (column, rank), (prefix, under) in open_ranks.items():
                own = found[column]
                keys[column, rank] = int(own[np.searchsorted(own >> np.uint64(64 - DIGIT * level), np.uint64(prefix), side="left") + under])
            break
    for name, (i, low, high, t) in wanted.items():
        result[name] = lerp(value_of(keys[i, low]), value_of(keys[i, high]), t)
    return result
