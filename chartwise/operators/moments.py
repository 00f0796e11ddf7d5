"""Exact, order-free sums of columns and of products of two columns.

A double is an integer of 53 bits times a power of two, and the product of two doubles is the sum of two doubles
(Dekker). Per group, term and power of two, the integers' upper and lower halves are added as integers, so partial
sums merge in any order to the same exact total: results don't depend on partitioning, and one division rounds them.
A task reads Arrow batches of all columns once and hands on one row per (group, term, power); groups are those of a
report (labels, periods), whose number the caller bounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of the lower half; what makes every power of two (from -1075 to 1024) a number from 0 to 4095.
HALF, SHIFT = 27, 2048


class Sum(NamedTuple):
    n: int
    total: Fraction

    @property
    def mean(self) -> float | None:
        """The exact sum, rounded, divided by the rows: what compensated summation gives."""
        return float(self.total) / self.n if self.n else None


def two_product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(p, e) with a * b = p + e exactly (for factors under 1e150 whose product isn't near the smallest doubles)."""
    def halves(x):
        c = 134217729.0 * x
        high = c - (c - x)
        return high, x - high

    p = a * b
    (ah, al), (bh, bl) = halves(a), halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def binned(values: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Rows (code, power, upper, lower, count) that add up to the values exactly."""
    if not len(values):
        return np.zeros((0, 5), "i8")
    mantissa, power = np.frexp(values)
    whole = np.ldexp(mantissa, 53).astype("i8")
    least = int(power.min())
    span = int(power.max()) - least + 1
    at = code * span + (power - least)
    n = np.bincount(at)
    seen = np.flatnonzero(n)
    # sums of a batch stay far below 2^53, so they are exact in doubles
    upper = np.bincount(at, weights=whole >> HALF).astype("i8")[seen]
    lower = np.bincount(at, weights=whole & ((1 << HALF) - 1)).astype("i8")[seen]
    return np.stack([seen // span, seen % span + least, upper, lower, n[seen]], axis=1)


def exact_sums(df: DataFrame, factors: dict[str, Column], terms: Sequence[tuple[str, ...]], by: Sequence[str] = ()) -> dict[tuple, dict[tuple, Sum]]:
    """{group: {term: (rows, exact sum)}}; a term is one factor's name or two, and counts the rows where all are numbers.

    Null, NaN and infinite values are left out. Without ``by`` the one group is (), also for an empty table. What comes
    to the driver is a row for each group, term and power of two that occurs.
    """
    names, terms, by = list(factors), list(terms), list(by)
    narrow = df.select(*[F.col(g).alias(f"g{i}") for i, g in enumerate(by)], *[factors[c].cast("double").alias(f"f{i}") for i, c in enumerate(names)])
    shape = T.StructType([*narrow.schema.fields[:len(by)], *[T.StructField(c, T.LongType()) for c in ("t", "e", "upper", "lower", "n")]])
    places = [[names.index(c) for c in term] for term in terms]
    n_by = len(by)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, int] = {}
        held = np.zeros((0, 5), "i8")  # key of (group, term, power), upper, lower, count
        waiting: list[np.ndarray] = []

        def merged() -> np.ndarray:
            table = np.concatenate([held, *waiting])
            keys, at = np.unique(table[:, 0], return_inverse=True)
            out = np.zeros((len(keys), 5), "i8")
            out[:, 0] = keys
            np.add.at(out[:, 1:], at, table[:, 1:])
            return out

        for batch in batches:
            code = np.zeros(batch.num_rows, "i8")
            encoded = [batch.column(i).dictionary_encode(null_encoding="encode") for i in range(n_by)]
            for column in encoded:
                code = code * max(1, len(column.dictionary)) + column.indices.to_numpy(zero_copy_only=False)
            _, first, code = np.unique(code, return_index=True, return_inverse=True)
            number = np.array([known.setdefault(tuple(c[int(i)].as_py() for c in encoded), len(known)) for i in first], "i8")
            values = [batch.column(n_by + i).to_numpy(zero_copy_only=False) for i in range(len(names))]
            finite = [np.isfinite(v) for v in values]
            for t, place in enumerate(places):
                if len(place) == 1:
                    ok = finite[place[0]]
                    parts = [(values[place[0]][ok], 1)]
                else:
                    ok = finite[place[0]] & finite[place[1]]
                    p, e = two_product(values[place[0]][ok], values[place[1]][ok])
                    parts = [(p, 1), (e, 0)]
                for v, counts in parts:
                    rows = binned(v, code[ok])
                    keys = (number[rows[:, 0]] * len(places) + t) * 4096 + rows[:, 1] + SHIFT
                    waiting.append(np.stack([keys, rows[:, 2], rows[:, 3], rows[:, 4] * counts, np.zeros(len(keys), "i8")], axis=1))
            held, waiting = merged(), []
        keys = held[:, 0] // 4096
        groups = list(known)
        own = [groups[k] for k in (keys // len(places)).tolist()]
        columns = [pa.array([g[i] for g in own], f.type) for i, f in enumerate(arrow_fields[:n_by])]
        numbers = [keys % len(places), held[:, 0] % 4096 - SHIFT, held[:, 1], held[:, 2], held[:, 3]]
        yield pa.RecordBatch.from_arrays([*columns, *[pa.array(v, pa.int64()) for v in numbers]], names=shape.names)

    from pyspark.sql.pandas.types import to_arrow_schema
    arrow_fields = list(to_arrow_schema(shape))
    wide = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("upper", "lower", "n")]
    found: dict[tuple, dict[tuple, Sum]] = {} if by else {(): {}}
    whole: dict[tuple, list] = {}
    for row in narrow.mapInArrow(add, shape).groupBy(*[f"g{i}" for i in range(n_by)], "t", "e").agg(*wide).collect():
        group, t = tuple(row[:n_by]), row["t"]
        entry = whole.setdefault((group, t), [0, 0])
        # in units of 2^-(SHIFT + 53)
        entry[0] += ((int(row["upper"]) << HALF) + int(row["lower"])) << (row["e"] + SHIFT)
        entry[1] += int(row["n"])
    for (group, t), (units, n) in whole.items():
        found.setdefault(group, {})[terms[t]] = Sum(n, Fraction(units, 1 << (SHIFT + 53)))
    for sums in found.values():
        for term in terms:
            sums.setdefault(term, Sum(0, Fraction(0)))
    return found


def number(x: Fraction | None) -> float | None:
    return None if x is None else float(x)


def variance(n: int, total: Fraction, squares: Fraction, ddof: int = 0) -> Fraction | None:
    return (squares - total * total / n) / (n - ddof) if n > ddof else None


def correlation(n: int, x: Fraction, y: Fraction, xx: Fraction, yy: Fraction, xy: Fraction) -> float | None:
    """Pearson r from exact sums over the same rows; None where a side is constant."""
    if not n:
        return None
    vx, vy = xx - x * x / n, yy - y * y / n
    if vx <= 0 or vy <= 0:
        return None
    cov = xy - x * y / n
    return math.copysign(math.sqrt(cov * cov / (vx * vy)), cov)


def rounded(x: float | Fraction | None, digits: int) -> float | None:
    """Half-even on the scaled double, as :func:`chartwise.functions.columns.fround`."""
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    scaled = float(x) * 10.0 ** digits
    return float(round(scaled)) / 10.0 ** digits if math.isfinite(scaled) else float(x)
