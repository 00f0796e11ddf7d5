"""Column-level building blocks (all JVM-side built-ins, codegen friendly)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def uniform(seed: int, *keys) -> Column:
    """Deterministic pseudo-random number in [0, 1) from ``seed`` and row keys.

    First 32 bits of md5("seed:key1:key2..."), divided by 2**32.  The same
    value is reproducible in any SQL engine with md5, which makes sampling,
    splitting and oversampling checkable and stable under repartitioning.
    """
    parts = [F.lit(str(seed))] + [col_(k).cast("string") for k in keys]
    h = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8)
    return F.conv(h, 16, 10).cast("bigint") / F.lit(TWO_POW_32)


def clip(x, lo: float, hi: float) -> Column:
    """Clip that keeps NULL as NULL (``greatest(lo, least(hi, NULL))`` would give ``hi``)."""
    x = col_(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def fround(x, digits: int) -> Column:
    """Round like numpy/pandas: ``rint(x * 10**d) / 10**d`` (half-even on the scaled double)."""
    scale = float(10 ** digits)
    return F.rint(col_(x) * F.lit(scale)) / F.lit(scale)


def round_opt(x, digits: int | None) -> Column:
    """``fround`` unless ``digits`` is None (full precision)."""
    x = col_(x)
    return x if digits is None else fround(x, digits)


# Python list literal such as "['a', \"O'Neil\"]": element = text between a
# matching pair of quotes.
LIST_ELEMENT_PATTERN = r"""(['"])(.*?)\1"""
LIST_SHAPE_PATTERN = r"^\s*\[.*\]\s*$"


def list_literal_elements(s, mode: str = "literal") -> Column:
    """Parse a list-literal string into ``array<string>``.

    ``mode='literal'``: Python list literal (quoted elements); non-list text
    gives an empty array.  ``mode='comma'``: comma-joined plain text.
    """
    s = col_(s)
    if mode == "comma":
        parts = F.split(F.coalesce(s, F.lit("")), r"\s*,\s*")
        return F.filter(parts, lambda e: e != "")
    return F.when(s.rlike(LIST_SHAPE_PATTERN), F.regexp_extract_all(s, F.lit(LIST_ELEMENT_PATTERN), 2)) \
        .otherwise(F.array().cast("array<string>"))


def list_literal_first(s, mode: str = "literal") -> Column:
    """First element; for text that is not a list, the first single-quoted token."""
    s = col_(s)
    elems = list_literal_elements(s, mode)
    if mode == "comma":
        return F.try_element_at(elems, F.lit(1))
    fallback = F.nullif(F.regexp_extract(s, r"'([^']+)'", 1), F.lit(""))
    return F.when(s.rlike(LIST_SHAPE_PATTERN), F.try_element_at(elems, F.lit(1))).otherwise(fallback)


def list_literal_count(s, mode: str = "literal") -> Column:
    """Element count; ``[]`` is 0, NULL or unparsable text counts as 1."""
    s = col_(s)
    if mode == "comma":
        return F.when(s.isNull(), F.lit(1)).otherwise(F.size(list_literal_elements(s, mode)))
    return F.when(s.rlike(LIST_SHAPE_PATTERN), F.size(list_literal_elements(s, mode))).otherwise(F.lit(1))


def right_closed_bins(x, edges: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """Label of the (lo, hi] interval holding ``x``; NULL outside or for NULL.

    The lowest edge is open, as in pandas ``cut``.
    """
    x = col_(x)
    if labels is None:
        labels = [f"({lo}, {hi}]" for lo, hi in zip(edges[:-1], edges[1:])]
    if len(labels) != len(edges) - 1:
        raise ValueError("need len(edges) - 1 labels")
    out = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(float(lo))) & (x <= F.lit(float(hi)))
        out = F.when(cond, F.lit(lab)) if out is None else out.when(cond, F.lit(lab))
    return out


def right_closed_bin_index(x, edges: Sequence[float]) -> Column:
    """0-based index of the (lo, hi] interval, NULL outside."""
    x = col_(x)
    out = None
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        cond = (x > F.lit(float(lo))) & (x <= F.lit(float(hi)))
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return out


def left_closed_tiers(x, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """Overlap-free tiers ``[-inf, c1), [c1, c2), ..., [ck, inf)``; NULL for NULL."""
    x = col_(x)
    if len(labels) != len(cuts) + 1:
        raise ValueError("need len(cuts) + 1 labels")
    out = F.when(x < F.lit(float(cuts[0])), F.lit(labels[0]))
    for c, lab in zip(cuts[1:], labels[1:-1]):
        out = out.when(x < F.lit(float(c)), F.lit(lab))
    return out.when(x.isNotNull(), F.lit(labels[-1]))


def ordinal_name(x, names: Sequence[str], base: int = 1) -> Column:
    """Map an ordinal (1-based by default) to a name; out of range gives NULL."""
    arr = F.array(*[F.lit(n) for n in names])
    return F.try_element_at(arr, (col_(x) - F.lit(base) + F.lit(1)).cast("int"))


def weighted_sum(weights: dict, null_as_zero: bool = True, intercept: float = 0.0) -> Column:
    out = F.lit(float(intercept))
    for c, w in weights.items():
        v = F.coalesce(F.col(c), F.lit(0.0)) if null_as_zero else F.col(c)
        out = out + F.lit(float(w)) * v
    return out
