"""Column helpers of the operators that run on built-in functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once a row, also where ``body`` uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column, separators: str) -> Column:
    """Runs without separators (a regular expression for one or more of them)."""
    return F.array_remove(F.split(text, separators), "")


def n_of(text: Column, what: str) -> Column:
    """How many characters of ``text`` the regular expression ``what`` (one character) matches."""
    return F.length(text) - F.length(F.regexp_replace(text, what, ""))


def steps(first: Column | int, last: Column) -> Column:
    """first..last, empty if last is smaller."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
