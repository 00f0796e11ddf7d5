"""Quality rules, line first: lines that fail a rule go, then documents that lost too much of their text.

All work is within a row: no shuffle, and built-in functions only. Repeated word windows are found by sorting
a document's own 64-bit window hashes, and only in documents that have a repeated one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartwise.llm.common import aside, back, quoted
from chartwise.llm.native import BLANKS, let, n_of, words

SYMBOLS = r"[#*$%&|<>]"

#: Phrases of lines that say nothing about the document (lower case).
BOILERPLATE = ("all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "licensed under", "enable javascript", "sign up for our newsletter")


def repeat_words(word_list: Column, width: int) -> Column:
    """Words in ``width``-word windows that occur twice or more in the list, the first occurrence included."""
    hashes = F.transform(word_list, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.when(F.size(h) >= width, F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(F.slice(h, i, width))))
                  .otherwise(F.array().cast("array<bigint>")))

    def covered(all_windows: Column) -> Column:
        ranked = F.array_sort(F.transform(all_windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        again = let(ranked, lambda s: F.filter(s, lambda e, i: F.get(s, i - 1)["x"].eqNullSafe(e["x"]) | F.get(s, i + 1)["x"].eqNullSafe(e["x"])))
        places = F.array_sort(F.transform(again, lambda e: e["i"]))
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-width).alias("last"))
        return F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(width), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("bigint")).otherwise(covered(w)))


def line_fails(line: Column, word_list: Column) -> Column:
    """Punctuation, navigation, repetition and boilerplate rules of one line."""
    n_words = F.size(word_list)
    stutter = (n_words >= 10) & (2 * F.size(F.filter(word_list, lambda w, i: (i > 0) & (w == F.get(word_list, i - 1)))) >= n_words)
    navigation = n_of(line, r"\|") * 5 >= n_words
    marks = n_of(line, r"[#*$%&<>]") * 4 >= n_words
    shouting = (n_words >= 3) & (F.upper(line) == line) & (F.lower(line) != line)
    unfinished = (n_words < 6) & ~line.rlike(r"[.!?…:;,\"”»)\]][\x20\x09-\x0D]*$")
    boilerplate = (n_words <= 30) & F.lower(line).rlike("|".join(BOILERPLATE))
    return ((navigation & line.contains("|")) | (marks & line.rlike(r"[#*$%&<>]")) | shouting | unfinished | boilerplate | stutter)


def rate(docs: DataFrame, min_words: int = 20, max_repeat_pct: int = 30, width: int = 8, max_lost_pct: int = 50, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__q``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lost_words,
    kept, and text (the lines that pass, joined by line ends).

    base_failed: fewer than ``min_words`` words, or over ``max_repeat_pct`` % of them in repeated windows. kept:
    not base_failed, and at most ``max_lost_pct`` % of the words are in failing lines. A null text has no words
    and fails; each row stands for itself, whatever its id; an empty table gives an empty one; other columns, whatever
    their names, pass through (one named as the result is replaced). Very long texts are rated whole.
    """
    whole = F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    parsed = aside(docs, text=whole, words=words(whole, BLANKS), lines=lines)
    rate_line = F.transform("lines", lambda x: let(words(x, BLANKS), lambda w: F.struct(x.alias("line"), F.size(w).alias("n"), line_fails(x, w).alias("bad"))))
    measured = parsed.withColumn("rated", rate_line).withColumn("repeats", repeat_words(F.col("words"), width))
    n_words, repeat, text = F.size("words").cast("long"), F.col("repeats"), F.col("text")
    lost = F.aggregate(F.filter("rated", lambda x: x["bad"]), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    base_failed = (n_words < min_words) | (repeat * 100 > n_words * max_repeat_pct)
    found = {
        "n_words": n_words, "word_chars": F.length(F.concat_ws("", "words")).cast("long"), "n_symbols": n_of(text, SYMBOLS).cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"), "n_repeat_words": repeat, "base_failed": base_failed,
        "n_lost_words": lost, "kept": ~base_failed & (lost * 100 <= n_words * max_lost_pct),
        "text": F.array_join(F.transform(F.filter("rated", lambda x: ~x["bad"]), lambda x: x["line"]), "\n"),
    }
    return back(measured, docs.columns, __q=F.struct(*[v.alias(k) for k, v in found.items()]))
