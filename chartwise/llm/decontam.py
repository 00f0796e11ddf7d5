"""Benchmark decontamination as a prefix-filtered set join, on built-in functions alone.

An item's windows (ten words, or the whole item if shorter) are sets of three-word shingles. A document that
holds a window holds all its shingles, so it must hold the rarest one: that shingle is the window's necessary
prefix. One pass over the corpus counts the items' shingles, a second joins documents with the prefixes;
positions must leave room for the window (positional and length bounds), and what is left is verified word by
word. What moves between machines: counts of item shingles, the candidates, and each text once to be verified.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartwise.llm.common import aside, back, id_key, land, quoted
from chartwise.llm.native import let, steps, words

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of a shingle, and the most rows that are broadcast; more are joined by a shuffle.
SHINGLE, BROADCAST_ROWS = 3, 500_000


def exact_words(text: Column) -> Column:
    return words(F.translate(text, UPPER, LOWER), SEPARATORS)


def shingles(word_list: Column, size: int) -> Column:
    """Hashes of runs of ``size`` words, by position. Each word is lower-cased alone, which words equal but for A-Z share."""
    hashes = F.transform(word_list, lambda w: F.xxhash64(F.lower(w)))
    if size == 1:
        return F.transform(hashes, lambda h: F.xxhash64(h))
    return let(hashes, lambda h: F.transform(steps(0, F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)])))


def small(df: DataFrame) -> DataFrame:
    """Broadcast if counted to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def item_windows(items: DataFrame, width: int, item_col: str, text_col: str) -> DataFrame:
    """(item, window, n): distinct windows of each item as space-joined words."""
    parsed = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), exact_words(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(width))
    starts = let(F.col("w"), lambda w: F.transform(steps(0, F.size(w) - F.least(F.size(w), F.lit(width))), lambda i: F.array_join(F.slice(w, i + 1, F.least(F.size(w), F.lit(width))), " ")))
    return parsed.select("item", n.alias("n"), F.explode(F.array_distinct(starts)).alias("window"))


def found_shingles(docs: DataFrame, sizes: list[int], keys: list[str]) -> DataFrame:
    """(keys..., n_words, h, start): all shingles of the sizes that windows have."""
    parsed = docs.select(*keys, words(F.col("text"), SEPARATORS).alias("w"))
    lists = [shingles(F.col("w"), size) for size in sizes]
    hashed = parsed.select(*keys, F.size("w").alias("n_words"), (F.concat(*lists) if len(lists) > 1 else lists[0]).alias("hashes"))
    start, before = F.col("pos"), F.lit(0)
    for size in sizes:  # the lists follow one another
        start = F.when(F.col("pos") >= before, F.col("pos") - before).otherwise(start)
        before = before + F.greatest(F.col("n_words") - (size - 1), F.lit(0))
    return hashed.select(*keys, "n_words", F.posexplode("hashes").alias("pos", "h")).select(*keys, "n_words", "h", start.alias("start"))


def matched(wide: DataFrame, text_col: str, items: DataFrame, width: int, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """``wide`` (row, doc, own, text) with n_words, n_hit and windows; and (item, window). ``doc`` and ``own`` (of the text)
    tell rows with different results apart; where rows move, the text travels inside its row."""
    keys = ["doc", "own"]
    windows = land(item_windows(items, width, item_col, item_text_col), "windows")
    distinct = windows.select("window", "n").distinct()
    sizes = sorted({min(SHINGLE, r["n"]) for r in distinct.select("n").distinct().collect()}, reverse=True) or [SHINGLE]  # at most `width` numbers
    parts = [distinct.filter(F.least("n", F.lit(SHINGLE)) == size).select("window", "n", F.posexplode(shingles(F.split("window", " "), size)).alias("offset", "h")) for size in sizes]
    tokens = land(functools.reduce(DataFrame.unionByName, parts), "window-shingles")
    counts = land(found_shingles(wide.select("text"), sizes, []).join(small(tokens.select("h").distinct()), "h").groupBy("h").agg(F.count(F.lit(1)).alias("df")), "shingle-counts")
    # a shingle that no document holds is the rarest, and its windows can't occur
    rarest = tokens.join(counts, "h", "left").groupBy("window", "n").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "h", "offset")).alias("p"))
    prefixes = land(rarest.filter("p.df > 0").select("window", "n", F.col("p.h").alias("h"), F.col("p.offset").alias("offset")), "prefixes")
    met = (found_shingles(wide.select(*keys, "text"), sizes, keys).join(small(prefixes), "h")
           .withColumn("at", F.col("start") - F.col("offset")).filter("at >= 0 AND at + n <= n_words"))
    candidates = met.groupBy(*keys).agg(F.collect_set(F.struct("at", "n", "window")).alias("cand"))
    verified = let(exact_words(F.col("text")), lambda w: F.filter(F.col("cand"), lambda c: F.array_join(F.slice(w, c["at"] + 1, c["n"]), " ") == c["window"]))
    found = (wide.drop("text").join(candidates, keys, "left").withColumn("text", row_text(F.col("row").getField(text_col))).withColumn("hits", F.when(F.col("cand").isNotNull(), verified))
             .withColumn("n_words", F.size(words(F.col("text"), SEPARATORS)).cast("long")))
    covered = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda c: F.sequence(c["at"], c["at"] + c["n"] - 1)))))
    n_hit = F.when(F.col("hits").isNull(), 0).otherwise(covered).cast("long")
    return found.withColumn("n_hit", n_hit).withColumn("windows", F.array_distinct(F.transform("hits", lambda c: c["window"]))).drop("cand", "hits", "text"), windows


def row_text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = row_text(F.col(quoted(text_col)))
    return aside(docs, doc=id_key(id_col), own=F.xxhash64(text), text=text)


def hits(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``__n_words``, ``__n_hit`` and ``__windows`` (the distinct windows found); and (item, window).

    ``__n_hit`` counts the words inside any occurrence of an item's window. Null and empty texts have no words.
    Rows that repeat an id are judged by their own texts, null ids like others; a null item id is named by the
    empty string; empty tables give an empty result, or one without hits; other columns, whatever their names, pass
    through (those named as the results are replaced). Very long texts are cut whole.
    """
    found, windows = matched(rows_of(docs, id_col, text_col), text_col, items, width, item_col, item_text_col)
    return back(found, docs.columns, __n_words=F.col("n_words"), __n_hit=F.col("n_hit"), __windows=F.col("windows")), windows


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", **item_columns: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items (items with occurring windows), items_sha256 (of their
    ids, sorted as strings, comma-joined), contaminated. See :func:`hits` for odd rows."""
    own = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    found, windows = matched(rows_of(own, "id", "text"), "text", items, width, **{"item_col": "item_id", "item_text_col": "text", **item_columns})
    keys = ["doc", "own"]
    narrow = land(found.select(*keys, F.col("row").getField("id").alias("doc_id"), "n_words", "n_hit", "windows"), "hits")
    named = (narrow.select(*keys, F.explode("windows").alias("window")).join(small(windows.select("window", "item")), "window")
             .groupBy(*keys).agg(F.array_sort(F.collect_set("item")).alias("items")))
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return narrow.join(named, keys, "left").select("doc_id", "n_words", "n_hit", F.size(items_of).cast("long").alias("n_items"),
                                                   F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
