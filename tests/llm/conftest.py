import os
import random

import pytest
from pyspark.sql import types as T

HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(autouse=True)
def workers_find_the_package(spark):
    spark.sparkContext.environment["PYTHONPATH"] = HERE


#: Columns that operators also use or return, which must be no matter in the input.
CLASHES = ("n_tokens", "component_id", "fp", "h1", "h2", "start", "bin", "keeper", "window", "windows", "at", "words", "slot", "place", "row", "doc", "own", "rid", "raw", "drop", "lines", "n_lines",
           "n_words", "n_hit", "hits", "cand", "rated", "repeats", "score", "terms", "tfs", "pairs", "times", "a.b", "with blank", "__doc", "__text", "__row", "__rid", "__raw", "__drop", "__words", "__w")

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASHES]])


def odd_texts():
    """Nulls, empty and odd texts, copies, near copies, shared lines and a very long one."""
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma,", "delta.", "l'eau", "don't", "Übergröße", "naïve", "42", "3.14", "foo|bar", "ß", "日本語", "x_y", "Σίσυφος", "İstanbul", "🙂", "co-op"]
    base = [" ".join(rng.choice(vocabulary) + (str(rng.randrange(50)) if rng.random() < 0.3 else "") for _ in range(rng.randrange(30, 80))) for _ in range(12)]
    shared = "This very line is shared by many documents"
    texts = [None, "", " ", "\n", "\n\n", "one", "two words", "three short words", "a <|endoftext|> b<|startoftext|>", "tab\tand\r\nreturn\x0bvt\x0cff", "double  blank and  more ", " leading", "trailing ",
             "nb\xa0sp em　wide\x1cfs", "é combining", "don't we'll I'm", "a" * 3000, "﻿bom", "a\n b\n\nc \n"]
    texts += base + base[:4] + [b + " end" for b in base[4:8]]
    texts += [f"{b}\n  {shared.upper() if i % 2 else shared} \nlast line {i}" for i, b in enumerate(base)]
    texts.append(" ".join(f"w{i % 977} Word{i % 31}." for i in range(60_000)) + "\n" + shared)
    return texts


@pytest.fixture(scope="session")
def odd_rows():
    texts = odd_texts()
    rows = [(i * 7 % 101 + 1000 * (i // 101), t) for i, t in enumerate(texts)]
    rows += [rows[20], rows[20], rows[25]]                       # repeated rows
    rows += [(rows[30][0], "another text under an id in use")]   # an id with two texts
    return rows + [(None, "a text without an id"), (None, texts[22])]


def frame(spark, rows, parts=3):
    full = [(i, t, "en", "s", len(t) if t is not None else None, *["?"] * len(CLASHES)) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows)


@pytest.fixture(scope="session")
def make():
    return frame
