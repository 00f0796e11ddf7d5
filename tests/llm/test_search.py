"""Ranked search against a plain scorer, over odd rows, several blocks of items and partitionings."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chartwise.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top):
    """Every item against every document."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                found.append((-score, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:top], 1)]
    return Counter(out)


ITEMS = [(1, "alpha beta GAMMA 42"), (2, None), (3, ""), (4, "... !!!"), (5, "日本語 naïve foo|bar x_y"), (6, "no-such-term-anywhere qqqq"), (6, "a repeated id: delta"),
         (None, "alpha without an id"), (8, "w1 w2 w3 word5 Word5 WORD5"), (9, "İstanbul Σίσυφος σίσυφος"), (10, "this very line is shared by many documents")]


@pytest.mark.parametrize(("block", "parts"), [(8 << 20, 1), (60, 7)])
def test_ranks_equal_a_plain_scorer(spark, make, odd_rows, monkeypatch, block, parts):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("score", F.lit("clash")).withColumn("a.b", F.lit(1)).repartition(3)
    docs = make(spark, odd_rows, parts).withColumn("terms", F.lit("clash")).withColumn("a.b", F.lit(1))
    got = Counter(map(tuple, lexical.search(docs, items, top=4).collect()))
    assert got == plain(odd_rows, ITEMS, 4)


def test_ties_rank_by_id_and_empty_tables_give_nothing(spark, make):
    rows = [(i, "same words here") for i in (9, 3, 7, 1, 5)] + [(20 + i, "other") for i in range(30)]
    items = spark.createDataFrame([(1, "words")], "item_id long, text string")
    for parts in (1, 6):
        got = lexical.search(make(spark, rows, parts), items, top=3).orderBy("rank").collect()
        assert [r.doc_id for r in got] == [1, 3, 5] and len({r.score for r in got}) == 1
    assert lexical.search(make(spark, []), items).count() == 0
    assert lexical.search(make(spark, rows), items.limit(0)).count() == 0


def test_heaps_keep_the_best_whatever_the_batches():
    rng = np.random.default_rng(3)
    item, score, doc = rng.integers(0, 6, 4000), rng.integers(1, 40, 4000), rng.permutation(4000)
    heaps = lexical.Heaps(6, 7)
    for at in range(0, 4000, 333):
        heaps.add(item[at:at + 333], score[at:at + 333], doc[at:at + 333])
    for i in range(6):
        want = sorted((-s, d) for s, d, k in zip(score, doc, item, strict=True) if k == i)[:7]
        own = heaps.item == i
        assert list(zip((-heaps.score[own]).tolist(), heaps.doc[own].tolist(), strict=True)) == want
        assert heaps.least[i] == -want[-1][0]


def test_large_sums_are_exact():
    keys, values = np.array([0, 1, 0, 1, 0]), np.array([(1 << 52) + 1, 3, (1 << 52) + 3, 5, 1])
    assert lexical.sums(keys, values, 2, lexical.EXACT).tolist() == [(1 << 53) + 5, 8]


def test_terms_of_a_sliced_array():
    texts = pa.array(["skip", "A-b Ç_d", None, "x"]).slice(1)
    assert [[t for t in ts if t] for ts in lexical.cut(texts).to_pylist()] == [["a", "b", "Ç", "d"], [], ["x"]]
