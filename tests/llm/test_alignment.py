"""Token alignment against a plain aligner, with and without the broadcast tier, over odd rows and random texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chartwise.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_letters():
    keep = [b for b in range(256) if chr(b).isprintable() and b not in (32, 0xA0, 0xAD)]
    out = {chr(b): b for b in keep}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in keep)}


def ends(tokens):
    at, out = 0, []
    for t in tokens:
        at += len(t)
        out.append(at)
    return out


def plain(rows):
    a_side, b_side, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), plain_letters()
    a_side.encode_special_tokens = True
    docs = []
    for i, text in rows:
        text = text or ""
        coded = a_side.encode(" " + text, add_special_tokens=False)
        a, b = coded.ids, b_side.encode(text)
        a_bytes = [bytes(letters[c] for c in t) for t in coded.tokens]
        b_bytes = [bytes([int(p[3:5], 16)]) if b_side.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(b, map(b_side.id_to_piece, b), strict=True)]
        groups = []
        if text and b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            ends_a, ends_b = ends(a_bytes), ends(b_bytes)
            low = 0
            for high in sorted(set(ends_a) & set(ends_b)):
                groups.append(([x for x, e in zip(a, ends_a, strict=True) if low < e <= high], [y for y, e in zip(b, ends_b, strict=True) if low < e <= high]))
                low = high
        docs.append((i, groups))
    count = Counter(p for _, groups in docs for p in {(x, y) for g, h in groups for x in g for y in h})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for i, groups in docs:
        links = [(x, y) for g, h in groups for x in g for y in h]
        name = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((i, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links), sum(count[p] == best[p[0]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(name.encode()).hexdigest() if groups else ""))
    return Counter(out)


def random_texts(n):
    rng = random.Random(11)
    parts = ["word", "Hello", "naïve", "日本語", "\n", "\n\n", "  ", " ", "\t", "▁", "<0x41>", "<s>", "</s>", "<unk>", "<|endoftext|>", "🙂", "é", "﻿", "1234567", "don't", "...", "x=y;", "\r\n",
             "aaaaaaaaaaaaaaaaaaaa", "ß", "́", "\x00", "​", "http://a.b/c?d=e", ");\r", "​", "Ünïcödé", "____", "ACGTACGT", "0xdeadbeef"]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randrange(1, 25))) for _ in range(n)]


@pytest.mark.parametrize(("head", "parts"), [(500_000, 1), (0, 5), (60, 3)])
def test_equals_a_plain_aligner(spark, make, odd_rows, monkeypatch, head, parts):
    monkeypatch.setattr(alignment, "HEAD", head)
    rows = [(i, t) for i, t in odd_rows if t is None or len(t) < 10_000] + [(5000 + i, t) for i, t in enumerate(random_texts(150))]
    docs = make(spark, rows, parts).withColumn("rid", F.lit("clash")).withColumn("pairs", F.lit("clash")).withColumn("a.b", F.lit(1))
    got = Counter(map(tuple, alignment.align_tokens(docs, A, B).collect()))
    assert got == plain(rows)


def test_a_very_long_text_and_empty_tables(spark, make, odd_rows):
    rows = [(i, t) for i, t in odd_rows if t and len(t) > 10_000]
    got = alignment.align_tokens(make(spark, rows), A, B).collect()
    aligner = alignment.Aligner((A, B))
    whole = aligner.whole([t for _, t in rows])
    want = [hashlib.sha256(bytes(aligner.text(whole.labels)[0][:-1])).hexdigest()]
    assert len(rows) == 1 and [(r.n_a, r.n_b, r.n_groups, r.n_links) for r in got] == [tuple(c) for c in whole.counts.tolist()]
    assert [r.groups_sha256 for r in got] == want
    assert alignment.align_tokens(make(spark, []), A, B).count() == 0
    assert [tuple(r) for r in alignment.align_tokens(make(spark, [(1, None), (2, "")]), A, B).orderBy("doc_id").collect()] == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_counts_handed_on_early_are_the_same(spark, make, odd_rows, monkeypatch):
    rows = [(i, t) for i, t in odd_rows if t is None or len(t) < 10_000]
    want = Counter(map(tuple, alignment.align_tokens(make(spark, rows), A, B).collect()))
    monkeypatch.setattr(alignment, "COUNTED", 10)
    assert Counter(map(tuple, alignment.align_tokens(make(spark, rows), A, B).collect())) == want


def test_large_slices_and_long_texts_are_the_same(monkeypatch):
    aligner = alignment.Aligner((A, B))
    rng = random.Random(3)
    # ids of any kind with the same bytes: a one-token text against its bytes, over and over
    texts = random_texts(60)
    small = aligner.whole(texts)
    sums = [alignment.summed(small.pairs, small.times)]
    monkeypatch.setattr(alignment, "LARGE", 0)
    large = aligner.whole(texts)
    sums.append(alignment.summed(large.pairs, large.times))
    assert [x.tolist() for x in sums[0]] == [x.tolist() for x in sums[1]]
    assert small.counts.tolist() == large.counts.tolist() and small.labels.tolist() == large.labels.tolist()
    code = aligner.places(["a", "word", "naïve", "\nx"])[np.array([rng.randrange(4) for _ in range(300)])]
    ends = [0, 5, 5 + 250, 300]
    want = aligner.digests(aligner.store, code, np.array(ends))
    monkeypatch.setattr(alignment, "TEXT_LABELS", 16)
    assert aligner.digests(aligner.store, code, np.array(ends)) == want


def test_a_store_that_forgets_gives_the_same(monkeypatch):
    rng = random.Random(4)
    aligner, small = alignment.Aligner((A, B)), alignment.Aligner((A, B))
    for turn in range(12):
        units = list({"".join(rng.choice("abcdeé\U0001F642") for _ in range(rng.randrange(1, 4))) for _ in range(60)}) + ["", "\nab"]
        monkeypatch.setattr(alignment, "CACHED", 10 ** 6)
        places = aligner.places(units)
        want = aligner.store.only(places)
        monkeypatch.setattr(alignment, "CACHED", 100)
        monkeypatch.setattr(alignment, "BLOCK", 7)
        places = small.places(units)
        assert all(np.array_equal(x, y) for x, y in zip(small.store.only(places), want, strict=True))
        assert len(small.place) == len(small.store.counts) == len(small.seen) <= 200
