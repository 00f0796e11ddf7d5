"""Token counts, token files and packing against the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from chartwise.llm import packing, token_count, token_files
from chartwise.llm.huffman import Code, code_lengths
from chartwise.llm.vocab import UnitIds

WORD, BYTE = path("word_bpe_49k.json"), path("byte_bpe_50k.json")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def library(file, text):
    return Tokenizer.from_file(file).encode(text or "", add_special_tokens=False).ids


def test_unit_ids_are_the_librarys():
    rng = random.Random(1)
    pieces = ["a", "B", "é", " ", "  ", "\n", "\n\n", "\t", "'s", "'ll", "12", "!", "?!", "<|endoftext|>", "<|", "\xa0", "日", "\x1c", "word", "Übel", ".", "\r\n", " ", "\x85", "İ", "ǅ", "ª"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) for _ in range(3000)]
    tokenizer = Tokenizer.from_file(BYTE)
    first, ids = UnitIds(BYTE).encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[first[i]:first[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_run_counts_are_the_librarys():
    rng = random.Random(2)
    pieces = ["a", "B", "é", "é", " ", "\n", "\t", "\r", "'s", "12", "!", "<|endoftext|>", "<|startoftext|>", "\xa0", "日", "\x1c", "Word", ".", "́", "İ", "Σ", "ß", "ª", "ﬁ"]
    units = token_count.UnitCounts(WORD)
    tokenizer = Tokenizer.from_file(WORD)
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        parts = token_count.runs(pa.array([text]))[0].as_py()
        assert sum(units.of(parts)) == len(tokenizer.encode(text, add_special_tokens=False).ids), repr(text)


def test_summaries_keep_the_frequent():
    rng = random.Random(3)
    stream = [rng.choice("abc") if rng.random() < 0.6 else f"rare{rng.randrange(5000)}" for _ in range(20_000)]
    words, counts = pa.array([], pa.string()), np.zeros(0, "i8")
    for at in range(0, len(stream), 500):
        c = Counter(stream[at:at + 500])
        words, counts = token_count.summed([(words, counts), (pa.array(list(c)), np.array(list(c.values())))], 20)
    assert set("abc") <= set(words.to_pylist()) and len(words) <= 20


def test_token_counts(odd, odd_rows):
    tokenizer = Tokenizer.from_file(WORD)
    want = Counter()
    for i, t in odd_rows:
        n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 2048] += 1
    for size in (4, 8192):  # with most runs missing from the broadcast table, and with few
        got = Counter(map(tuple, token_count.count_tokens(odd, WORD, table_size=size).collect()))
        assert got == want


def test_token_files(odd, odd_rows):
    tokenizer = Tokenizer.from_file(BYTE)
    rows = sorted(((i, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes()))
    want, at = [], 0
    for i, ids in rows:
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    got = sorted(map(tuple, token_files.token_files(odd, BYTE).collect()), key=lambda r: r[1])
    assert got == want


def test_token_files_of_many_blocks(spark, make, monkeypatch):
    rows = [(i, f"text {i} " * (i % 50)) for i in range(400)]
    monkeypatch.setattr(token_files, "BLOCK", 300)
    got = {r["doc_id"]: r["ids_crc32"] for r in token_files.token_files(make(spark, rows), BYTE).collect()}
    tokenizer = Tokenizer.from_file(BYTE)
    assert got == {i: crc(tokenizer.encode(t, add_special_tokens=False).ids + [0]) for i, t in rows}


@pytest.mark.parametrize("n,limit", [(1, 4), (2, 4), (7, 3), (300, 9), (1000, 16)])
def test_huffman_round_trip(n, limit):
    rng = np.random.default_rng(n)
    counts = rng.zipf(1.3, n).clip(1, 10**9)
    lengths = code_lengths(counts, limit)
    assert lengths.max() <= limit and sum(2.0 ** -int(x) for x in lengths) <= 1
    code, ids = Code(lengths), rng.choice(n, size=5000, p=counts / counts.sum())
    blocks = [ids[:1], ids[:256], ids[:0], ids]
    coded = [code.encode(b, 256) for b in blocks]
    back = code.decode([c for c, _ in coded], [m for _, m in coded], [len(b) for b in blocks], 256)
    assert all((a == b).all() for a, b in zip(blocks, back, strict=True))


def test_huffman_lengths_are_optimal():
    import heapq
    counts = np.random.default_rng(4).integers(1, 1000, 60)
    heap, total = [int(c) for c in counts], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    assert int((counts * code_lengths(counts, 30)).sum()) == total


def check_packing(rows, packed, file=BYTE, room=1024):
    tokenizer, sequences, docs = Tokenizer.from_file(file), defaultdict(list), defaultdict(list)
    for r in packed:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    want = defaultdict(list)
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        edges = [0, *range(len(ids) % room or room, len(ids) + 1, room)]
        want[i] += [(k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    assert {i: sorted(p) for i, p in docs.items()} == {i: sorted(p) for i, p in want.items()}
    return len(sequences), sum(x[2] for p in want.values() for x in p)


def test_packing(odd, odd_rows):
    n, total = check_packing(odd_rows, packing.pack(odd, BYTE).collect())
    assert n <= -(-total // 1024) + 2


def test_packing_merges_over_groups(spark, make, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 20)
    rows = [(i, "word " * (i * 37 % 700)) for i in range(600)]
    n, total = check_packing(rows, packing.pack(make(spark, rows, 40), BYTE).collect())
    assert n <= 1.1 * total / 1024


def test_packing_of_texts_that_never_share_a_sequence(spark, make, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 5)
    rows = [(i, "a" + " a" * 600) for i in range(30)]
    n, _ = check_packing(rows, packing.pack(make(spark, rows, 6), BYTE).collect())
    assert n == 30


def test_empty_tables(spark, make):
    empty = make(spark, [])
    assert token_count.count_tokens(empty, WORD).collect() == []
    assert token_files.token_files(empty, BYTE).collect() == []
    assert packing.pack(empty, BYTE).collect() == []
