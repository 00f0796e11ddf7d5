"""SimHash near-dedup, line dedup, quality rules and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chartwise.llm import decontam, line_dedup, quality, simhash
from chartwise.llm.common import land

ASCII_BLANK = r"[\x20\x09-\x0D]"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, near):
    """Smallest member's position for each value, over links between near ones."""
    up = list(range(len(values)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if near(a, values[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(values))]


def test_fingerprints_and_components(odd, odd_rows):
    rows = [(i, t) for i, t in odd_rows if t is None or len(t) < 10_000]
    prints = [fingerprint(t) for _, t in rows]
    roots = groups(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    first = {}
    for (i, _), r in zip(rows, roots, strict=True):
        first[r] = min((x for x in (first.get(r), i) if x is not None), default=None)
    want = Counter((i, f"{f:016x}", first[r]) for (i, _), f, r in zip(rows, prints, roots, strict=True))
    got = Counter(map(tuple, simhash.near_duplicates(odd.filter("text IS NULL OR length(text) < 10000")).collect()))
    assert got == want


@pytest.mark.parametrize("limit", [200, 2_000_000])
def test_links_of_clustered_fingerprints(spark, monkeypatch, limit):
    """Clusters around a few centres, also where a head's variants are divided by further bits."""
    monkeypatch.setattr(simhash, "VARIANTS", limit)
    rng = random.Random(6)
    values = [rng.getrandbits(64) for _ in range(20)]
    for centre in values[:4]:
        values += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))) for _ in range(40)]
    values = sorted(set(values))
    signed = np.array(values, "u8").view("i8").tolist()
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    if limit < 1000:  # in this process, where the smaller limit holds
        fps, key_bits = np.array(values, "u8"), 16
        row, key, rest = simhash.sent(fps, np.full(len(fps), 2), 64 - key_bits, key_bits)
        order = np.argsort(key, kind="stable")
        found = {tuple(sorted(map(int, p))) for part in simhash.search(fps[row][order], key[order], rest[order], 64 - key_bits) for p in part}
        found = {(a, b) for a, b in found}
    else:
        found = {tuple(sorted((int(r["a"]) % (1 << 64), int(r["b"]) % (1 << 64)))) for r in simhash.links(table, 4).collect()}
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    assert groups(values, lambda a, b: (min(a, b), max(a, b)) in found) == groups(values, lambda a, b: (a ^ b).bit_count() <= 4)


def clusters(rng, centres, around):
    values = {rng.getrandbits(64) for _ in range(20)}
    for centre in [rng.getrandbits(64) for _ in range(centres)]:
        values |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))) for _ in range(around)}
    return sorted(values)


def test_links_do_not_depend_on_the_order_of_rows(spark):
    """A task that is run again may get its rows in another order, and must give the same pairs."""
    signed = np.array(clusters(random.Random(7), 4, 60), "u8").view("i8").tolist()
    found = []
    for rows in (signed, signed[::-1], random.Random(1).sample(signed, len(signed))):
        table = spark.createDataFrame([(v,) for v in rows], "fp long").coalesce(1)
        found.append({tuple(r) for r in simhash.links(table, 4).collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) > 100


def test_hot_heads_are_sent_on_under_longer_heads(spark, monkeypatch):
    """Around one centre every row has the same heads; no head keeps more than HEAD_ROWS rows, and all links are found."""
    monkeypatch.setattr(simhash, "HEAD_ROWS", 150)
    rng = random.Random(11)
    centre = rng.getrandbits(64)
    values = sorted({centre ^ sum(1 << b for b in rng.sample(range(48), rng.randrange(1, 4))) for _ in range(400)} | set(clusters(rng, 2, 30)))
    fps = np.array(values, "u8")
    table = spark.createDataFrame([(v,) for v in fps.view("i8").tolist()], "fp long")
    hot = simhash.hot_heads(table, len(values), 2, 16)
    sent = Counter(int(k) for _, key in simhash.spread(fps, 2, 16, hot) for k in key)
    before = Counter(int(k) for _, key in simhash.spread(fps, 2, 16, []) for k in key)
    assert len(hot) > 1 and max(before.values()) > 300 and max(n for k, n in sent.items() if k.bit_length() <= simhash.LONGEST) <= 150
    found = {tuple(sorted((int(r["a"]) % (1 << 64), int(r["b"]) % (1 << 64)))) for r in simhash.links(table, 4).collect()}
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    assert groups(values, lambda a, b: (min(a, b), max(a, b)) in found) == groups(values, lambda a, b: (a ^ b).bit_count() <= 4)


def test_links_are_made_once(spark, odd, monkeypatch):
    tables = []
    monkeypatch.setattr(simhash, "land", lambda df, name: tables.append(name) or land(df, name))
    simhash.near_duplicates(odd.filter("length(text) < 1000"))
    assert tables.index("pairs") < tables.index("links")


def test_components_of_paths_stars_and_cycles(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(1000, 2500)] + [(5, x) for x in range(200, 260)] + [(300, 301), (301, 302), (302, 300), (302, 7)]
    rng = random.Random(8)
    rng.shuffle(edges)
    got = defaultdict(set)
    tables = []
    monkeypatch.setattr(simhash, "land", lambda df, name: tables.append(name) or land(df, name))
    for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect():
        got[r["root"]].add(r["node"])
    assert tables.count("names") <= 16  # a path in order of its names as well
    assert {frozenset(v) for v in got.values()} == {frozenset(range(1000, 2501)), frozenset({5, *range(200, 260)}), frozenset({300, 301, 302, 7})}


def lines_by_hand(rows):
    def key(line):
        return low(re.sub(rf"^{ASCII_BLANK}+|{ASCII_BLANK}+$", "", line))
    holders = defaultdict(set)
    rank = {i: (i is not None, i or 0) for i, _ in rows}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(h := holders.get(key(x), ())) >= 3 and i != max(h, key=rank.get))]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def test_line_dedup(odd, odd_rows):
    kept = line_dedup.dedup_lines(odd)
    assert set(odd.columns) <= set(kept.columns)
    got = Counter((r["doc_id"], r["__n_lines"], r["__n_dropped"], r["__text"]) for r in kept.collect())
    want = lines_by_hand(odd_rows)
    assert got == want and sum(k[2] for k in want) > 10


def repeat_words(words, width):
    windows = [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]
    n = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(width)})


def test_quality_base(odd, odd_rows, make, spark):
    want = Counter()
    for i, t in odd_rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        rep = repeat_words(words, 8)
        want[i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, len(words) < 20 or 100 * rep > 30 * len(words)] += 1
    rated = quality.rate(odd)
    assert set(odd.columns) <= set(rated.columns)
    got = Counter((r["doc_id"], *[r["__q"][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]) for r in rated.collect())
    assert got == want
    assert quality.rate(make(spark, [])).collect() == []


def test_quality_verdicts(make, spark):
    prose = "\n".join(" ".join(f"{w}{i}" for w in ("some", "plain", "words", "that", "differ", "from", "line", "to")) + " line." for i in range(6))
    cases = {1: (prose, True), 2: ("\n".join("home | about | news | topic%d | contact" % i for i in range(20)), False), 3: ("Buy$$$ now%%% cheap&&& offer### " * 8 + prose[:60], False),
             4: ("\n".join(f"THIS IS SHOUTED{i} NOW!! AND HERE{i}!!" for i in range(9)), False), 5: (prose + "\nAll rights reserved.\nhome | news | more", True),
             6: (" ".join(f"{w} " * 6 for w in ("some", "words", "over", "and", "again")), False)}
    rows = {r["doc_id"]: r["__q"] for r in quality.rate(make(spark, [(i, t) for i, (t, _) in cases.items()])).collect()}
    assert {i: q["kept"] for i, q in rows.items()} == {i: k for i, (_, k) in cases.items()}
    assert rows[5]["text"] == prose


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


def contaminated_by_hand(rows, items, width=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])].add("" if item is None else str(item))
    out = Counter()
    for i, t in rows:
        w, hit, names = words_of(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k:k + n])):
                    hit |= set(range(k, k + n))
                    names |= found
        out[i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.mark.parametrize("broadcast_rows", [500_000, 0])
def test_decontamination(spark, odd, odd_rows, make, monkeypatch, broadcast_rows):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", broadcast_rows)
    source = odd_rows[20][1]
    items = [(1, source), (2, " ".join(source.split()[3:25]).upper()), (10, "two words"), (3, "DON'T"), (4, None), (5, ""), (6, "never found in any of the texts at hand, not even once"),
             (7, odd_rows[21][1]), (7, odd_rows[21][1]), (None, "three short words"), (8, "w5 word5 w6 word6 w7 word7 w8 word8 w9 word9 w10 word10 w11 word11"), (9, "İstanbul")]
    bench = spark.createDataFrame([(i, t, "?") for i, t in items], "item_id long, text string, window string")
    want = contaminated_by_hand(odd_rows, items)
    got = Counter(map(tuple, decontam.contamination(odd, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()))
    assert got == want and sum(k[5] for k in want) > 5


def test_decontamination_of_empty_tables(spark, odd, odd_rows, make):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(odd, none).filter("contaminated").count() == 0
    assert decontam.contamination(make(spark, []), spark.createDataFrame([(1, "some words")], "item_id long, text string")).collect() == []
    assert simhash.near_duplicates(make(spark, [])).collect() == []
    assert line_dedup.dedup_lines(make(spark, [])).collect() == []


def test_operators_read_only_what_they_need(odd):
    assert simhash.near_duplicates(odd).columns == ["doc_id", "fingerprint", "component_id"]
    assert "Python" not in quality.rate(odd).select("__q.kept")._jdf.queryExecution().toString()
    assert odd.select(F.count("*")).first()[0] > 50


RESULTS = {"__text", "__n_lines", "__n_dropped", "__n_words", "__n_hit", "__windows", "__q", "__score"}


def test_other_columns_pass_whatever_their_names(spark, odd, make):
    from chartwise.llm import toxicity
    docs = odd.withColumn("__score", F.lit("old")).withColumn("__q", F.lit("old")).withColumn("__n_hit", F.lit("old"))
    items = spark.createDataFrame([(1, "this very line is shared by many documents")], "item_id long, text string")
    rest = [c for c in docs.columns if c not in RESULTS]
    want = Counter(map(tuple, docs.select(*[f"`{c}`" for c in rest]).collect()))
    model = toxicity.fit(["you are a scoundrel " * 9] * 5, ["the line of the day " * 9] * 5)
    for out, own in [(line_dedup.dedup_lines(docs), ["__text", "__n_lines", "__n_dropped"]), (decontam.hits(docs, items)[0], ["__n_words", "__n_hit", "__windows"]),
                     (quality.rate(docs), ["__q"]), (toxicity.score(docs, model), ["__score"])]:
        assert out.columns == [c for c in docs.columns if c not in own] + own
        assert Counter(map(tuple, out.select(*[f"`{c}`" for c in rest if c not in own]).collect())) == (want if not set(own) & set(rest) else Counter(map(tuple, docs.select(*[f"`{c}`" for c in rest if c not in own]).collect())))


def test_a_third_of_all_ids_null(spark, make):
    rng = random.Random(6)
    shared = [f"a shared line of some length, number {i}" for i in range(12)]
    rows = [(None if k % 3 == 0 else k, "\n".join([rng.choice(shared) for _ in range(4)] + [f"its own line, which is long enough {k % 40}"])) for k in range(120)]
    got = Counter((r["doc_id"], r["__n_lines"], r["__n_dropped"], r["__text"]) for r in line_dedup.dedup_lines(make(spark, rows, 5)).collect())
    assert got == lines_by_hand(rows)
