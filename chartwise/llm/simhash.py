"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within 2r bits share a value within r bits of both. Every fingerprint therefore emits all
variants within r = half the radius, and fingerprints whose variants collide are linked. The shuffle
key is the variant's first ``head`` bits: a fingerprint is sent to each head within r of its own, with the flips
left over, and the task that owns a head makes the variants' remaining bits there. This gives the same
collisions as shuffling whole variants (2,081 a fingerprint at r = 2) for 137 short rows a fingerprint at
head = 16. All fingerprints that share a variant are within 2r of one another, so a chain through them,
verified bit by bit, links them without pairs; a task emits the spanning forest of its chains. Rows are counted
per head first, and heads with too many are replaced by longer ones, so that no task holds a large cluster whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartwise.llm.common import id_key, land
from chartwise.llm.vocab import close

#: Variants made at once by a task. A head with more is divided by its next SUB bits.
VARIANTS, SUB = 2_000_000, 8
#: Rows that a head may hold before they are sent on under heads longer by SUB bits; heads that are sent on, at most;
#: fingerprints that a task's forest remembers.
HEAD_ROWS, HOT_HEADS, REMEMBERED = 100_000, 1_000_000, 500_000
#: Bits of the longest head: with fewer than 64, a head and the mark of its length fit in a long. It holds the rows of
#: the fingerprints within two bits, 4 * 1,954 at most.
LONGEST = 62


def shingle_hashes(text: str | None, size: int, seed: int) -> np.ndarray:
    """XXH64 of the word shingles of a text (ASCII white space, A-Z lower-cased), as rows of 8 bytes, high byte first."""
    from xxhash import xxh64_digest as digest
    words = (text or "").encode().lower().split()
    if len(words) <= size:
        raw = digest(b" ".join(words), seed) if words else b""
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype="i8", count=len(words)) + 1) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        raw = b"".join([digest(line[a:b], seed) for a, b in zip(starts, ends[size - 1:].tolist(), strict=False)])
    return np.frombuffer(raw, dtype="u1").reshape(-1, 8)


def simhash(text: str | None, size: int, seed: int) -> int:
    """The fingerprint as a signed long; 0 for a text without words."""
    hashes = shingle_hashes(text, size, seed)
    ones = np.zeros(64, dtype="i8")
    for at in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[at:at + 65_536], axis=1).sum(axis=0, dtype="i4")
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, size: int, seed: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        close()
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"__doc": batch.column("__doc"), "fp": pa.array([simhash(t.as_py(), size, seed) for t in batch.column("__text")], pa.int64())})

    return docs.mapInArrow(each, "__doc long, fp long")


def flips(bits: int, most: int) -> list[np.ndarray]:
    """For each number of flips up to ``most``: the masks with that many of the lowest ``bits`` bits."""
    return [np.array([sum(1 << b for b in c) for c in itertools.combinations(range(bits), n)], dtype="u8") for n in range(min(most, bits) + 1)]


def sent(fps: np.ndarray, left: np.ndarray, at: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, flips left): each fingerprint under every value within its flips of its ``bits`` bits above bit ``at``."""
    own = (fps >> np.uint64(at)) & np.uint64((1 << bits) - 1)
    rows, keys, rest = [], [], []
    for n, masks in enumerate(flips(bits, int(left.max(initial=0)))):
        who = np.flatnonzero(left >= n)
        rows.append(np.repeat(who, len(masks)))
        keys.append((own[who, None] ^ masks).ravel())
        rest.append(np.repeat(left[who] - n, len(masks)))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(rest)


def collisions(fps: np.ndarray, key: np.ndarray, left: np.ndarray, low: int) -> np.ndarray:
    """Pairs of rows (n, 2) in chains through those that share a variant: ``key`` above ``low`` free bits."""
    base = (key << np.uint64(low) if low < 64 else key * 0) | (fps & np.uint64((1 << low) - 1))
    masks = flips(low, int(left.max(initial=0)))
    values, owners = [], []
    for n, own in enumerate(masks):
        who = np.flatnonzero(left >= n)
        values.append((base[who, None] ^ own).ravel())
        owners.append(np.repeat(who, len(own)))
    value, owner = np.concatenate(values), np.concatenate(owners)
    ranked = np.sort(value)
    shared = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(shared):
        return np.zeros((0, 2), dtype="i8")
    shared = shared[np.concatenate([[True], shared[1:] != shared[:-1]])]
    place = np.minimum(np.searchsorted(shared, value), len(shared) - 1)
    among = np.flatnonzero(shared[place] == value)
    order = among[np.lexsort((owner[among], value[among]))]
    same = value[order][1:] == value[order][:-1]
    pairs = np.stack([owner[order][:-1][same], owner[order][1:][same]], axis=1)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def search(fps: np.ndarray, key: np.ndarray, left: np.ndarray, low: int) -> Iterator[np.ndarray]:
    """Chains as pairs of fingerprints. Rows are sorted by key; whole keys are searched together up to VARIANTS."""
    size = np.array([sum(len(m) for m in flips(low, n)) for n in range(3)])[np.minimum(left, 2)] if low else np.ones(len(fps), "i8")
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    cost = np.add.reduceat(size, edges[:-1]) if len(fps) else size
    a = 0
    while a < len(cost):
        b, total = a + 1, cost[a]
        while b < len(cost) and total + cost[b] <= VARIANTS:
            total += cost[b]
            b += 1
        part = slice(edges[a], edges[b])
        if total > VARIANTS and low > SUB:  # one key with very many: divide it by the next bits
            row, sub, rest = sent(fps[part], left[part], low - SUB, SUB)
            order = np.argsort(sub, kind="stable")
            yield from search(fps[part][row][order], (key[part][row] << np.uint64(SUB) | sub)[order], rest[order], low - SUB)
        else:
            yield fps[part][collisions(fps[part], key[part], left[part], low)]
        a = b


class Forest:
    """Keeps the pairs that join two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while up.get(top, top) != top:
            top = up[top]
        while up.get(x, x) != x:
            up[x], x = top, up[x]
        return top

    def joins(self, a: int, b: int) -> bool:
        ra, rb = self.root(a), self.root(b)
        if ra == rb:
            return False
        self.up[max(ra, rb)] = min(ra, rb)
        return True


def steps(head: int) -> list[int]:
    """Lengths of heads, from ``head`` on."""
    return [*range(head, LONGEST, SUB), LONGEST]


def spread(fps: np.ndarray, half: int, head: int, hot: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, head with a bit set above it) of each fingerprint; hot heads (sorted, one array a length) are replaced by
    the longer heads of the same variants."""
    row, key, left = sent(fps, np.full(len(fps), half), 64 - head, head)
    lengths = steps(head)
    for i, bits in enumerate(lengths):
        on = hot[i][np.minimum(np.searchsorted(hot[i], key), len(hot[i]) - 1)] == key if i < len(hot) else np.zeros(len(key), "?")
        if not on.all():
            yield row[~on], key[~on] | np.uint64(1 << bits)
        if not on.any():
            return
        more = lengths[i + 1] - bits
        row, key, left = row[on], key[on], left[on]
        again, sub, left = sent(fps[row], left, 64 - bits - more, more)
        row, key = row[again], key[again] << np.uint64(more) | sub


def hot_heads(fps: DataFrame, n: int, half: int, head: int) -> list[np.ndarray]:
    """Heads of each length with over HEAD_ROWS rows (more where there would be over HOT_HEADS of them), until a length
    has none. Heads depend on a fingerprint's own first bits alone, so those are counted first."""
    hot: list[np.ndarray] = []
    for bits in steps(head)[:-1]:
        def rows(batches: Iterator[pa.RecordBatch], bits: int = bits, above: tuple = tuple(hot)) -> Iterator[pa.RecordBatch]:
            for many in batches:
                for at in range(0, many.num_rows, 1000):
                    own = many.column("first").slice(at, 1000).to_numpy().view("u8") << np.uint64(64 - bits)
                    times = many.column("n").slice(at, 1000).to_numpy()
                    for row, key in spread(own, half, head, list(above)):
                        here = key >> np.uint64(bits) == 1
                        yield pa.RecordBatch.from_pydict({"head": pa.array((key[here] ^ np.uint64(1 << bits)).view("i8")), "n": pa.array(times[row[here]])})

        first = fps.groupBy(F.shiftrightunsigned("fp", 64 - bits).alias("first")).agg(F.count(F.lit(1)).alias("n"))
        most = max(HEAD_ROWS, n * sum(len(m) for m in flips(bits, half)) // HOT_HEADS)
        counted = first.mapInArrow(rows, "head long, n long").groupBy("head").agg(F.sum("n").alias("n")).filter(F.col("n") > most)
        found = np.sort(counted.select("head").toArrow()["head"].to_numpy().astype("i8").view("u8"))  # at most HOT_HEADS
        if not len(found):
            break
        hot.append(found)
    return hot


def links(fps: DataFrame, radius: int) -> DataFrame:
    """(a, b) fingerprints within ``radius`` (even, at most 4) bits; enough of them to connect all that are linked.

    The forest of a task depends on the order of its rows, so they are sorted by (head, fp), which is unique: a task
    that is run again gives the same pairs.
    """
    half, n = radius // 2, max(2, fps.count())
    head = min(32, max(16, (n - 1).bit_length() - 6))
    hot = fps.sparkSession.sparkContext.broadcast(hot_heads(fps, n, half, head))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for many in batches:
            for at in range(0, many.num_rows, 1000):
                own = many.column("fp").slice(at, 1000).to_numpy().view("u8")
                for row, key in spread(own, half, head, hot.value):
                    yield pa.RecordBatch.from_pydict({"head": pa.array(key.view("i8")), "fp": pa.array(own[row].view("i8"))})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, kept = Forest(), (np.zeros(0, "u8"), np.zeros(0, "u8"))

        def pairs(marked: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
            lengths = steps(head)
            cuts = np.searchsorted(marked, np.array([1 << bits for bits in lengths], dtype="u8")).tolist()
            for bits, a, b in zip(lengths, cuts, [*cuts[1:], len(marked)], strict=True):
                if a < b:
                    yield from alike(marked[a:b] ^ np.uint64(1 << bits), own[a:b], 64 - bits)

        def alike(key: np.ndarray, own: np.ndarray, low: int) -> Iterator[pa.RecordBatch]:
            left = half - np.bitwise_count(own >> np.uint64(low) ^ key).astype("i8")
            for found in search(own, key, left, low):
                near = found[np.bitwise_count(found[:, 0] ^ found[:, 1]) <= radius].view("i8")
                new = [(a, b) for a, b in near.tolist() if forest.joins(a, b)]
                if len(forest.up) > REMEMBERED:  # some pairs are given twice then
                    forest.up.clear()
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in new], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            key, own = (np.concatenate([k, batch.column(c).to_numpy().view("u8")]) for k, c in zip(kept, ("head", "fp"), strict=True))
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on in the next batch
            kept = key[cut:], own[cut:]
            yield from pairs(key[:cut], own[:cut])
        yield from pairs(*kept)

    return fps.select("fp").mapInArrow(send, "head long, fp long").repartition("head").sortWithinPartitions("head", "fp").mapInArrow(meet, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b); a component's nodes share a root, which is one of them.

    Nodes are ordered by a hash that is new in each round. Every node takes the name of the first among itself and
    its neighbours, edges are renamed, and those within a name go, until none is left. As the order is random, a
    round removes an expected constant share of the nodes that still have edges, also of paths and stars.
    """
    both = land(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))), "links")
    rounds: list[DataFrame] = []
    while not both.isEmpty():
        def ranked(node: str, turn: int = len(rounds)) -> Column:
            return F.struct(F.xxhash64(node, F.lit(turn)).alias("h"), F.col(node).alias("n"))

        to = land(both.groupBy("a").agg(F.min(ranked("b")).alias("first")).select("a", F.least("first", ranked("a"))["n"].alias("to")), "names")
        rounds.append(to)
        renamed = (both.join(to, "a").select(F.col("to").alias("x"), "b").join(to.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
                   .filter("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        both = land(renamed, "links")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = rounds[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for to in rounds[1:]:
        out = out.join(to.select(F.col("a").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return land(out, "components")


def near_duplicates(docs: DataFrame, size: int = 4, radius: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable over links).

    Links hold between fingerprints at ``radius`` (even) or fewer differing bits. Null and empty texts have
    the fingerprint zero and link like others. Rows that repeat an id are kept and fingerprinted one by one. A
    null id stays null and links like others, but names a component only if no other id is in it, which then
    is null. An empty table gives an empty one; other columns aren't read.
    """
    own = land(fingerprints(docs.select(id_key(id_col).alias("__doc"), F.col(text_col).cast("string").alias("__text")), size, seed), "fingerprints")
    real = F.expr(f"nullif(__doc, {-(1 << 63) + 1}L - 1L)")
    by_fp = land(own.groupBy("fp").agg(F.min(real).alias("first")), "distinct-fingerprints")
    of = components(land(links(by_fp, radius), "pairs"))  # read twice, so made once
    named = by_fp.join(of.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = land(named, "named-fingerprints")
    first = land(named.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")
    to = land(named.join(first, "root").select("fp", "component_id"), "fingerprint-components")
    return own.join(to, "fp").select(real.alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
