"""Alignment of two tokenizers' ids over the same texts, and how often ids are linked in the corpus.

Tokens of both sides end at byte offsets. An end-to-index dictionary for each side is intersected as a hash set;
the sorted common ends cut both id lists into groups, and every A-B pair of a slice is a link. Texts are cut into
units (' word', '\\nword') at whose borders tokens of both sides always end, so a worker aligns each unit once and
the rest is array work; texts in which that isn't certain are aligned whole.

How many documents link an id pair is counted map-side and summed by pair. The lookup back is in two tiers: at most
HEAD pairs, those of the highest counts, are broadcast; the others, none of which is in many documents, are joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwise.llm.common import doc_columns, land
from chartwise.llm.vocab import LETTERS, UNSURE, UnitIds, close, load, opened, slices

#: Pairs in the broadcast tier, distinct pairs that a task counts before it hands them on, aligned units kept by a
#: worker. They bound memory and never change a result.
HEAD, COUNTED, CACHED = 500_000, 1_000_000, 200_000

#: Bytes of text handled at once, units aligned at once, links of a slice from which on distinct ids are paired, labels of
#: text made at once. They bound memory likewise.
BYTES, BLOCK, LARGE, TEXT_LABELS = 2 << 20, 20_000, 100_000, 500_000

BLANK = "▁"  # stands for a blank in side B's pieces


class Aligned(NamedTuple):
    """Groups of many texts: ``counts`` has a row (tokens of A, of B, groups, links) for each, ``labels`` and ``pairs``
    hold ``n_labels`` and ``n_pairs`` of each, one after another. A label is a token's id with what follows it in
    a1,a2|b1;a3|b2,b3; pairs are linked ids (a * size_b + b), each ``times`` often."""

    counts: np.ndarray
    n_labels: np.ndarray
    labels: np.ndarray
    n_pairs: np.ndarray
    pairs: np.ndarray
    times: np.ndarray

    @classmethod
    def nothing(cls, n: int) -> Aligned:
        return cls(np.zeros((n, 4), "i8"), np.zeros(n, "i8"), np.zeros(0, "i4"), np.zeros(n, "i8"), np.zeros(0, "i8"), np.zeros(0, "i8"))

    def joined(self, other: Aligned) -> Aligned:
        return Aligned(*[np.concatenate(both) for both in zip(self, other, strict=True)]) if len(other.counts) else self

    def only(self, texts: np.ndarray) -> Aligned:
        labels, pairs = (spread((np.cumsum(n) - n)[texts], n[texts]) for n in (self.n_labels, self.n_pairs))
        return Aligned(self.counts[texts], self.n_labels[texts], self.labels[labels], self.n_pairs[texts], self.pairs[pairs], self.times[pairs])


def size_of_b(path: str) -> int:
    from sentencepiece import SentencePieceProcessor
    return SentencePieceProcessor(model_file=path).get_piece_size()


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all values, how many are of each list)."""
    n = np.fromiter(map(len, lists), "i8", len(lists))
    return np.fromiter(chain.from_iterable(lists), "i8", int(n.sum())), n


def end_index(sizes: np.ndarray) -> dict[int, int]:
    """Byte offset where a token ends -> how many tokens end there or before."""
    return dict(zip(np.cumsum(sizes).tolist(), range(1, len(sizes) + 1), strict=True))


class Aligner:
    """A byte-level BPE file (A) and a sentencepiece model (B) side by side, with a worker's store of aligned units."""

    def __init__(self, paths: tuple[str, str]):
        from sentencepiece import SentencePieceProcessor
        self.a = UnitIds(paths[0])
        self.a.tokenizer.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=paths[1])
        self.size_b = self.b.get_piece_size()
        byte_of = {letter: b for b, letter in LETTERS.items()}
        vocabulary = self.a.tokenizer.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(BLANK, " ").encode()
                        for i in range(self.size_b)]
        self.len_a, self.len_b = (np.array([len(t) for t in side], "i8") for side in (self.bytes_a, self.bytes_b))
        self.labels = pa.array([f"{i}{c}" for side, marks in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for i in range(len(side)) for c in marks], pa.string())
        self.place: dict[str, int] = {"": 0}
        self.store, self.seen = Aligned.nothing(1), np.zeros(1, "i8")

    def keep(self, often: int) -> None:
        """Forget all units but the empty one and those that the most slices had."""
        stay = np.union1d(np.argsort(-self.seen, kind="stable")[:often], [0])
        number = np.full(len(self.seen), -1)
        number[stay] = np.arange(len(stay))
        self.place = {u: int(number[i]) for u, i in self.place.items() if number[i] >= 0}
        self.store, self.seen = self.store.only(stay), self.seen[stay] // 2

    def align(self, lists_a: list[list[int]], lists_b: list[list[int]]) -> Aligned:
        """The groups of texts with tokens, whose bytes are the same on both sides; offsets run on from text to text."""
        if not lists_a:
            return Aligned.nothing(0)
        (a, n_a), (b, n_b) = flat(lists_a), flat(lists_b)
        index_a, index_b = end_index(self.len_a[a]), end_index(self.len_b[b])
        ends = sorted(index_a.keys() & index_b.keys())
        cut_a, cut_b = (np.fromiter(map(index.__getitem__, ends), "i8", len(ends)) for index in (index_a, index_b))
        first_a, first_b = np.r_[0, cut_a[:-1]], np.r_[0, cut_b[:-1]]
        of_a, of_b = cut_a - first_a, cut_b - first_b
        text = np.searchsorted(np.cumsum(n_a), first_a, side="right")
        groups, links = np.bincount(text, minlength=len(n_a)), np.zeros(len(n_a), "i8")
        np.add.at(links, text, of_a * of_b)
        # in the text, a group's A tokens come before its B tokens
        labels = np.zeros(len(a) + len(b), "i4")
        mark_a, mark_b = np.zeros(len(a), "i8"), np.zeros(len(b), "i8")
        mark_a[cut_a - 1] = mark_b[cut_b - 1] = 1
        labels[np.arange(len(a)) + np.repeat(first_b, of_a)] = 2 * a + mark_a
        labels[np.arange(len(b)) + np.repeat(cut_a, of_b)] = 2 * (len(self.bytes_a) + b) + mark_b
        # every pair of a slice; of a very large slice every pair of distinct ids, with how often it occurs
        large = of_a * of_b > LARGE
        n = np.where(large, 0, of_a * of_b)
        own = np.repeat(np.arange(len(ends)), n)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        pairs = a[first_a[own] + nth // of_b[own]] * self.size_b + b[first_b[own] + nth % of_b[own]]
        times, owner = np.ones(len(pairs), "i8"), text[own]
        for g in np.flatnonzero(large):
            (x, many), (y, much) = (np.unique(ids, return_counts=True) for ids in (a[first_a[g]:cut_a[g]], b[first_b[g]:cut_b[g]]))
            pairs = np.concatenate([pairs, (x[:, None] * self.size_b + y[None, :]).ravel()])
            times = np.concatenate([times, (many[:, None] * much[None, :]).ravel()])
            owner = np.concatenate([owner, np.full(len(x) * len(y), text[g])])
        if large.any():
            order = np.argsort(owner, kind="stable")
            pairs, times, owner = pairs[order], times[order], owner[order]
        return Aligned(np.stack([n_a, n_b, groups, links], axis=1), n_a + n_b, labels, np.bincount(owner, minlength=len(n_a)), pairs, times)

    def whole(self, texts: list[str]) -> Aligned:
        """Texts without cuts; those that are empty or whose bytes differ on a side have no tokens."""
        out = Aligned.nothing(0)
        for text in texts:
            a, b, raw = self.a.tokenizer.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), (" " + text).encode()
            same = text and b"".join([self.bytes_a[i] for i in a]) == b"".join([self.bytes_b[i] for i in b]) == raw
            out = out.joined(self.align([a], [b]) if same else Aligned.nothing(1))
        return out

    def places(self, units: list[str]) -> np.ndarray:
        """Where the store has ' word' (given without its blank) or '\\nword'; units that it lacks are aligned BLOCK at a time."""
        if len(self.place) > CACHED:
            self.keep(CACHED // 2)
        lacking = [u for u in units if u not in self.place]
        for at in range(0, len(lacking), BLOCK):
            new = lacking[at:at + BLOCK]
            lists_a = [self.a.unit_ids(u) for u in new]
            lists_b = self.b.encode(new, num_threads=1)  # before each unit B puts its blank, which a line's beginning hasn't
            lists_b = [ids[1:] if u[0] == "\n" else ids for u, ids in zip(new, lists_b, strict=True)]
            raw = "".join([u if u[0] == "\n" else " " + u for u in new]).encode()
            if not b"".join([self.bytes_a[i] for ids in lists_a for i in ids]) == b"".join([self.bytes_b[i] for ids in lists_b for i in ids]) == raw:
                raise ValueError("bytes of units differ")
            self.place |= zip(new, range(len(self.place), len(self.place) + len(new)))
            self.store = self.store.joined(self.align(lists_a, lists_b))
        found = np.fromiter(map(self.place.__getitem__, units), "i8", len(units))
        self.seen = np.concatenate([self.seen, np.zeros(len(self.place) - len(self.seen), "i8")])
        self.seen[found] += 1
        return found

    def digests(self, known: Aligned, code: np.ndarray, ends: np.ndarray) -> list[str]:
        """sha256 of each document's groups as text; document i has the units code[ends[i]:ends[i + 1]]."""
        n, start = known.n_labels[code], (np.cumsum(known.n_labels) - known.n_labels)[code]
        size = np.r_[0, np.cumsum(n)][ends]  # labels before each document
        out, doc = [], 0
        while doc < len(ends) - 1:
            to = max(doc + 1, int(np.searchsorted(size, size[doc] + TEXT_LABELS, side="right")) - 1)
            if to == doc + 1:  # one document, perhaps a long one: in pieces
                digest, some = hashlib.sha256(), False
                for at in range(int(ends[doc]), int(ends[doc + 1]), TEXT_LABELS // 4):
                    piece = slice(at, min(at + TEXT_LABELS // 4, int(ends[doc + 1])))
                    raw = self.text(known.labels[spread(start[piece], n[piece])])[0]
                    if some and len(raw):
                        digest.update(b";")
                    digest.update(raw[:-1])
                    some = some or len(raw) > 0
                out.append(digest.hexdigest() if some else "")
            else:
                piece = slice(int(ends[doc]), int(ends[to]))
                raw, offsets = self.text(known.labels[spread(start[piece], n[piece])])
                cuts = offsets[size[doc:to + 1] - size[doc]].tolist()
                out += [hashlib.sha256(raw[s:e - 1]).hexdigest() if e > s else "" for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
            doc = to
        return out

    def text(self, labels: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """(the labels' characters one after another, where each begins)."""
        if not len(labels):
            return memoryview(b""), np.zeros(1, "i4")
        _, offsets, data = self.labels.take(pa.array(labels)).buffers()
        offsets = np.frombuffer(offsets, "i4")[:len(labels) + 1]
        return memoryview(data)[offsets[0]:offsets[-1]], offsets - offsets[0]


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the exact sums of their values."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(values, starts)


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Positions first[i] .. first[i] + n[i] - 1, one after another."""
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


ROWS = "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def aligned_rows(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Each document's counts, digest and distinct linked pairs. ``docs``: rid, doc_id, text."""
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = opened(Aligner, paths)
        for part in slices(batches, size=BYTES):
            texts = part.column("text")
            unsure = pc.match_substring_regex(texts, f"{UNSURE}|{BLANK}")
            units = pc.split_pattern(pc.replace_substring(pc.if_else(unsure, pa.scalar(""), texts), "\n", " \n"), " ")
            flat_units = units.flatten().dictionary_encode()
            ends = units.offsets.to_numpy().astype("i8") - units.offsets[0].as_py()
            doc = np.repeat(np.arange(len(units)), np.diff(ends))
            code = aligner.places(flat_units.dictionary.to_pylist())[flat_units.indices.to_numpy(zero_copy_only=False)]
            # a text that is aligned whole is one unit of its own: it was made empty, which is one unit
            odd = np.flatnonzero(unsure.to_numpy(zero_copy_only=False))
            code[ends[odd]] = len(aligner.store.counts) + np.arange(len(odd))
            known = aligner.store.joined(aligner.whole(texts.take(pa.array(odd)).to_pylist()))
            total = dict(zip(("n_a", "n_b", "n_groups", "n_links"), np.add.reduceat(known.counts[code], ends[:-1]).T, strict=True))
            digest = aligner.digests(known, code, ends)
            # (document, unit) -> (document, pair)
            seen, repeats = np.unique(doc * len(known.counts) + code, return_counts=True)
            seen_doc, seen_code = np.divmod(seen, len(known.counts))
            n_of = known.n_pairs[seen_code]
            take = spread((np.cumsum(known.n_pairs) - known.n_pairs)[seen_code], n_of)
            names, place = np.unique(known.pairs[take], return_inverse=True)
            keys, times = summed(np.repeat(seen_doc, n_of) * max(1, len(names)) + place, np.repeat(repeats, n_of) * known.times[take])
            at = np.concatenate([[0], np.cumsum(np.bincount(keys // max(1, len(names)), minlength=len(units)))]).astype("i4")
            yield pa.RecordBatch.from_pydict({
                "rid": part.column("rid"), "doc_id": part.column("doc_id"), **{c: pa.array(v, pa.int64()) for c, v in total.items()}, "groups_sha256": pa.array(digest, pa.string()),
                "pairs": pa.ListArray.from_arrays(pa.array(at), pa.array(names[keys % max(1, len(names))], pa.int64())), "times": pa.ListArray.from_arrays(pa.array(at), pa.array(times, pa.int64()))})

    return docs.mapInArrow(align, ROWS)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n: how many documents hold the pair linked."""
    limit = COUNTED

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        close()
        keys, n = np.zeros(0, "i8"), np.zeros(0, "i8")

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"pair": pa.array(keys), "n": pa.array(n)})

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                own, m = np.unique(batch.column("pairs").slice(at, 1000).flatten().to_numpy(zero_copy_only=False), return_counts=True)
                keys, n = summed(np.concatenate([keys, own]), np.concatenate([n, m]))
                if len(keys) > limit:
                    yield out()
                    keys, n = np.zeros(0, "i8"), np.zeros(0, "i8")
        yield out()

    return rows.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def looked_up(rows: DataFrame, table, missed: bool) -> DataFrame:
    """Sums over the broadcast tier for each row; with ``missed``, the pairs that it lacks instead."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        close()
        names, counts, best, size_b = table.value
        for batch in batches:
            lists = batch.column("pairs")
            pairs, times = lists.flatten().to_numpy(zero_copy_only=False), batch.column("times").flatten().to_numpy(zero_copy_only=False)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            place = np.minimum(np.searchsorted(names, pairs), max(0, len(names) - 1))
            hit = names[place] == pairs if len(names) else np.zeros(len(pairs), bool)
            if missed:
                yield pa.RecordBatch.from_pydict({"rid": batch.column("rid").take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(ends))[~hit])),
                                                  "pair": pa.array(pairs[~hit], pa.int64()), "times": pa.array(times[~hit], pa.int64())})
                continue
            n = np.where(hit, counts[place] if len(names) else 0, 0)
            sums = [np.concatenate([[0], np.cumsum(v)]) for v in (times * n, times * (hit & (n == best[pairs // size_b])))]
            out = {c: batch.column(c) for c in batch.schema.names if c not in ("pairs", "times")}
            yield pa.RecordBatch.from_pydict(out | {c: pa.array(np.diff(s[ends]), pa.int64()) for c, s in zip(("count_sum", "n_best"), sums, strict=True)})

    if missed:
        return rows.select("rid", "pairs", "times").mapInArrow(look, "rid long, pair long, times long")
    return rows.mapInArrow(look, ROWS.replace("pairs array<long>, times array<long>", "count_sum long, n_best long"))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A null or empty text, and one whose tokens' bytes differ from a blank and the text, has no tokens: zeros and
    an empty digest. Rows that repeat an id are documents of their own, a null id stays null, an empty table gives
    an empty one, other columns aren't read. Texts of any length are aligned whole.
    """
    spark = docs.sparkSession
    docs = doc_columns(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id())
    rows = land(aligned_rows(docs, (path_a, path_b)), "aligned")
    counts = land(pair_counts(rows), "pair-counts")
    size_a, size_b = load(path_a).get_vocab_size(), size_of_b(path_b)
    id_a = F.floor(F.col("pair") / size_b).cast("long")
    highest = counts.groupBy(id_a.alias("a")).agg(F.max("n").alias("best"))  # at most a row for each id of side A
    found = highest.toArrow()
    best = np.zeros(size_a, "i8")
    best[found["a"].to_numpy()] = found["best"].to_numpy()
    step = F.floor(F.log2(F.col("n")) * 16)  # some hundred steps of counts
    least, held = None, 0
    for row in counts.groupBy(step.alias("step")).count().orderBy(F.col("step").desc()).collect():
        if held + row["count"] > HEAD:
            break
        least, held = row["step"], held + row["count"]
    n_pairs = counts.count()
    head = (counts.filter(step >= least) if least is not None else counts.limit(0)).toArrow().sort_by("pair")
    table = spark.sparkContext.broadcast((head["pair"].to_numpy(), head["n"].to_numpy(), best, size_b))
    out = looked_up(rows, table, missed=False)
    if held < n_pairs:
        rest = counts if least is None else counts.filter(step < least)
        rest = rest.withColumn("a", id_a).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("best")).cast("long").alias("top"))
        more = (looked_up(rows, table, missed=True).join(rest, "pair").groupBy("rid")
                .agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.col("times") * F.col("top")).alias("more_best")))
        out = (out.join(more, "rid", "left").withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
               .withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
