"""Token counts by a two-tier lookup on the map side.

One pass makes a bounded summary of each partition's frequent pre-tokens (Misra-Gries, mergeable), merged up a
tree; the merged summary with the pre-tokens' lengths is broadcast as a compact table. The counting pass
looks every pre-token up there and encodes misses through the worker's cache. Pre-tokens are never shuffled;
what moves is one summary of at most ``table_size`` entries per partition.

A pre-token is a run between blanks, tabs and line ends. The tokenizer drops white space and never joins text across it,
so a text's count is the sum over its runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwise.llm.common import doc_columns
from chartwise.llm.vocab import CACHED_UNITS, LETTERS, load, opened, plain_word, slices

#: Bytes of a pre-token that a summary may hold: with the entries they bound it in bytes. Longer ones are rare, and misses.
LONGEST = 64

#: Summaries that one merge takes, and merges above one another: FAN_IN ** LEVELS partitions.
FAN_IN, LEVELS = 32, 4


def runs(texts: pa.Array) -> pa.ListArray:
    flat = texts
    for blank in "\n\t\r":
        flat = pc.replace_substring(flat, blank, " ")
    return pc.split_pattern(flat, " ")


def pruned(words: pa.Array, counts: np.ndarray, size: int) -> tuple[pa.Array, np.ndarray]:
    """Misra-Gries: the ``size`` largest, less the next one's count."""
    if len(counts) <= size:
        return words, counts
    order = np.argsort(-counts, kind="stable")
    counts = counts - counts[order[size]]
    kept = order[:size][counts[order[:size]] > 0]
    return words.take(pa.array(kept)), counts[kept]


def summed(parts: list[tuple[pa.Array, np.ndarray]], size: int) -> tuple[pa.Array, np.ndarray]:
    table = pa.table({"w": pa.concat_arrays([w for w, _ in parts]), "n": np.concatenate([n for _, n in parts])})
    both = table.group_by("w").aggregate([("n", "sum")]).combine_chunks()
    return pruned(both["w"].combine_chunks() if isinstance(both["w"], pa.ChunkedArray) else both["w"], both["n_sum"].to_numpy(), size)


def packed(words: pa.Array, counts: np.ndarray) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.table({"w": words, "n": counts})
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> tuple[pa.Array, np.ndarray]:
    table = pa.ipc.open_stream(blob).read_all().combine_chunks()
    words = table["w"].combine_chunks()
    return (words if isinstance(words, pa.Array) else pa.concat_arrays(words.chunks)), table["n"].to_numpy()


def frequent(docs: DataFrame, size: int) -> pa.Array:
    """At most ``size`` pre-tokens of up to LONGEST bytes, every one with over 1/size of their occurrences among them."""
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = pa.array([], pa.string()), np.zeros(0, dtype="i8")
        for part in slices(batches):
            seen = runs(part.column("text")).flatten().dictionary_encode()
            n = np.bincount(seen.indices.to_numpy(zero_copy_only=False), minlength=len(seen.dictionary))
            short = pc.less_equal(pc.binary_length(seen.dictionary), LONGEST)
            words, counts = summed([(words, counts), (seen.dictionary.filter(short), n[short.to_numpy(zero_copy_only=False)])], size)
        yield pa.RecordBatch.from_pydict({"place": pa.array([TaskContext.get().partitionId()], pa.int64()), "blob": pa.array([packed(words, counts)], pa.binary())})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"place": [int(group["place"].iloc[0])], "blob": [packed(*summed([unpacked(b) for b in group["blob"]], size))]})

    tree = docs.select("text").mapInArrow(summarise, "place long, blob binary")
    for _ in range(LEVELS):
        tree = tree.withColumn("place", F.floor(F.col("place") / FAN_IN)).groupBy("place").applyInPandas(merge, "place long, blob binary")
    found = [unpacked(bytes(r["blob"])) for r in tree.collect()]  # one row, or one per FAN_IN ** LEVELS partitions
    return pa.array(sorted(summed(found, size)[0].to_pylist()), pa.string()) if found else pa.array([], pa.string())


class UnitCounts:
    """Token counts of pre-tokens for a word-level BPE file that drops white space."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.cache: dict[str, int] = {}

    def count(self, unit: str) -> int:
        if plain := plain_word(unit):
            core, mark = plain
            # lower-casing maps Latin-1 letters one to one; byte letters as in byte-level vocabularies
            n = len(self.model.tokenize(core.lower().encode().decode("latin-1").translate(LETTERS)))
            return n + (len(self.model.tokenize(mark)) if mark else 0)
        return len(self.tokenizer.encode(unit, add_special_tokens=False).ids)

    def of(self, units: list[str]) -> list[int]:
        if len(self.cache) > CACHED_UNITS:
            self.cache.clear()
        out = []
        for unit in units:
            n = self.cache.get(unit)
            if n is None:
                n = self.cache[unit] = self.count(unit)
            out.append(n)
        return out


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id",
                 text_col: str = "text", table_size: int = 8192) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), as the tokenizers library counts.

    A null text counts as empty (0 tokens); a null id stays null; repeated rows give repeated rows; an empty
    table gives an empty one; other columns aren't read. ``table_size`` bounds the broadcast table.
    """
    spark = docs.sparkSession
    docs = doc_columns(docs, id_col, text_col)
    words = frequent(docs, table_size)
    sizes = np.array(UnitCounts(tokenizer_path).of(words.to_pylist()), dtype="i4")
    table = spark.sparkContext.broadcast(packed(words, sizes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_n = unpacked(table.value)
        rest = opened(UnitCounts, tokenizer_path)
        for part in slices(batches):
            texts = part.column("text")
            units = runs(texts)
            flat = units.flatten().dictionary_encode()
            place = pc.index_in(flat.dictionary, known)
            hit = place.is_valid().to_numpy(zero_copy_only=False)
            n_of = np.zeros(len(flat.dictionary), dtype="i8")
            n_of[hit] = known_n[place.drop_null().to_numpy()]
            missed = np.flatnonzero(~hit)
            n_of[missed] = rest.of(flat.dictionary.take(pa.array(missed)).to_pylist())
            ends = np.concatenate([[0], np.cumsum(n_of[flat.indices.to_numpy(zero_copy_only=False)])])
            at = ends[units.offsets.to_numpy() - units.offsets[0].as_py()]
            n = np.diff(at)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": pc.binary_length(texts).cast(pa.int64()),
                                              "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array(n > limit)})

    return docs.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
