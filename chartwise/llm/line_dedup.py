"""Lines repeated across documents: hash normalised lines, count distinct documents of a hash, drop, reassemble.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased; keys are compared by
128-bit XXH3. The (document, hash) pairs are landed once: counting pre-aggregates them, and the join that
finds a document's dropped hashes has landed tables on both sides, so that AQE splits a hash that holds a
large part of all rows. Whole texts move once, to meet their own dropped hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartwise.llm.common import aside, back, id_key, land, quoted
from chartwise.llm.vocab import close

BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()  # bytes.lower() maps A-Z only


def hashes(lines: list[bytes], min_chars: int) -> list[bytes | None]:
    """A 16-byte hash for each line whose key has at least ``min_chars`` code points."""
    from xxhash import xxh3_128_digest as digest
    keys = [line_key(line) for line in lines]
    # a code point takes one to four bytes: only lengths between need a count
    return [digest(k) if len(k) >= 4 * min_chars or (len(k) >= min_chars and len(k.decode()) >= min_chars) else None for k in keys]


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``__text`` (the lines that stay), ``__n_lines`` and ``__n_dropped``.

    A key of at least ``min_chars`` code points that ``min_docs`` distinct documents hold stays only in the
    largest id among them, with all its lines there. Rows that repeat an id are one document for the count,
    and each of them keeps its own row. Null ids count together as one document smaller than all others, but every
    row's lines are dropped by its own text; a null text is one empty line; an empty table gives an empty one; other columns,
    whatever their names, pass through (those named as the results are replaced). Very long texts are split whole.
    """
    columns = docs.columns
    text = F.col(quoted(text_col)).cast("string")
    # rows of one id with different texts are told apart: a null id may have any number of them
    wide = aside(docs, doc=id_key(id_col), own=F.xxhash64(text), text=text)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        close()
        for batch in batches:
            found, n = [], []
            for raw in batch.column("raw"):
                lines = set(hashes((raw.as_py() or b"").split(b"\n"), min_chars)) - {None}
                n.append(len(lines))
                found += lines
            both = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
            rows = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_pydict({"doc": batch.column("doc").take(rows), "own": batch.column("own").take(rows), "h1": pa.array(both[:, 0].copy()), "h2": pa.array(both[:, 1].copy())})

    held = land(wide.select("doc", "own", F.col("text").cast("binary").alias("raw")).mapInArrow(pairs, "doc long, own long, h1 long, h2 long"), "lines")
    common = land(held.select("doc", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("keeper")).filter(F.col("n") >= min_docs).drop("n"), "common-lines")
    dropped = (held.join(common, ["h1", "h2"]).filter("doc != keeper").groupBy("doc", "own")
               .agg(F.collect_set(F.struct("h1", "h2")).alias("drop")))  # at most a text's own lines

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column("text").to_pylist(), batch.column("drop"), strict=True):
                text = text or ""
                n = text.count("\n") + 1
                if not drop.is_valid:
                    kept = n
                else:
                    both = drop.values
                    out = {bytes(x) for x in np.stack([both.field(f).to_numpy(zero_copy_only=False) for f in (0, 1)], axis=1).astype("<i8").view("V16").ravel()}
                    lines = text.encode().split(b"\n")
                    stay = [line for line, h in zip(lines, hashes(lines, min_chars), strict=True) if h not in out]
                    kept, text = len(stay), b"\n".join(stay).decode()
                texts.append(text)
                n_lines.append(n)
                n_dropped.append(n - kept)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                                             names=["row", "text", "n_lines", "n_dropped"])

    shape = T.StructType([wide.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    # the text travels inside its row
    done = (wide.select("row", "doc", "own").join(dropped, ["doc", "own"], "left")
            .select("row", F.col("row").getField(text_col).cast("string").alias("text"), "drop").mapInArrow(apply, shape))
    return back(done, columns, __text=F.col("text"), __n_lines=F.col("n_lines"), __n_dropped=F.col("n_dropped"))
