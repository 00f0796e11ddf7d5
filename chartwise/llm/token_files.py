"""Token ids as binary files: canonical length-limited Huffman blocks in ascending document order.

Format (a folder): ``ids``, a Parquet table with a row per block, and the code lengths in ``code``. A block
holds whole documents and decodes on its own: ``file`` and ``block`` order the blocks, ``first_id`` counts the
file's ids before it, ``doc_ids``/``n_tokens`` (little-endian int64/uint32) list its documents, ``bits`` is the
code stream and ``marks`` (uint32) the bit offset of every EVERY-th id, from which a reader may start. Null
document ids come first, flagged in ``null_ids``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartwise.llm.common import discard, doc_columns, scratch
from chartwise.llm.huffman import Code, code_lengths
from chartwise.llm.vocab import UnitIds, id_dtype, load, opened, slices, with_end

#: Ids of a block (unless one document is longer), ids between bit offsets, ids of a file, most bits of a code.
BLOCK, EVERY, FILE, BITS = 65_536, 256, 8_000_000, 16

ROWS = "doc_id long, n_ids long, ids binary, counts binary"

BLOCKS = "file long, block long, first_id long, n_ids long, n_docs long, doc_ids binary, null_ids long, n_tokens binary, bits binary, marks binary"


def encoded(docs: DataFrame, path: str, end_id: int, n_symbols: int) -> DataFrame:
    """doc_id, n_ids, ids (little-endian, two bytes each where the vocabulary allows); the first row of each slice of texts
    also has ``counts``: how often the slice has each id (little-endian uint32)."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit_ids = opened(UnitIds, path)
        for part in slices(batches):
            first, ids = with_end(*unit_ids.encode(part.column("text")), end_id)
            raw, size = ids.tobytes(), ids.itemsize
            counts = [np.bincount(ids, minlength=n_symbols).astype("<u4").tobytes()] + [None] * (part.num_rows - 1)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_ids": pa.array(np.diff(first), pa.int64()),
                                              "ids": pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((first * size).astype("i4")), pa.py_buffer(raw)]),
                                              "counts": pa.array(counts, pa.binary())})

    return docs.mapInArrow(encode, ROWS)


def id_counts(rows: DataFrame, n_symbols: int) -> np.ndarray:
    """Counts of all ids; at most a row for each id of the vocabulary comes to the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_symbols, dtype="i8")
        for batch in batches:
            for counts in batch.column("counts"):
                n += np.frombuffer(counts.as_py(), dtype="<u4")
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"id": pa.array(seen, pa.int64()), "n": pa.array(n[seen], pa.int64())})

    found = rows.select("counts").filter("counts IS NOT NULL").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(n_symbols, dtype="i8")
    counts[found["id"].to_numpy("i8")] = found["n"].to_numpy("i8")
    return counts


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append ``end_id``, and write the files in ascending id order.

    Null texts hold the end id alone; null ids come first; rows that repeat an id stay next to each other, in
    the order of their ids' bytes; an empty table gives a folder without blocks; other columns aren't read.
    """
    spark = docs.sparkSession
    n_symbols, dtype = max(load(tokenizer_path).get_vocab_size(), end_id + 1), id_dtype(tokenizer_path)
    flat = scratch(spark, "token-ids")
    encoded(doc_columns(docs, id_col, text_col), tokenizer_path, end_id, n_symbols).write.option("compression", "zstd").parquet(flat)
    rows = spark.read.schema(ROWS).parquet(flat)
    total = rows.agg(F.sum("n_ids")).first()[0] or 0
    lengths = code_lengths(id_counts(rows, n_symbols), max(BITS, (n_symbols - 1).bit_length()))
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").write.parquet(f"{folder}/code")
    code = spark.sparkContext.broadcast(lengths)
    n_files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // FILE))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, file = Code(code.value), TaskContext.get().partitionId()
        number = first = held = 0
        names, parts = [], []

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), dtype=dtype)
            bits, marks = coder.encode(ids, EVERY)
            row = (file, number, first, len(ids), len(parts), np.array([x or 0 for x in names], "<i8").tobytes(), sum(x is None for x in names),
                   np.array([len(x) // np.dtype(dtype).itemsize for x in parts], "<u4").tobytes(), bits, marks.astype("<u4").tobytes())
            kinds = [pa.int64()] * 5 + [pa.binary(), pa.int64()] + [pa.binary()] * 3
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for name, ids, n in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), batch.column("n_ids").to_pylist(), strict=True):
                if held and held + n > BLOCK:
                    yield closed()
                    number, first, held = number + 1, first + held, 0
                    names, parts = [], []
                names.append(name)
                parts.append(ids.as_py())
                held += n
        if held:
            yield closed()

    # every task of this exchange is a file, in the order of the ids
    (rows.select("doc_id", "n_ids", "ids").repartitionByRange(n_files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
     .mapInArrow(blocks, BLOCKS).write.option("compression", "none").parquet(f"{folder}/ids"))
    discard(spark, flat)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document in the files: doc_id, start, n_tokens, ids_crc32; blocks are decoded independently."""
    table = spark.read.schema(BLOCKS).parquet(f"{folder}/ids")
    sizes = table.groupBy("file").agg(F.sum("n_ids").alias("n")).orderBy("file").collect()  # a number for each file
    before = dict(zip([r["file"] for r in sizes], np.cumsum([0] + [r["n"] for r in sizes]).tolist()[:-1], strict=True))
    shared = spark.sparkContext.broadcast((before, np.frombuffer(spark.read.parquet(f"{folder}/code").first()["lengths"], dtype="u1")))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_start, lengths = shared.value
        coder = Code(lengths)
        for many in batches:
            for at in range(0, many.num_rows, 16):
                batch = many.slice(at, 16).to_pydict()
                marks = [np.frombuffer(m, dtype="<u4") for m in batch["marks"]]
                names, starts, sizes, crcs = [], [], [], []
                for k, ids in enumerate(coder.decode(batch["bits"], marks, batch["n_ids"], EVERY)):
                    n = np.frombuffer(batch["n_tokens"][k], dtype="<u4").astype("i8")
                    ends = np.cumsum(n)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    own = np.frombuffer(batch["doc_ids"][k], dtype="<i8").tolist()
                    names += [None] * batch["null_ids"][k] + own[batch["null_ids"][k]:]
                    starts.append(file_start[batch["file"][k]] + batch["first_id"][k] + ends - n)
                    sizes.append(n)
                    crcs += [zlib.crc32(raw[4 * (e - m):4 * e]) for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(names, pa.int64()), "start": pa.array(np.concatenate(starts), pa.int64()),
                                                  "n_tokens": pa.array(np.concatenate(sizes), pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    return table.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Write the files (to ``folder``, by default in shared scratch) and return what reads back from them."""
    folder = folder or scratch(docs.sparkSession, "token-files")
    write_token_files(docs, folder, tokenizer_path, end_id)
    return read_token_files(docs.sparkSession, folder)
