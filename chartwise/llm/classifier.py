"""Text classification by supervised subword embeddings.

Every word has hashed vectors of its own, of its character n-grams and of a mark for a word said again at once; a
document is the average of all of them, and a softmax over a linear layer gives the class. Vectors and layer are
trained together by stochastic gradient descent in numpy, document by document, with a falling step. The average
and the layer are linear, so for scoring each hashed vector is folded to its difference of the two classes' logits:
what is broadcast is one number for each of BUCKETS, and words are hashed and summed an array at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartwise.llm.toxicity import held_out
from chartwise.llm.vocab import close, slices

#: Hashed vectors, numbers in each, lengths of character n-grams; times over the sample and the first step.
BUCKETS, DIM, GRAMS, EPOCHS, STEP = 1 << 18, 8, (2, 3), 6, 4.0
#: Labelled texts learnt from, at most: as many rows and as many bytes of whole texts.
SAMPLE_ROWS, SAMPLE_BYTES = 4_000, 16_000_000
#: Bytes of text handled at once; the bound never changes a result.
BYTES = 2 << 20

#: Features of every text, and of a word that repeats the one before it.
TEXT, AGAIN = 0, 1

BLANKS = np.array([32 if b in (32, *range(9, 14)) else b for b in range(256)], dtype="u1")


#: Multipliers of the hash.
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def word_features(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of every feature: each ' word ' and all its character n-grams, hashed together for all words.

    A hash is a polynomial in the code points; long words have all of theirs."""
    points = np.frombuffer("".join([f" {w} " for w in names]).encode("utf-32-le"), "<u4").astype("u8")
    size = np.fromiter(map(len, names), "i8", len(names)) + 2
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(names)), size)
    place = np.arange(len(points)) - start[owner]
    powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(int(size.max(initial=1)), *GRAMS), FACTOR))])
    word, found = [np.arange(len(names))], [np.add.reduceat(points * powers[place], start) * powers[1] if len(names) else np.zeros(0, "u8")]
    for n in GRAMS:
        at = np.flatnonzero((size[owner] - place >= n) & (size[owner] > n))
        word.append(owner[at])
        found.append(sum(points[at + k] * powers[k] for k in range(n)) + np.uint64(n))
    mixed = np.concatenate(found)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * MIX
    mixed ^= mixed >> np.uint64(32)
    return np.concatenate(word), (2 + mixed % np.uint64(BUCKETS - 2)).astype("i8")


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(dictionary, code of each word, document of each word, whether it repeats the word before it)."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, dtype="i4")[texts.offset: texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype="u1")[ends[0]: ends[-1]] if data is not None else np.zeros(0, "u1")
    units = pc.split_pattern(pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer((ends - ends[0]).astype("i4")), pa.py_buffer(BLANKS[raw].tobytes())]), " ")
    flat = units.flatten().dictionary_encode()
    code, doc = flat.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(units)), np.diff(units.offsets.to_numpy()))
    full = code != pc.index(flat.dictionary, "").as_py()
    code, doc = code[full], doc[full]
    again = np.r_[False, (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])] if len(code) else np.zeros(0, bool)
    return flat.dictionary, code, doc, again


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares, which add up to 1."""
    names, code, _, again = words(pa.array([text]))
    often = np.bincount(code, minlength=len(names))
    word, bucket = word_features(names.to_pylist())
    buckets, place = np.unique(np.concatenate([[TEXT, AGAIN], bucket]), return_inverse=True)
    shares = np.bincount(place, weights=np.concatenate([[1, again.sum()], often[word]]))
    return buckets[shares > 0], shares[shares > 0] / shares.sum()


class Model:
    """Vectors of the buckets and the layer of the two classes."""

    def __init__(self, seed: int = 7):
        self.vectors = np.random.default_rng(seed).uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
        self.layer, self.bias = np.zeros((DIM, 2)), np.zeros(2)

    def train(self, texts: list[str], labels: list[int], seed: int = 7) -> None:
        """EPOCHS times over the texts in random order; the step falls to 0."""
        rows = [features(t) for t in texts]
        rng, total, done = np.random.default_rng(seed), EPOCHS * len(rows), 0
        for _ in range(EPOCHS):
            for i in rng.permutation(len(rows)):
                step = STEP * (1 - done / total)
                buckets, shares = rows[i]
                own = self.vectors[buckets]
                mean = shares @ own
                error = softmax(mean @ self.layer + self.bias)
                error[labels[i]] -= 1
                back = self.layer @ error
                self.layer -= 0.1 * step * np.outer(mean, error)
                self.bias -= 0.01 * step * error
                # a bucket's part of the gradient, scaled as if all had the mean share
                self.vectors[buckets] = own - step * np.outer(shares, back)
                done += 1

    def folded(self) -> np.ndarray:
        """Each bucket's difference of logits, class 1 less class 0."""
        return self.vectors @ (self.layer[:, 1] - self.layer[:, 0])

    def score(self, text: str) -> float:
        """Probability of class 1, from the vectors themselves."""
        buckets, shares = features(text)
        return float(softmax(shares @ self.vectors[buckets] @ self.layer + self.bias)[1])


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max())
    return e / e.sum()


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[list[str], list[int]]:
    """Whole labelled texts in the order of a hash of their ids, as long as SAMPLE_ROWS and SAMPLE_BYTES hold."""
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
             .filter(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id")).distinct())
    picked = known.orderBy(F.xxhash64("id"), "id", "y").limit(SAMPLE_ROWS)  # bounded by the parameter, as what follows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    order = (F.xxhash64("id"), F.col("id"), F.col("y"), F.md5("text"))
    sizes = texts.join(F.broadcast(picked), "id").select("id", "y", F.md5("text").alias("m"), F.octet_length("text").alias("n"), *[c.alias(f"o{i}") for i, c in enumerate(order)])
    rows = sizes.orderBy("o0", "o1", "o2", "o3").limit(SAMPLE_ROWS).select("id", "y", "m", "n").collect()
    fits = np.cumsum([r["n"] for r in rows]) <= SAMPLE_BYTES
    ids = [(r["id"], r["y"]) for r, ok in zip(rows, fits, strict=True) if ok]
    if not ids:
        return [], []
    chosen = docs.sparkSession.createDataFrame(sorted(set(ids)), picked.schema)
    found = texts.join(F.broadcast(chosen), "id").orderBy(*order).limit(len(ids)).select("text", "y").collect()
    return [r["text"] for r in found], [r["y"] for r in found]


def learn(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled texts that aren't held out, at most SAMPLE_ROWS with SAMPLE_BYTES in all. Null labels, labels
    without a document and null texts teach nothing; with labels of one class only, or none, scores follow them."""
    texts, labels_of = sample(docs, labels, id_col, text_col, label_col)
    model = Model()
    if len(set(labels_of)) == 2:
        model.train(texts, labels_of)
    elif labels_of:
        model.bias[labels_of[0]] = 30.0
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", out: str = "score") -> DataFrame:
    """Per row the id and the probability of class 1 of its whole text (null as empty: the mark of every text alone).

    Rows stand for themselves, whatever their ids; null ids stay null; an empty table gives an empty one; other
    columns aren't read. A score depends on its text alone, not on the batch around it.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.folded(), float(model.bias[1] - model.bias[0])))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        close()
        weight, bias = shared.value
        for part in slices(batches, size=BYTES):
            names, code, doc, again = words(part.column("text"))
            word, bucket = word_features(names.to_pylist())
            sums, sizes = np.bincount(word, weights=weight[bucket], minlength=len(names)), np.bincount(word, minlength=len(names))
            n = part.num_rows
            total = weight[TEXT] + np.bincount(doc, weights=sums[code], minlength=n) + weight[AGAIN] * np.bincount(doc[again], minlength=n)
            count = 1 + np.bincount(doc, weights=sizes[code], minlength=n) + np.bincount(doc[again], minlength=n)
            logit = np.clip(total / count + bias, -700, 700)
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(1 / (1 + np.exp(-logit)))], names=[id_col, out])

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(each, T.StructType([rows.schema[id_col], T.StructField(out, T.DoubleType())]))
