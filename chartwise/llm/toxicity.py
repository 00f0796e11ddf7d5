"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text, one on ordinary windows and one on toxic passages: the runs of
GRAM-byte strings that toxic texts have far more often than ordinary ones. Each window of a text is compressed with
both; the bytes that the toxic dictionary saves are its distance, and a text's distances are turned into a score by
thresholds calibrated on labelled texts that no dictionary has seen. When the toxic dictionary is used, its content stands in
front of the ordinary one, so that windows without toxic content are parsed alike and differ by nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartwise.llm.common import aside, back, quoted
from chartwise.llm.vocab import close, slices

#: Bytes of a window, of the ordinary and of the toxic dictionary.
WINDOW, ORDINARY, TOXIC = 64, 110_000, 8192
#: Strings of GRAM bytes are toxic if at least LEAST toxic texts and LEAST_SHARE of them have them, RATIO times as
#: often as ordinary texts; a run of them of over LONGEST bytes is a passage that texts copy, not a word.
GRAM, LEAST, LEAST_SHARE, RATIO, LONGEST = 8, 5, 0.01, 10, 24
#: Labelled texts of each class that are learnt from, at most, in rows and in bytes of whole texts: half for the
#: dictionaries, half for the thresholds.
SAMPLE, SAMPLE_BYTES = 4000, 24_000_000
#: Ordinary windows of that sample, in random order, on which the ordinary dictionary is trained at most.
ORDINARY_WINDOWS = 80_000

_MADE: dict = {}


def windows(text: str | None) -> list[bytes]:
    """The whole lower-cased text in runs of at most WINDOW bytes, cut at blanks where there are some."""
    raw, out, at = (text or "").lower().encode(), [], 0
    while at < len(raw):
        to = at + WINDOW
        if to < len(raw):
            blank = raw.rfind(b" ", at + 1, to)
            to = blank if blank > 0 else to
        out.append(raw[at:to])
        at = to
    return out


def compressor(content: bytes):
    import zstandard
    settings = zstandard.ZstdCompressionParameters(
        window_log=22, chain_log=20, hash_log=20, search_log=5, min_match=5, target_length=32, strategy=zstandard.STRATEGY_LAZY,
        write_checksum=0, write_content_size=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)


def trained(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on the samples; their own text where they are too few to train on."""
    import zstandard
    try:
        return zstandard.train_dictionary(size, samples, k=16, d=6).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def grams(text: str) -> np.ndarray:
    """A number for each string of GRAM bytes of the lower-cased text, by position."""
    raw = np.frombuffer(text.lower().encode(), "u1")
    if len(raw) < GRAM:
        return np.zeros(0, "u8")
    out = np.zeros(len(raw) - GRAM + 1, "u8")
    for j in range(GRAM):
        out = out * np.uint64(257) + raw[j:j + len(out)]
    return out


def held_by(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(strings in order, how many texts have each)."""
    return np.unique(np.concatenate([np.unique(grams(t)) for t in texts] or [np.zeros(0, "u8")]), return_counts=True)


def toxic_grams(toxic: list[str], ordinary: list[str]) -> np.ndarray:
    (found, n), (known, m) = held_by(toxic), held_by(ordinary)
    if not len(known):
        return found
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    ratio = (n / len(toxic)) / ((np.where(known[at] == found, m[at], 0) + 1.0) / len(ordinary))
    return found[(n >= max(LEAST, LEAST_SHARE * len(toxic))) & (ratio >= RATIO)]


def passages(text: str, chosen: np.ndarray) -> list[bytes]:
    """The runs of ``text`` that chosen strings cover."""
    raw, hit = text.lower().encode(), np.isin(grams(text), chosen)
    cover = np.zeros(len(raw) + 2, "i1")
    for j in range(GRAM):
        cover[1 + j:1 + j + len(hit)] |= hit
    edges = np.flatnonzero(np.diff(cover))
    return [raw[a:b] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a <= LONGEST]


def saved(parts: list[bytes], ordinary, toxic) -> np.ndarray:
    """Bytes that the toxic dictionary saves in each window."""
    return np.array([len(ordinary.compress(w)) - len(toxic.compress(w)) for w in parts], dtype="f8")


def features(parts: list[bytes], ordinary, toxic) -> list[float]:
    gain = np.sort(saved(parts, ordinary, toxic))[::-1] if parts else np.zeros(1)
    return [min(gain[0], 24.0), min(gain[:3].mean(), 24.0), gain.mean(), float((gain >= 2).mean()), float(np.log1p((gain >= 3).sum()))]


class Model:
    """Contents of the two dictionaries, and the logistic thresholds over a text's features."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self.mean, self.scale, self.weights = np.zeros(5), np.ones(5), np.zeros(6)

    def compressors(self):
        key = hash((self.ordinary, self.toxic))
        if key not in _MADE:
            _MADE.clear()
            _MADE[key] = compressor(self.ordinary), compressor(self.toxic + self.ordinary)
        return _MADE[key]

    def measure(self, texts: list[str | None]) -> np.ndarray:
        pair = self.compressors()
        return np.array([features(windows(t), *pair) for t in texts]).reshape(-1, 5)

    def calibrate(self, measured: np.ndarray, labels: np.ndarray, rounds: int = 30) -> None:
        """Logistic regression with a unit ridge, by Newton steps."""
        self.mean, self.scale = measured.mean(axis=0), measured.std(axis=0) + 1e-9
        x = np.column_stack([np.ones(len(measured)), (measured - self.mean) / self.scale])
        ridge, w = np.diag([0.0] + [1.0] * 5), np.zeros(6)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-6 * np.eye(6), x.T @ (p - labels) + ridge @ w)
            w = np.clip(w, -30, 30)
        self.weights = w

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = (self.measure(texts) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def fit(toxic: list[str], ordinary: list[str], seed: int = 7) -> Model:
    """A model from labelled texts: every other one for the dictionaries (copies once), the rest for the thresholds."""
    if not toxic or not ordinary:  # nothing to tell apart: every score is the one class's
        model = Model(b"", b"")
        model.weights[0] = 30.0 if toxic else -30.0
        return model
    rng = np.random.default_rng(seed)
    t_fit, o_fit = (list(dict.fromkeys(texts[::2] if len(texts) > 1 else texts)) for texts in (toxic, ordinary))
    windows_of = [w for t in o_fit for w in windows(t)]
    mixed = [windows_of[i] for i in rng.permutation(len(windows_of))[:ORDINARY_WINDOWS]]
    chosen = toxic_grams(t_fit, o_fit)
    found = [p for t in t_fit for p in passages(t, chosen)] or [w for t in t_fit for w in windows(t)]
    model = Model(trained(mixed, ORDINARY), trained([found[i] for i in rng.permutation(len(found))], TOXIC))
    t_rest, o_rest = toxic[1::2] or toxic, ordinary[1::2] or ordinary
    model.calibrate(model.measure(t_rest + o_rest), np.array([1.0] * len(t_rest) + [0.0] * len(o_rest)))
    return model


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most SAMPLE labelled texts of each class and SAMPLE_BYTES of them, in the order of a hash of their ids,
    among those that aren't held out. Labels without a document, null labels and null texts teach nothing."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id"))
    texts_of = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    texts: dict[int, list[str]] = {}
    for y in (1, 0):
        picked = known.filter(F.col("y") == y).select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
        rows = texts_of.join(F.broadcast(picked), "id")
        order = (F.xxhash64("id"), F.col("id"), F.md5("text"))
        sizes = rows.select(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.octet_length("text").alias("n")).orderBy("o0", "o1", "o2").limit(SAMPLE).select("n").collect()
        fits = int((np.cumsum([r["n"] for r in sizes]) <= SAMPLE_BYTES).sum())  # whole texts, as many as the bounds hold
        texts[y] = [r["text"] for r in rows.orderBy(*order).limit(fits).select("text").collect()] if fits else []
    return fit(texts[1], texts[0])


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__score`` (0 to 1) of the whole text, in place of a column of that name; null and empty texts have the
    score of a text without windows. Rows stand for themselves, whatever their ids; an empty table gives an empty one;
    other columns, whatever their names, pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns
    packed = aside(docs, text=F.col(quoted(text_col)).cast("string"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        close()
        for batch in slices(batches):
            own = pa.array(shared.value.score(batch.column("text").to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), own], names=["row", "score"])

    shape = T.StructType([packed.schema["row"], T.StructField("score", T.DoubleType())])
    return back(packed.mapInArrow(each, shape), columns, __score=F.col("score"))
