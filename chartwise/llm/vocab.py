"""Encoding with a public tokenizer file, unit by unit, with a worker's cache.

A *unit* is a run of text between two places where the tokenizer's own splitting rule always cuts, so the
ids of a text are those of its units in order. Units repeat, so each is encoded once per worker and the rest
is array work on an Arrow batch. Texts in which the cuts aren't certain are encoded whole.
"""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once, and units kept by a worker. They bound memory and never change a result.
SLICE_BYTES, CACHED_UNITS = 8 << 20, 1_200_000

#: Where a byte-level text isn't certain to be cut at single blanks and line ends: other white space, two in
#: a row, white space at an end, or the beginning of a special string.
UNSURE = (r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
          r"|[ \n][ \n]|^[ \n]|[ \n]$|<\|")

_OPEN: dict = {}


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def opened(kind, path: str):
    """This worker's ``kind`` for the file at ``path``; kept from task to task, one at a time."""
    if (kind, path) not in _OPEN:
        _OPEN.clear()
        _OPEN[kind, path] = kind(path)
    return _OPEN[kind, path]


def close() -> None:
    """Give this worker's tokenizer and cache back; tasks of operators that need neither begin with it."""
    if _OPEN:
        _OPEN.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def id_dtype(path: str) -> str:
    return "<u2" if load(path).get_vocab_size() <= 1 << 16 else "<u4"


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a slice holds about ``size`` bytes of text (or one long text)."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype("i8"))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def byte_letters() -> dict[int, str]:
    """Byte -> the letter that stands for it in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = byte_letters()


MARKS = ".,;:!?"


def plain_word(word: str) -> tuple[str, str] | None:
    """(letters, mark) if the word is Latin-1 letters with at most one closing mark, else None."""
    mark = word[-1:] if word[-1:] in MARKS else ""
    core = word[:-1] if mark else word
    return (core, mark) if core.isalpha() and (core.isascii() or max(core) <= "\xff") else None


class UnitIds:
    """Ids of texts for a byte-level BPE file; units are ' word' and '\\nword'."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.dtype = id_dtype(path)
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.cache: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.marks = {mark: [t.id for t in self.model.tokenize(mark)] for mark in MARKS}

    def unit_ids(self, unit: str) -> list[int]:
        line = unit[0] == "\n"
        word = unit[1:] if line else unit
        if plain := plain_word(word):
            core, mark = plain
            raw = core.encode().decode("latin-1").translate(LETTERS)
            ids = [t.id for t in self.model.tokenize(raw if line else LETTERS[32] + raw)]
            if mark:
                ids += self.marks[mark]
        else:
            ids = self.tokenizer.encode(word if line else " " + word, add_special_tokens=False).ids
        return self.newline + ids if line else ids

    def _of(self, units: list[str]) -> list[bytes]:
        out = []
        if len(self.cache) > CACHED_UNITS // 2:  # units that come again are taken over
            self.older, self.cache = self.cache, {"": b""}
        cache, older = self.cache, self.older
        for unit in units:
            ids = cache.get(unit)
            if ids is None:
                ids = older.get(unit)
                if ids is None:
                    ids = np.array(self.unit_ids(unit), dtype=self.dtype).tobytes()
                cache[unit] = ids
            out.append(ids)
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(first, ids): the ids of text i are ids[first[i]:first[i + 1]]."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        unsure = pc.match_substring_regex(texts, UNSURE).to_numpy(zero_copy_only=False)
        sure = pc.if_else(pa.array(unsure), pa.scalar(""), texts)
        lines = pc.replace_substring(pc.binary_join_element_wise("\n", sure, ""), "\n", " \n")
        units = pc.split_pattern(lines, " ")
        flat = units.flatten().dictionary_encode()
        known = self._of(flat.dictionary.to_pylist())
        size = np.dtype(self.dtype).itemsize
        n_of = np.array([len(x) // size for x in known], dtype="i8")
        first_of = np.concatenate([[0], np.cumsum(n_of)])[:-1]
        pool = np.frombuffer(b"".join(known), dtype=self.dtype)
        codes = flat.indices.to_numpy(zero_copy_only=False)
        n = n_of[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        take = np.repeat(first_of[codes] - ends[:-1], n)
        take += np.arange(len(take))
        ids = pool[take]
        at = ends[units.offsets.to_numpy() - units.offsets[0].as_py()]
        # each text was given a line end in front, whose ids go
        lead = len(self.newline)
        keep = np.ones(len(ids), dtype=bool)
        keep[(at[:-1, None] + np.arange(lead)).ravel()] = False
        ids, first = ids[keep], at - lead * np.arange(len(at))
        if unsure.any():
            parts = [ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
            for i in np.flatnonzero(unsure):
                parts[i] = np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, dtype=self.dtype)
            first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids = np.concatenate(parts)
        return first, ids


def with_end(first: np.ndarray, ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with one more id at the end of each text."""
    return first + np.arange(len(first)), np.insert(ids, first[1:], end)
