"""Canonical length-limited Huffman codes over token ids, with array coding and table-driven decoding."""

from __future__ import annotations

import numpy as np


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 where a count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype="u1")
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype("i8")
    row, is_symbol = weights, []
    for _ in range(limit):
        is_symbol.append(np.ones(len(row), dtype=bool) if not is_symbol else merged_symbol)
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        by = np.argsort(both, kind="stable")
        row, merged_symbol = both[by], by < len(weights)
    take, found = 2 * len(used) - 2, np.zeros(len(used), dtype="i8")
    for symbol in reversed(is_symbol):
        own = int(symbol[:take].sum())
        found[:own] += 1
        take = 2 * (take - own)
    lengths[order] = found
    return lengths


class Code:
    """Codes are numbered by (length, id), so the lengths alone define them."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = np.asarray(lengths, dtype="u1")
        self.bits = max(1, int(self.lengths.max(initial=0)))
        used = np.flatnonzero(self.lengths)
        order = used[np.argsort(self.lengths[used], kind="stable")]
        size = self.lengths[order].astype("i8")
        # a code of n bits holds 2 ** (bits - n) places of the table of all windows of `bits` bits
        span = np.left_shift(1, self.bits - size)
        place = np.concatenate([[0], np.cumsum(span)])[:-1]
        self.codes = np.zeros(len(self.lengths), dtype="u4")
        self.codes[order] = place >> (self.bits - size)
        self.symbol = np.zeros(1 << self.bits, dtype="u4")
        self.length = np.ones(1 << self.bits, dtype="u1")
        self.symbol[: span.sum()] = np.repeat(order, span)
        self.length[: span.sum()] = np.repeat(size, span)

    def encode(self, ids: np.ndarray, every: int) -> tuple[bytes, np.ndarray]:
        """(bits, bit offset of each ``every``-th id)."""
        size = self.lengths[ids].astype("i8")
        if not len(ids):
            return b"", np.zeros(0, "u4")
        if not size.all():
            raise ValueError("an id has no code")
        ends = np.cumsum(size)
        starts = ends - size
        total = int(ends[-1])
        # a code lies in at most two neighbouring 32-bit words; the parts in a word don't overlap, so sums join them
        word, shift = starts >> 5, 64 - (starts & 31) - size
        wide = np.left_shift(self.codes[ids].astype("u8"), shift.astype("u8"))
        n_words = (total + 31) // 32 + 1
        out = np.bincount(word, weights=(wide >> np.uint64(32)).astype("f8"), minlength=n_words)[:n_words]
        out += np.concatenate([[0.0], np.bincount(word, weights=(wide & np.uint64(0xFFFFFFFF)).astype("f8"), minlength=n_words)[: n_words - 1]])
        return out.astype("u8").astype(">u4").tobytes()[: (total + 7) // 8], starts[::every].astype("u4")

    def decode(self, payloads: list[bytes], marks: list[np.ndarray], n_ids: list[int], every: int) -> list[np.ndarray]:
        """Ids of independent blocks; all stretches between bit offsets are decoded side by side."""
        size = [len(p) for p in payloads]
        pool = np.frombuffer(b"".join(payloads) + bytes(8), dtype="u1")
        base = np.concatenate([[0], np.cumsum(size)])[:-1] * 8
        at = np.concatenate([b + m.astype("i8") for b, m in zip(base, marks, strict=True)] or [np.zeros(0, "i8")])
        left = np.concatenate([np.minimum(every, n - np.arange(0, n, every)) for n in n_ids] or [np.zeros(0, "i8")])
        out = np.zeros((len(at), every), dtype="u4")
        # longest stretches first, so that those still open are a prefix
        order = np.argsort(-left, kind="stable")
        at, left = at[order], left[order]
        for k in range(int(left.max(initial=0))):
            n_open = int(np.searchsorted(-left, -k, side="left"))
            pos = at[:n_open]
            byte = pos >> 3
            window = (pool[byte].astype("u4") << 24) | (pool[byte + 1].astype("u4") << 16) | (pool[byte + 2].astype("u4") << 8) | pool[byte + 3]
            key = (window << (pos & 7).astype("u4")) >> np.uint32(32 - self.bits)
            out[order[:n_open], k] = self.symbol[key]
            pos += self.length[key]
        found, row = [], 0
        for n in n_ids:
            rows = -(-n // every)
            found.append(out[row:row + rows].ravel()[:n])
            row += rows
        return found
