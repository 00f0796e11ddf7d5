"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized table (an offset and a step, both
from its name). Shards take turns claiming their next free slot until none is left, so their shares differ by one
slot at most, and a shard that comes or goes leaves most slots as they were. A row is placed by one
look-up of its key's slot in the broadcast table, whose size is the parameter ``slots``.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartwise.llm.common import aside, back, quoted


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n ** 0.5) + 1))


def preference(name: str, slots: int) -> tuple[int, int]:
    """(offset, step): the shard's k-th choice is (offset + k * step) mod slots; every slot is one, as slots is prime."""
    digest = hashlib.blake2b(name.encode(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:], "big") % (slots - 1) + 1


def fill(names: list[str], slots: int) -> np.ndarray:
    """The shard (position in ``names``) of each slot. The turns go by name, so the order of ``names`` is no matter."""
    if not is_prime(slots):
        raise ValueError("the number of slots must be prime")
    if not 0 < len(set(names)) == len(names) <= slots:
        raise ValueError("shards need distinct names, at least one and at most as many as slots")
    table, left = np.full(slots, -1, dtype="i4"), slots
    turns = [(names.index(n), *preference(n, slots)) for n in sorted(names)]
    at = [offset for _, offset, _ in turns]
    while left:
        for k, (shard, _, step) in enumerate(turns):
            slot = at[k]
            while table[slot] >= 0:
                slot = (slot + step) % slots
            table[slot], at[k] = shard, (slot + step) % slots
            left -= 1
            if not left:
                break
    return table


def place(rows: DataFrame, names: list[str], key_col: str, slots: int = 65_537) -> DataFrame:
    """``rows`` with ``__slot`` and ``__shard`` (its name), in place of columns of those names. Equal keys share a shard,
    null keys one as well; an empty table gives an empty one; other columns, whatever their names, pass through."""
    table = fill(names, slots)
    lookup = rows.sparkSession.createDataFrame([(i, names[s]) for i, s in enumerate(table.tolist())], "slot int, shard string")
    placed = aside(rows, slot=F.pmod(F.xxhash64(F.col(quoted(key_col)).cast("string")), F.lit(slots)).cast("int"))
    return back(placed.join(F.broadcast(lookup), "slot"), rows.columns, __slot=F.col("slot"), __shard=F.col("shard"))
