"""Filters that tell which hashes may belong to a large set, small enough to be sent to every task."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PROBES = 4
_BITS_EACH = 16
_FEWEST_BITS = 1 << 13
MOST_BITS = 1 << 28


def _probes(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits, a power of two of them, that stand for a hash."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return [(hashes + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(_PROBES)]


@dataclass(frozen=True)
class HashFilter:
    """Bits, in words of 32: those of a member are all set, those of another hash rarely."""

    words: np.ndarray

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for bit in _probes(hashes, 32 * len(self.words)):
            out &= (self.words[bit >> np.uint64(5)] >> (bit & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
        return out


def build_filters(members: DataFrame, counts: dict[int, int], most_bits: int = MOST_BITS) -> dict[int, HashFilter]:
    """A filter for each ``kind`` of ``members(kind, hash)``, of which there are ``counts``.

    Sixteen bits a member and ``most_bits`` at most, a power of two; beyond
    that, more of the other hashes pass. The hashes must be well mixed.
    """
    bits = {kind: min(max(_FEWEST_BITS, 1 << (_BITS_EACH * n - 1).bit_length()), most_bits) for kind, n in counts.items() if n}

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for kind in np.unique(kinds).tolist():
                bit = np.concatenate(_probes(hashes[kinds == kind], bits[kind])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bit), kind, np.int32)), pa.array(bit)], ["kind", "bit"])

    probed = members.select(F.col("kind").cast("int"), F.col("hash").cast("long")).mapInArrow(probe, "kind int, bit long")
    words = probed.groupBy("kind", F.expr("bit div 32").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("held")).toArrow()
    kinds, at, held = (words.column(k).to_numpy() for k in range(3))
    out = {}
    for kind, size in bits.items():
        filled = np.zeros(size // 32, np.uint32)
        filled[at[kinds == kind]] = held[kinds == kind].astype(np.uint32)
        out[kind] = HashFilter(filled)
    return out
