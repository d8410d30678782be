"""Bloom filters of 64-bit keys, by which rows are left out before a shuffle.

A filter says "no" only for keys that were not put in, so what passes it still goes through an exact join,
and its size changes how many rows move but never a result. It has 16 bits a key up to a size that the
driver and each worker can hold; beyond that it lets more rows pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvlake.llm.arrow import column
from solvlake.llm.words import mix

BITS_A_KEY, PLACES = 16, 4
#: 16 MB.
MOST_BITS = 1 << 27


@dataclass
class Bloom:
    words: np.ndarray

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """False for keys that are not in, true for those that are and a few others."""
        out = np.ones(len(keys), dtype=bool)
        for at in places(keys, 64 * len(self.words)):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


def places(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for k in range(PLACES):
        yield mix(keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) & np.uint64(bits - 1)


def bloom(keys: DataFrame, name: str) -> Broadcast[Bloom]:
    """A broadcast filter of a bigint column; keys is read twice, so it should be a written table."""
    n = keys.count()
    bits = min(MOST_BITS, max(1 << 10, 1 << (max(1, BITS_A_KEY * n) - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(bits, dtype=bool)
        for batch in batches:
            for at in places(column(batch, name).to_numpy(), bits):
                flags[at.view(np.int64)] = True
        words = np.packbits(flags, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(words[at])], names=["at", "word"])

    found = keys.select(name).mapInArrow(run, "at int, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()  # MOST_BITS / 64 rows at most
    words = np.zeros(bits // 64, dtype=np.uint64)
    words[found["at"].to_numpy()] = found["word"].to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(Bloom(words))


def passing(held: Broadcast[Bloom], name: str) -> Callable[[], Callable[[pa.RecordBatch], np.ndarray]]:
    """For keep_rows: the rows whose key may be in the filter."""
    return lambda: lambda batch: held.value.may_hold(column(batch, name).to_numpy())
