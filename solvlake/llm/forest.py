"""An LSH forest over MinHash signatures: for each tree, the signatures in sorted order, which is a prefix
trie laid flat.

A signature has `DEPTH` labels of 16 bits for each tree, packed into two integers so that their order is
the labels' order. All trees' entries are sorted as one table, split into ranges whatever their keys, so
that no trie node has to fit a task. Two neighbours meet at the depth of their longest common prefix; an
entry is linked to the first entry of the node, at that depth, that it shares with the one before it. The
links of depth k and more join the members of every node of depth k, so shortening the matched prefix
from k to k - 1 just adds the links of depth k - 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvlake.llm.arrow import column
from solvlake.llm.shared import written

DEPTH, LABEL_BITS = 8, 16

LINKS = "a long, b long, depth int, part int, tree int, hi long, lo long"


def common(hi: np.ndarray, lo: np.ndarray, hi2: np.ndarray, lo2: np.ndarray) -> np.ndarray:
    """Labels that two paths share from the first on."""
    x, y = (hi ^ hi2).view(np.uint64), (lo ^ lo2).view(np.uint64)
    same = lambda v: sum((v >> np.uint64(64 - LABEL_BITS * k) == 0).astype(np.int32) for k in range(1, DEPTH // 2 + 1))
    return np.where(x == 0, DEPTH // 2 + same(y), same(x))


class Sweep:
    """Goes over the entries of a range in order, batch by batch."""

    def __init__(self, floor: int):
        self.floor, self.last, self.first = floor, None, np.zeros(DEPTH + 1, dtype=np.int64)

    def links(self, tree: np.ndarray, hi: np.ndarray, lo: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first entry's class, class, depth) of the entries that share a node of depth floor or more with the one before."""
        before = [np.concatenate([[x if self.last else 0], v[:-1]]).astype(v.dtype) for x, v in zip(self.last or (0, 0, 0), (tree, hi, lo), strict=True)]
        depth = np.where(before[0] == tree, common(hi, lo, before[1], before[2]), 0)
        if self.last is None:
            depth[0] = 0
        to = np.zeros(len(cls), dtype=np.int64)
        place = np.arange(len(cls))
        for k in range(self.floor, DEPTH + 1):
            lead = np.maximum.accumulate(np.where(depth < k, place, -1))
            first = np.where(lead >= 0, cls[lead], self.first[k])
            at = depth == k
            to[at] = first[at]
            self.first[k] = first[-1]
        self.last = (tree[-1], hi[-1], lo[-1])
        at = np.flatnonzero((depth >= self.floor) & (to != cls))
        return to[at], cls[at], depth[at]


def plant(entries: DataFrame, floor: int) -> DataFrame:
    """a, b, depth: the forest's links of depth floor and more, over entries (tree, hi, lo, cls) that are all different."""
    spark = entries.sparkSession
    keys = ["tree", "hi", "lo", "cls"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sweep, ends = TaskContext.get().partitionId(), Sweep(floor), []
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, hi, lo, cls = (column(batch, k).to_numpy() for k in keys)
            ends = [ends[0] if ends else (tree[0], hi[0], lo[0], cls[0]), (tree[-1], hi[-1], lo[-1], cls[-1])]
            a, b, depth = sweep.links(tree, hi, lo, cls)
            none = pa.nulls(len(a), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(depth, pa.int32()), none, none, pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64())], names=["a", "b", "depth", "part", "tree", "hi", "lo"])
        if ends:
            tree, hi, lo, cls = zip(*ends, strict=True)
            two = len(ends)
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.nulls(two, pa.int64()), pa.nulls(two, pa.int32()), pa.array([part] * two, pa.int32()), pa.array(tree, pa.int32()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], names=["a", "b", "depth", "part", "tree", "hi", "lo"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = entries.select(*keys).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    found = written(ordered.mapInArrow(run, LINKS), "forest-links")
    inner = found.filter("part IS NULL").select("a", "b", "depth")
    return inner.unionByName(spark.createDataFrame(borders(found, floor), "a long, b long, depth int"))


def borders(found: DataFrame, floor: int) -> list[tuple[int, int, int]]:
    """Links over the borders of ranges; two entries of each range reach the driver."""
    by_part: dict[int, list[tuple]] = {}
    for r in found.filter("part IS NOT NULL").collect():
        by_part.setdefault(r.part, []).append((r.tree, r.hi, r.lo, r.a))
    ranges = [(min(x), max(x)) for _, x in sorted(by_part.items())]
    out = []
    for (_, x), (y, _) in zip(ranges[:-1], ranges[1:], strict=True):
        if x[0] == y[0]:
            depth = int(common(*(np.array([v], dtype=np.int64) for v in (x[1], x[2], y[1], y[2])))[0])
            if depth >= floor and x[3] != y[3]:
                out.append((x[3], y[3], depth))
    return out
