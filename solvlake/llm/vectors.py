"""Near-duplicate vectors by an exact join of all pairs, in tiles that pruning leaves, verified in double precision.

Dot products of unit vectors are computed in single precision, a tile at a time. Those above the threshold by more than
single precision can err are links, those as far below are none, and the few between are decided by their cosine in
double precision, as if all had been.

Classes of equal vectors, with a weight, are dealt to parts by hash, and each two parts of vectors of one length are a
task, so a vector is sent once for each part, a pair meets in one task, and no list of pairs is made. A task gives each
vector's number of links and a spanning forest of the links that it has seen. It takes its rows in the order of a grid
over the leading ones of the principal axes of a sample, and leaves out tiles whose boxes are apart by more than the
distance. Rotated coordinates are rounded to integers that single precision adds and multiplies exactly, and the distance
allows for the rounding. Parts are of a bounded size, and their tasks are not merged: what is sent grows as vectors times
parts, comparisons as pairs, as in every exact join of vectors without structure.

Rows and values, case by case:
- a vector that is null, empty, zero, or holds null or non-finite components: no links, kept.
- vectors of different lengths are never linked. Null id: takes part; it names its component only if no
  vector of the component has an id. Repeated rows: links of each other.
- ties: the least id names a component; every row with that id in it is kept. Empty table: no rows.
- further columns: ignored by links(), carried along unchanged by representatives().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvlake.llm.arrow import column, small_batches
from solvlake.llm.components import connected
from solvlake.llm.shared import cut, written

COSINE = 0.9
#: Axes of a block.
AXES = 16
#: Coordinates of unit vectors are rounded to this many steps of 1: squared distances then stay below 2**24
#: and are exact in single precision, up to 9,000 dimensions.
SCALE = 2000.0
#: Vectors that the axes are fitted on, at most: those with the least digests. Results do not depend on them.
SAMPLE = 4096
#: Numbers (vectors times their length) of a part, parts that keep a cluster busy, rows of a tile of the
#: comparison, and vectors of a part at least.
PART = 1 << 22
LEAST_PARTS = 4
TILE = 1024
LEAST_PART = 2048
#: Partitions that the tasks are dealt to, at most: several for each task, so that few meet in one.
MOST_PARTITIONS = 4096
#: Leading axes of the grid that orders the rows of a task, at most.
MOST_GRID_AXES = 4

Rotation = dict[int, np.ndarray]


def _raw(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, offsets, and which of the vectors are whole: finite, no null, not zero."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    offsets = vectors.offsets.to_numpy()
    values = vectors.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] + 0.0  # null is NaN; -0.0 is 0.0
    offsets = offsets - offsets[0]
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    some = np.concatenate([[0], np.cumsum(values != 0)])
    whole = (bad[offsets[1:]] == bad[offsets[:-1]]) & (some[offsets[1:]] > some[offsets[:-1]]) & vectors.is_valid().to_numpy(zero_copy_only=False)
    return values, offsets, whole


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows in double precision, of length 1."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def blocks(d: int) -> list[np.ndarray]:
    """The axes of each block, for joins on subspaces (links() needs none): dealt to and fro, so that each leads with axes of large variance."""
    n = max(1, round(d / AXES))
    turn = np.arange(d) % (2 * n)
    owner = np.where(turn < n, turn, 2 * n - 1 - turn)
    return [np.flatnonzero(owner == b) for b in range(n)]


def budgets(d: int, cosine: float) -> list[float]:
    """Squared distance in steps that each block allows, rounding included."""
    return [(np.sqrt((2 - 2 * cosine) * len(axes) / d) * SCALE + np.sqrt(len(axes))) ** 2 for axes in blocks(d)]


def rotation(sample: list[np.ndarray]) -> Rotation:
    """For each length in the sample the principal axes, by falling variance."""
    by_length: dict[int, list[np.ndarray]] = {}
    for v in sample:
        by_length.setdefault(len(v), []).append(v)
    out = {}
    for d, rows in by_length.items():
        u = units(np.array(rows))
        out[d] = np.ascontiguousarray(np.linalg.eigh(u.T @ u)[1][:, ::-1])
    return out


def steps(unit: np.ndarray, turn: Rotation) -> np.ndarray:
    """Rotated coordinates as whole numbers. A length that the sample lacks is not rotated."""
    d = unit.shape[1]
    return np.rint((unit @ turn[d] if d in turn else unit) * SCALE)


def grid_axes(n: int) -> int:
    """Leading axes of the grid that orders n vectors: more as there are more, about five cells an axis."""
    return int(np.clip(np.ceil(np.log(max(n, 2) / 4096) / np.log(5)), 1, MOST_GRID_AXES))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, offsets, whole = _raw(column(batch, "vec"))
        keys = [blake2b(values[a:b].tobytes(), digest_size=16).digest() if ok else None for a, b, ok in zip(offsets[:-1], offsets[1:], whole, strict=True)]
        yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(keys, pa.binary()), column(batch, "vec")], names=["id", "key", "vec"])


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """parent (roots of a forest, compressed) with a[i] and b[i] joined."""
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def _compare(turn: Rotation, cosine: float) -> Callable[[pa.Table], pa.Table]:
    """For the rows of a part, or of two: links counted, and a forest of them."""

    def run(table: pa.Table) -> pa.Table:
        of = lambda c: pa.concat_arrays(table[c].chunks)
        d, low = (of(c)[0].as_py() for c in ("dim", "low"))
        unit = units(_raw(of("vec"))[0].reshape(-1, d))
        single = unit.astype(np.float32)
        whole = steps(unit, turn).astype(np.float32)
        farthest = (np.sqrt(2 - 2 * cosine) * SCALE + np.sqrt(d)) ** 2
        order = np.lexsort(np.floor(whole[:, : grid_axes(len(unit))] / np.ceil(np.sqrt(farthest))).T[::-1])
        side = of("part").to_numpy() == low
        weight = of("size").to_numpy()
        slack = (d + 8) * 2.0**-24  # more than single precision errs by in a product of two unit vectors
        links, parent = np.zeros(len(unit), np.int64), np.arange(len(unit))
        dots, near = np.empty(TILE * TILE, np.float32), np.empty(TILE * TILE, bool)
        seen: list[tuple[np.ndarray, np.ndarray]] = []

        def settle(least: int) -> None:
            """Counts and joins the pairs seen, if they are as many."""
            nonlocal parent
            if sum(len(a) for a, _ in seen) >= least:
                a, b = (np.concatenate(c) for c in zip(*seen, strict=True))
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
                parent = _union(parent, a, b)
                seen.clear()

        def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """The decision in double precision."""
            return np.concatenate([np.einsum("ij,ij->i", unit[a[k : k + 65536]], unit[b[k : k + 65536]]) for k in range(0, max(len(a), 1), 65536)]) >= cosine

        def tile(i: np.ndarray, j: np.ndarray, dot: np.ndarray, hit: np.ndarray) -> None:
            """Pairs of two tiles whose dot product is not below the cosine by more than the slack."""
            nonlocal parent
            found = np.flatnonzero(hit)
            a, b = np.divmod(found, len(j))
            doubt = np.flatnonzero(dot.ravel()[found] < cosine + slack)
            no = doubt[~linked(i[a[doubt]], j[b[doubt]])]
            if len(found) < hit.size // 64:
                a, b = np.delete(a, no), np.delete(b, no)
                seen.append((i[a], j[b]))
                settle(1 << 16)
                return
            hit.ravel()[found[no]] = False  # crowded: no list of its links is made
            ones = hit.astype(float)
            links[i] += (ones @ weight[j].astype(float)).astype(np.int64)
            links[j] += (weight[i].astype(float) @ ones).astype(np.int64)
            for first in (True, False):  # a link of each row and column joins nearly all
                hit &= parent[i][:, None] != parent[j][None, :]
                if not hit.any():
                    return
                if first:
                    rows, columns = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
                    a, b = np.concatenate([rows, hit.argmax(0)[columns]]), np.concatenate([hit.argmax(1)[rows], columns])
                else:
                    a, b = np.nonzero(hit)
                parent = _union(parent, i[a], j[b])

        def meet(left: np.ndarray, right: np.ndarray, within: bool) -> None:
            """Compares two sets of rows; within: they are one set."""
            box = lambda rows: (whole[rows].min(0).astype(float), whole[rows].max(0).astype(float))
            boxes = {y: box(right[y : y + TILE]) for y in range(0, len(right), TILE)}
            beside = single[right]
            for x in range(0, len(left), TILE):
                i = left[x : x + TILE]
                least, most = box(i)
                for y in range(x if within else 0, len(right), TILE):
                    j = right[y : y + TILE]
                    if (np.maximum(0, np.maximum(boxes[y][0] - most, least - boxes[y][1])) ** 2).sum() > farthest:
                        continue
                    dot, hit = (buffer[: len(i) * len(j)].reshape(len(i), len(j)) for buffer in (dots, near))
                    np.matmul(single[i], beside[y : y + TILE].T, out=dot)
                    np.greater_equal(dot, cosine - slack, out=hit)
                    if within and x == y:
                        hit &= ~np.tri(len(i), dtype=bool)
                    if hit.any():
                        tile(i, j, dot, hit)

        if side.all():
            meet(order, order, True)
        else:
            meet(order[side[order]], order[~side[order]], False)
        settle(1)
        some = np.flatnonzero(links)
        cls = of("cls").to_numpy()
        return pa.table({"cls": cls[some], "n": links[some], "up": cls[parent[some]]})

    return run


def _sample(classes: DataFrame) -> list[np.ndarray]:
    return [np.array(r.vec, float) for r in classes.orderBy("key").limit(SAMPLE).select("vec").collect()]  # SAMPLE rows at most


def links(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, part: int = PART) -> DataFrame:
    """One row for each row: id, n_links, component_id, kept."""
    small_batches(rows)
    slim = rows.select(rows[f"`{id_col}`"].alias("id"), rows[f"`{vector_col}`"].alias("vec"))
    if slim.schema["vec"].dataType.simpleString() != "array<float>":  # that is half as much to send
        slim = slim.withColumn("vec", F.col("vec").cast("array<double>"))
    kind = slim.schema["id"].dataType.simpleString()
    keyed = slim.mapInArrow(_keyed, f"id {kind}, key binary, vec {slim.schema['vec'].dataType.simpleString()}")
    classes = keyed.filter("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("one"), F.count("*").alias("size"), F.first("vec").alias("vec"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    turn = rotation(_sample(classes))
    sized = classes.select("cls", "size", "vec", F.size("vec").alias("dim"))
    parts = F.greatest(F.ceil(F.col("all") * F.col("dim") / part), F.least(F.lit(LEAST_PARTS), F.ceil(F.col("all") / LEAST_PART))).cast("long")
    lengths = cut(sized.groupBy("dim").agg(F.count("*").alias("all")).select("dim", parts.alias("parts")))
    dealt = sized.join(lengths, "dim").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = dealt.select("cls", "size", "vec", "dim", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    tasks = lengths.agg(F.sum(F.col("parts") * (F.col("parts") + 1) / 2)).first()[0] or 0
    spread = met.repartition(int(min(MOST_PARTITIONS, 8 * tasks + 1)), "dim", "low", "high")  # a number given is not merged for being small
    counted = cut(spread.groupBy("dim", "low", "high").applyInArrow(_compare(turn, cosine), "cls long, n long, up long"))
    totals = counted.groupBy("cls").agg(F.sum("n").alias("n"))
    roots = connected(counted.select(F.col("cls").alias("a"), F.col("up").alias("b"))).withColumnRenamed("node", "cls")
    told = classes.select("key", "cls", "one", "size").join(totals, "cls", "left").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = cut(told.groupBy("root").agg(F.min("one").alias("component")))
    named = told.join(least, "root").select("key", F.col("component"), (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n"))
    some = keyed.select("id", "key").filter("key IS NOT NULL").join(named, "key").select("id", F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    none = keyed.filter("key IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = some.unionByName(none)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def representatives(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """The rows that name their component, with all their columns. Rows with one id stay or go together; rows
    without an id stay."""
    lost = cut(links(rows, id_col, vector_col, cosine).filter("NOT kept").select(F.col(id_col).alias("_lost")).distinct())
    return rows.join(lost, rows[f"`{id_col}`"] == lost["_lost"], "left_anti")


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
good AS (SELECT r, vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS x, b.r AS y FROM good a JOIN good b ON a.r <> b.r AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
told AS (SELECT x AS r, min(vec_id) AS least FROM reach JOIN v ON v.r = reach.y GROUP BY x),
counts AS (SELECT x AS r, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(least(least, vec_id), vec_id) AS component_id, coalesce(least(least, vec_id), vec_id) IS NOT DISTINCT FROM vec_id AS kept
FROM v LEFT JOIN told USING (r) LEFT JOIN counts USING (r)
"""
