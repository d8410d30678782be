import numpy as np
import pytest
from pyspark import AccumulatorParam, TaskContext

from solvlake.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(made, cosine=0.9):
    """n_links and component of each row, by all pairs."""
    unit = []
    for _, v, *_ in made:
        ok = v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, np.float32).astype(float) if ok else None)
    links = [set() for _ in made]
    for i, a in enumerate(unit):
        for j in range(i):
            b = unit[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= cosine:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, (own, *_) in enumerate(made):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min((made[j][0] for j in seen if made[j][0] is not None), default=None)
        out.append((own, len(links[i]), least, own == least))
    return sorted(out, key=str)


def made(n=300, d=64, seed=3):
    rng = np.random.default_rng(seed)
    vs = list(rng.normal(size=(n, d)))
    centre = rng.normal(size=d)
    vs += [centre + rng.normal(size=d) * s for s in (0.1, 0.2, 0.3, 0.35) for _ in range(30)]  # cosines about the threshold
    step = rng.normal(size=d) * 0.12
    vs += [vs[0] + k * step for k in range(30)]  # a chain
    out = [(int(k), [float(x) for x in np.float32(v)], 0) for k, v in zip(rng.permutation(5000)[: len(vs)], vs)]
    out += [(9000 + k, out[5][1], 1) for k in range(20)] + [out[6], out[6]]  # copies, repeated rows
    out += [(8000, None, 0), (8001, [], 0), (8002, [0.0] * d, 0), (8003, [None] + [1.0] * (d - 1), 0), (8004, [float("nan")] + [1.0] * (d - 1), 0), (8005, [float("inf")] * d, 0)]
    out += [(None, out[7][1], 0), (None, [float(x) for x in np.float32(rng.normal(size=d))], 0), (8010, [2 * x for x in out[5][1]], 0), (8011, [-x for x in out[5][1]], 0)]
    out += [(8020, [1.0, 0.0], 0), (8021, [2.0, -0.0], 0), (8022, [0.5, 0.25], 0), (8023, [3.0], 0), (8024, [1.0], 0), (8025, [-1.0], 0), (8026, [1.0, 0.0, 0.0], 0)]
    return out


def found(spark, rows, **kwargs):
    return sorted(map(tuple, vectors.links(spark.createDataFrame(rows, SCHEMA), **kwargs).collect()), key=str)


def test_against_all_pairs(spark):
    assert found(spark, made()) == brute(made())


def test_crowded_cells_in_parts(spark):
    assert found(spark, made(), part=64 * 40) == brute(made())


@pytest.mark.parametrize("cosine", [0.5, 0.8, 0.99])
def test_other_thresholds(spark, cosine):
    assert found(spark, made(), cosine=cosine) == brute(made(), cosine)


def test_more_grid_axes(spark, monkeypatch):
    monkeypatch.setattr(vectors, "grid_axes", lambda n: 3)
    assert found(spark, made()) == brute(made())


def test_every_near_pair_is_within_one_budget():
    rng = np.random.default_rng(0)
    for d in (2, 3, 16, 17, 40, 64, 384):
        a = rng.normal(size=(400, d))
        b = a + rng.normal(size=(400, d)) * rng.uniform(0.1, 0.6, size=(400, 1))
        ua, ub = vectors.units(a), vectors.units(b)
        near = np.einsum("ij,ij->i", ua, ub) >= 0.9
        ra, rb = (vectors.steps(u, {}) for u in (ua, ub))
        hit = np.zeros(400, bool)
        for axes, budget in zip(vectors.blocks(d), vectors.budgets(d, 0.9), strict=True):
            hit |= ((ra[:, axes] - rb[:, axes]) ** 2).sum(1) <= budget
        assert near.any() and hit[near].all()


def test_extra_columns_representatives_and_empty_tables(spark):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in made()], SCHEMA + ", id string, vec int, `a.b` int")
    got = vectors.representatives(df)
    assert got.columns == df.columns
    want = {r[0] for r in brute(made()) if r[3]}
    assert {r.vec_id for r in got.collect()} == want | {None}
    assert vectors.links(df.limit(0)).count() == 0


def test_what_is_sent_grows_with_parts_only(spark, monkeypatch):
    """Each vector is sent once for each part, and not for each cell of each block."""
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(size=64)], 0) for k in range(400)]
    df = spark.createDataFrame([r[:2] for r in rows], "vec_id long, embedding array<float>")
    sent, compare = spark.sparkContext.accumulator(0), vectors._compare

    def counting(turn, cosine):
        run = compare(turn, cosine)

        def counted(table):
            sent.add(table.num_rows)
            return run(table)

        return counted

    monkeypatch.setattr(vectors, "_compare", counting)
    vectors.links(df, part=6400).collect()  # four parts
    assert sent.value == 4 * 400


class Distinct(AccumulatorParam):
    def zero(self, value):
        return set()

    def addInPlace(self, one, two):
        return one | two


def test_tasks_are_not_merged_for_being_small(spark, monkeypatch):
    """What two parts hold is small and comparing it is not, so their tasks stay apart."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(k, [float(x) for x in rng.normal(size=64)]) for k in range(400)], "vec_id long, embedding array<float>")
    places, compare = spark.sparkContext.accumulator(set(), Distinct()), vectors._compare

    def placing(turn, cosine):
        run = compare(turn, cosine)

        def placed(table):
            places.add({TaskContext.get().partitionId()})
            return run(table)

        return placed

    monkeypatch.setattr(vectors, "_compare", placing)
    vectors.links(df, part=6400).collect()  # four parts, ten tasks
    assert len(places.value) >= 6


def test_dense_groups_and_pairs_about_the_threshold(spark):
    """Tiles of which most pairs are links, repeated rows among them, and cosines that single precision cannot tell from 0.9."""
    rng = np.random.default_rng(8)
    vs = list(np.ones(64) + rng.normal(size=(260, 64)) * 0.3) + list(rng.normal(size=(60, 64)))
    rows = [(k, [float(x) for x in np.float32(v)], 0) for k, v in enumerate(vs)]
    rows += [(1000 + k, rows[k][1], 0) for k in range(0, 260, 5)]
    rows += [(2000, [1.0, 0.0], 0)] + [(2001 + k, [float(np.float32(0.9)), float(np.nextafter(np.float32(0.43588989), np.float32(k), dtype=np.float32))], 0) for k in (0, 1)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, part=64 * 100) == brute(rows)
