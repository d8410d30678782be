import random
import re
from collections import defaultdict

import numpy as np
import pytest

from solvlake.llm import ngram_join
from solvlake.llm.components import connected
from tests.llm.corpus import documents, rows, with_extra

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def brute(made):
    """n_links of every row, and its group, by row number."""
    sets = [grams(r[1]) for r in made]
    links, group = [0] * len(made), list(range(len(made)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            common = len(a & b)
            if a and b and common >= 0.8 * (len(a) + len(b) - common) - 1e-9:
                links[i] += 1
                links[j] += 1
                x, y = group[i], group[j]
                group = [min(x, y) if g in (x, y) else g for g in group]
    return links, group


def near_group(n=60, seed=8):
    rng = random.Random(seed)
    base = [f"k{i}" for i in range(200)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(200)] = f"z{rng.randrange(10**6)}"
        out.append((1000 + i, " ".join(w), "en", "s", 1))
    return out


@pytest.mark.parametrize("block", [7, 1024])
def test_against_brute_force(spark, block):
    made = [r for r in rows() if r[0] is not None] + near_group()
    links, group = brute(made)
    ids = defaultdict(list)
    for r, g in zip(made, group):
        ids[g].append(r[0])
    want = sorted((r[0], links[k], min(ids[group[k]])) for k, r in enumerate(made))
    got = ngram_join.join(documents(spark, made), block=block).collect()
    assert sorted((r.doc_id, r.n_links, r.class_id) for r in got) == want


def test_prefix_is_shortened_to_the_recall():
    assert ngram_join.prefix_length(0.8, 32, 8, 0.99999) == 5
    assert ngram_join.prefix_length(0.8, 32, 8, 0.5) == 8 and ngram_join.prefix_length(0.8, 4, 8, 0.95) == 2
    with pytest.raises(ValueError):
        ngram_join.prefix_length(0.1, 2, 8, 0.999)


def test_overlaps_and_roots():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 25).astype(np.uint64)) for _ in range(12)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    apart = ~np.eye(12, dtype=bool)  # a set's overlap with itself is never asked for
    assert (ngram_join.overlaps(sets, None)[apart] == want[apart]).all() and (ngram_join.overlaps(sets[:5], sets[5:]) == want[:5, 5:]).all()
    linked = np.zeros((6, 6), dtype=bool)
    for a, b in ((5, 4), (4, 2), (1, 0)):
        linked[a, b] = linked[b, a] = True
    assert ngram_join.roots(linked).tolist() == [0, 0, 2, 3, 2, 2]


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (300, 100), (7, 7)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dedupe_keeps_one_of_each_group(spark):
    made = rows() + near_group(10)
    df = with_extra(spark, made)
    kept = ngram_join.dedupe(df)
    assert kept.schema.names == df.schema.names
    _, group = brute(made)
    worded = [k for k, r in enumerate(made) if grams(r[1])]
    got = kept.collect()
    assert sum(bool(grams(r.text)) for r in got) == len({group[k] for k in worded})
    assert sum(not grams(r.text) for r in got) == len(made) - len(worded)


def test_odd_rows_and_empty_table(spark):
    got = ngram_join.join(with_extra(spark, rows())).collect()
    assert len(got) == len(rows())
    lone = [r for r in got if r.doc_id is None and r.n_links == 0]
    assert len(lone) == 2
    assert ngram_join.join(documents(spark, rows()).limit(0)).count() == 0
