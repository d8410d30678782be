import random

import numpy as np
import pytest

from solvlake.llm import forest, ngram_join
from solvlake.llm.bloom import bloom
from solvlake.llm.components import connected
from tests.llm.corpus import documents


def packed(labels):
    return [sum(x << (64 - forest.LABEL_BITS * (k + 1)) for k, x in enumerate(labels[h : h + 4])) - (1 << 63) * 2 * (labels[h] >> 15) for h in (0, 4)]


@pytest.mark.parametrize("parts", [1, 5])
def test_links_join_the_members_of_every_node(spark, parts):
    rng = random.Random(5)
    paths = {(t, c): [rng.choice([1, 7, 40000]) for _ in range(forest.DEPTH)] for t in range(3) for c in range(120)}
    rows = [(t, *packed(p), c) for (t, c), p in paths.items()]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    found = forest.plant(spark.createDataFrame(rows, "tree int, hi long, lo long, cls long"), 2).collect()
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    for depth in range(2, forest.DEPTH + 1):
        nodes = {}
        for (t, c), p in paths.items():
            nodes.setdefault((t, *p[:depth]), []).append(c)
        want = [(x[0], y) for x in nodes.values() for y in x[1:]]
        got = [(r.a, r.b) for r in found if r.depth >= depth]
        groups = [{(r.node, r.root) for r in connected(spark.createDataFrame(e, "a long, b long")).collect()} for e in (want, got)] if want else [set(got), set()]
        assert groups[0] == groups[1]


def test_common_prefixes():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.choice([0, 1, 65535]) for _ in range(forest.DEPTH)] for _ in range(2))
        want = next((k for k in range(forest.DEPTH) if a[k] != b[k]), forest.DEPTH)
        (h, l), (h2, l2) = packed(a), packed(b)
        assert forest.common(*(np.array([v], dtype=np.int64) for v in (h, l, h2, l2)))[0] == want


def near(changes, n=40):
    rng = random.Random(4)
    out = []
    for i in range(n):
        w = [f"k{i // 2}x{j}" for j in range(300)]
        for k in range(changes if i % 2 else 0):
            w[20 + 10 * k] = f"z{rng.randrange(10**6)}"
        out.append((i, " ".join(w), "en", "s", 1))
    return out


@pytest.mark.parametrize(("changes", "depth"), [(1, forest.DEPTH), (6, 5)])
def test_prefixes_are_shortened_as_far_as_the_pairs_ask(spark, changes, depth):
    """Pairs of similarity 0.97 are all found by whole paths; pairs of 0.82 ask for shorter ones."""
    found = ngram_join.Join(documents(spark, near(changes)), "doc_id", "text", 5, 0.8, 32, 0.99999, 1024)
    assert found.depth == depth
    assert all(r.n_links == 1 for r in found.result().collect())


def test_without_a_pair_the_shortest_prefix_holds(spark):
    found = ngram_join.Join(documents(spark, near(0)[::2]), "doc_id", "text", 5, 0.8, 32, 0.99999, 1024)
    assert found.depth == found.floor == 5


def test_a_bloom_filter_holds_what_was_put_in(spark):
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 5000)
    held = bloom(spark.createDataFrame([(int(k),) for k in keys], "k long"), "k").value
    assert held.may_hold(keys).all()
    assert held.may_hold(keys + 1).mean() < 0.01
    assert not bloom(spark.createDataFrame([], "k long"), "k").value.may_hold(keys).any()
