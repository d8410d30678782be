import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from solvlake.llm import toxicity
from solvlake.llm.words import ALNUM, NOT_SPACE, Chunk, chunks
from tests.llm.corpus import rows, with_extra

LABELS = "doc_id long, quality int, toxic int, text string"
PLAIN = "the of and reading ingen ther onion atter moral idea class rash them tide store pathos worth".split()
BAD = ["moron", "idiot", "trash"]


def make(n: int = 400, seed: int = 5):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.25)
        words = [rng.choice(PLAIN) + rng.choice(["", "", "s"]) for _ in range(rng.randrange(20, 60))]
        for w in rng.sample(BAD, 2) * toxic:
            words.insert(rng.randrange(len(words)), w)
        docs.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, toxic, "x"))
    return docs, labels


@pytest.fixture(scope="module")
def cost(spark):
    docs, _ = make()
    return toxicity.language_model(toxicity.trigrams(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n long"), "text")).tolist()


@pytest.mark.parametrize(("said", "spaced", "meant"), [("m0r0n", False, "moron"), ("1d10t", False, "idiot"), ("mooorooon", False, "moron"), ("tr4sh", False, "trash"), ("moron", True, "moron"), ("tra$h!", False, "trash")])
def test_decodes(cost, said, spaced, meant):
    assert toxicity.decode(said, cost, spaced) == meant


def test_viterbi_is_the_cheapest_path(cost):
    def paths(steps):
        if not steps:
            yield "", 0.0
            return
        for letters, price in steps[0]:
            for rest, more in paths(steps[1:]):
                yield letters + rest, price + more

    def total(text, price):
        a = b = 0
        for ch in text + " ":
            z = 0 if ch == " " else ord(ch) - 96 if "a" <= ch <= "z" else 27
            price, a, b = price + cost[a][b][z], b, z
        return price

    for said in ("m0r0n", "1d!0t", "aaa5$x", "7r45h"):
        best = min(total(t, p) for t, p in paths(toxicity.lattice(said, False)))
        found = toxicity.decode(said, cost)
        assert np.isclose(min(total(t, p) for t, p in paths(toxicity.lattice(said, False)) if t.strip() == found), best)


def test_finds_hidden_words():
    text = "fine words m0r0n and m o r o n then t.r.a.s.h or id!ot WOOOW end 2024 ok"
    c = next(chunks(pa.array([text]), ALNUM, lower=True))
    found = toxicity.stretches(Chunk(c.lo, c.hi, c.data, c.offsets, NOT_SPACE))
    assert {(s, spaced) for _, s, spaced in found} == {("m0r0n", False), ("moron", True), ("trash", True), ("id!ot", False), ("wooow", False)}


def test_held_out_accuracy_and_disguise(spark):
    docs, labels = make()
    hidden = [(1000, "reading the m0r0n of ingen", "en", "s", 1), (1001, "reading the i d i o t of ingen", "en", "s", 1), (1002, "the traaaash ingen", "en", "s", 1), (1003, "reading the onion of ingen", "en", "s", 1)]
    df = spark.createDataFrame(docs + hidden, "doc_id long, text string, lang string, source string, n long")
    got = {r.doc_id: r for r in toxicity.assess(df, spark.createDataFrame(labels, LABELS)).collect()}
    truth = {i: x for i, _, x, _ in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in truth)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert [got[i].predicted for i in (1000, 1001, 1002, 1003)] == [1, 1, 1, 0]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_odd_rows_and_empty_tables(spark):
    made = rows()
    df = with_extra(spark, made)
    docs, labels = make(200)
    more = labels + [(None, 1, 1, "x"), (5000, 1, 1, "x"), (3, 1, None, "x"), (3, 1, 1, "x")]
    got = toxicity.assess(df, spark.createDataFrame(more, LABELS)).collect()
    assert len(got) == len(made) and not any(r.held_out for r in got if r.doc_id is None)
    none = toxicity.assess(df, spark.createDataFrame([], LABELS)).collect()
    assert len(none) == len(made) and {r.score for r in none} == {0.0}
    assert toxicity.assess(df.limit(0), spark.createDataFrame(more, LABELS)).count() == 0


def test_only_whole_copies_teach_once(spark):
    # they share the window "so it goes" and little else; the copies differ in case and white space
    texts = [f"so it goes {PLAIN[i % 16]} {'moron' if i % 2 else 'store'} {i} {i * i}" for i in range(40)]
    docs = [(i, x, "en", "s", 1) for i, x in enumerate(texts)] + [(100 + i, x.upper().replace(" ", "\n "), "en", "s", 1) for i, x in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n long")
    got = toxicity.wholes(df, ["doc_id"], "text").toPandas().set_index("doc_id").whole
    assert got.nunique() == 40 and all(got[i] == got[100 + i] for i in range(40))
    labels = [(i, 1, i % 2, "x") for i, *_ in docs if zlib.crc32(str(i).encode()) % 4 != 2]
    taught = {i % 100 for i, *_ in labels}
    model = toxicity.fit(df, spark.createDataFrame(labels, LABELS))
    assert model.base == sum(i % 2 for i in taught) / len(taught)
    assert len(model.features)


def test_decodes_long_stretches_whole(cost):
    # a disguised word at each place of a run of spaced letters, of repeated ones and of joined ones
    filler = "reading"
    for before in range(50, 70):
        text = " ".join((filler * 10)[:before] + "moron" + filler * 10)
        c = next(chunks(pa.array([text, "m" + "o" * 90 + "ron", ".".join(filler * 12 + "moron")]), ALNUM, lower=True))
        found = toxicity.stretches(Chunk(c.lo, c.hi, c.data, c.offsets, NOT_SPACE))
        assert [(i, s) for i, s, spaced in found if spaced] == [(0, text.replace(" ", "")), (2, filler * 12 + "moron")]
        assert all("moron" in toxicity.decode(s, cost, True) for _, s, spaced in found if spaced)
        assert [toxicity.decode(s, cost) for i, s, spaced in found if i == 1] == ["moron"]
    # decoding takes time in proportion: a run as long as a text goes in one piece
    said = "moron" * 10000
    assert toxicity.decode(said, cost, True).replace(" ", "") == said


def test_a_long_reading_is_the_cheapest_path(cost):
    def copied(stretch, spaced):
        states = {(0, 0): (0.0, "")}
        for choices in [*toxicity.lattice(stretch, spaced), [(" ", 0.0)]]:
            after = {}
            for (a, b), (so_far, text) in states.items():
                for letters, price in choices:
                    x, y, total = a, b, so_far + price
                    for ch in letters:
                        z = 0 if ch == " " else ord(ch) - 96 if "a" <= ch <= "z" else 27
                        total, x, y = total + cost[x][y][z], y, z
                    if (x, y) not in after or total < after[x, y][0]:
                        after[x, y] = (total, text + letters)
            states = after
        return min(states.values())[1].strip()

    for said, spaced in (("m0r0n1d!0ttr45h" * 9, True), ("0" * 70 + "m0ron" * 20, False), ("", False), ("$a$", True)):
        assert toxicity.decode(said, cost, spaced) == copied(said, spaced)


def plain_scores(docs, labels):
    """Features, their ratios and chances, credits and scores in loops over strings; for texts without disguise."""
    def features(text):
        out = []
        for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower()):
            b = w.encode()
            out.append([("word", b)] + [("beginning", b[:k]) for k in toxicity.BEGINNINGS if len(b) > k])
        return out

    texts, one = {i: t for i, t, *_ in docs}, {}
    for i, _, toxic, _ in labels:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            key = (tuple(texts[i].lower().split()), toxic)
            one[key] = min(i, one.get(key, i))
    taught = [(i, toxic) for (_, toxic), i in one.items()]
    n, bad = len(taught), sum(y for _, y in taught)
    has = {i: {f for w in features(texts[i]) for f in w} for i, _ in taught}
    a, b = Counter(f for i, y in taught if y for f in has[i]), Counter(f for i, _ in taught for f in has[i])
    tried = sum(v > 1 for v in b.values())
    part = lambda x, e: x * math.log(x / e) if x > 0 else 0.0
    model = {}
    for f, k in b.items():
        g2 = 2 * (part(a[f], k * bad / n) + part(k - a[f], k * (n - bad) / n) + part(bad - a[f], (n - k) * bad / n) + part(n - bad - k + a[f], (n - k) * (n - bad) / n))
        chance = (a[f] + toxicity.PRIOR_TEXTS * bad / n) / (k + toxicity.PRIOR_TEXTS)
        if k > 1 and chance >= toxicity.LEAST_CHANCE and g2 >= 2 * math.log(tried) - toxicity.SLACK:
            model[f] = (chance, g2)
    credit = Counter()
    for i, y in taught:
        own = has[i] & set(model)
        if y and own:
            most = max(model[f][1] for f in own)
            credit.update(f for f in own if model[f][1] >= toxicity.CREDITED * most)
    model = {f: c for f, (c, _) in model.items() if credit[f] >= toxicity.LEAST_CREDIT}
    for i, text, *_ in docs:
        left = {}
        for w in features(text):
            best = max((model.get(f, 0.0) for f in w), default=0.0)
            if best > bad / n:
                left[w[0]] = 1 - min(best, 1 - 1e-9)
        yield i, 1 - math.prod(left.values()) if model else bad / n


def test_scores_against_brute_force(spark):
    docs, labels = make(300)
    plain = [(i, re.sub(r"[^a-z ]", "", re.sub(r"(.)\1\1+", r"\1", t.lower())), *rest) for i, t, *rest in docs]
    plain = [(i, " ".join(w for w in t.split() if len(w) > 1), *rest) for i, t, *rest in plain]
    df = spark.createDataFrame(plain, "doc_id long, text string, lang string, source string, n long")
    got = {r.doc_id: r.score for r in toxicity.assess(df, spark.createDataFrame(labels, LABELS)).collect()}
    want = dict(plain_scores(plain, labels))
    assert len({round(x, 6) for x in want.values()}) > 2
    for i, score in want.items():
        assert abs(got[i] - score) < 1e-9


def test_a_bound_on_labelled_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(4000)], "_id long, _toxic int")
    assert toxicity.bounded(labels, "_id", 4000).count() == 4000
    some = toxicity.bounded(labels, "_id", 1000)
    assert 850 < some.count() < 1150 and sorted(some.collect()) == sorted(toxicity.bounded(labels.repartition(7), "_id", 1000).collect())
