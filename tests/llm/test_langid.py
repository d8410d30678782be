import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from solvlake.llm import langid
from tests.llm.corpus import rows, with_extra

SYLLABLES = {"aa": "the ing ation er on ed".split(), "bb": "der schü ung keit ein öch".split(), "cc": "ñas ción dor que llo ez".split()}
SCHEMA = "doc_id long, text string, lang string, source string, n long"


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def make(n=150):
    rng = random.Random(9)
    return [(i, text(rng, lang, rng.randrange(8, 40)), lang, "s", 1) for i in range(n) for lang in [rng.choice(list(SYLLABLES))]]


def test_held_out_accuracy(spark):
    made = make()
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(made, SCHEMA)).collect()}
    held = [(i, lang) for i, _, lang, *_ in made if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out for i, _ in held)
    assert np.mean([got[i].lang_pred == lang for i, lang in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_a_mixture_gets_both_languages(spark):
    rng = random.Random(2)
    mixed = [(1000, text(rng, "aa", 60) + " " + text(rng, "bb", 30), None, "s", 1), (1001, text(rng, "cc", 60), None, "s", 1)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(make() + mixed, SCHEMA)).collect()}
    assert got[1000].languages == ["aa", "bb"] and 0.5 < got[1000].score < 0.85 and np.isclose(sum(got[1000].proportions), 1)
    assert got[1001].languages == ["cc"]


def test_expectation_maximisation_raises_the_likelihood():
    rng = np.random.default_rng(1)
    p, n = rng.random((50, 3)) + 0.01, rng.integers(1, 5, 50).astype(float)
    first = np.array([0, 20])
    last = -np.inf
    for rounds in (1, 2, 4, 8, 16):
        share, value = langid.mixtures(p, n, first, np.ones((2, 3)), rounds)
        assert np.allclose(share.sum(axis=1), 1) and value.sum() >= last - 1e-9
        last = value.sum()


def test_odd_rows_and_empty_tables(spark):
    made = make(60) + [(5000, None, "aa", "s", 1), (5001, "", "bb", "s", 1), (5002, "123 ... €", "cc", "s", 1), (5003, "é", None, "s", 1), (None, "the ing", None, None, None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(made, SCHEMA)).collect()}
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (5000, 5001, 5002))
    assert got[5003].lang_pred != "und" and not got[None].held_out
    odd = with_extra(spark, rows())
    assert langid.identify(odd).count() == len(rows()) and langid.identify(odd.limit(0)).count() == 0
    nothing = spark.createDataFrame([(0, "text", None, "s", 1)], SCHEMA)
    assert [r.lang_pred for r in langid.identify(nothing).collect()] == ["und"]


def test_a_mixture_gets_all_four_languages(spark):
    rng = random.Random(3)
    more = {"dd": "zsk wyp krz mluv prst hvo".split()}
    SYLLABLES.update(more)
    try:
        made = [(i, text(rng, lang, rng.randrange(8, 40)), lang, "s", 1) for i in range(200) for lang in [rng.choice(list(SYLLABLES))]]
        mixed = (1000, " ".join(text(rng, lang, n) for lang, n in (("aa", 80), ("bb", 70), ("cc", 60), ("dd", 60))), None, "s", 1)
    finally:
        SYLLABLES.pop("dd")
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame([*made, mixed], SCHEMA)).collect()}
    assert sorted(got[1000].languages) == ["aa", "bb", "cc", "dd"] and got[1000].score < 0.45
    assert np.isclose(sum(got[1000].proportions), 1)


def plain_grams(text):
    """Four-byte stretches of the folded text between two spaces on either side."""
    folded = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()]
    padded = [32, 32, *folded, 32, 32]
    fours = [padded[i : i + 4] for i in range(len(padded) - 3)]
    kept = [f for f in fours if not (f[1] == 32 and (f[0] == 32 or f[2] == 32))]
    return Counter((int.from_bytes(bytes(f), "little") * 2654435761 % 2**32) >> 16 for f in kept)


def plain_predictions(made):
    """The whole method in loops over numbers."""
    counts = defaultdict(Counter)
    for i, said, lang, *_ in made:
        if i is not None and said is not None and lang is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            counts[lang].update(plain_grams(said))
    names = sorted(counts)
    size = {x: sum(counts[x].values()) + langid.SMOOTH * langid.BUCKETS for x in names}
    for i, said, *_ in made:
        if not any(x.isalpha() for x in said or ""):
            yield i, "und", 0.0
            continue
        grams = plain_grams(said)
        p = {g: [(counts[x][g] + langid.SMOOTH) / size[x] for x in names] for g in grams}
        total = sum(grams.values())

        def em(langs):
            share = {k: 1 / len(langs) for k in langs}
            for _ in range(langid.ROUNDS):
                joint = {g: sum(share[k] * p[g][k] for k in langs) for g in grams}
                share = {k: sum(n * share[k] * p[g][k] / joint[g] for g, n in grams.items()) / total for k in langs}
            return share, sum(n * math.log(sum(share[k] * p[g][k] for k in langs)) for g, n in grams.items())

        alone = [sum(n * math.log(p[g][k]) for g, n in grams.items()) for k in range(len(names))]
        first = max(range(len(names)), key=lambda k: (alone[k], -k))
        every, _ = em(range(len(names)))
        # a language alone has its share among all of them for a score
        best, chosen = alone[first] / langid.OVERLAP, {first: every[first]}
        order = sorted(range(len(names)), key=lambda k: (-every[k], k))
        for k in range(2, len(names) + 1):
            share, value = em(sorted(order[:k]))
            value = value / langid.OVERLAP - (k - 1) * langid.PENALTY * math.log(max(total, 2))
            if value > best:
                best, chosen = value, share
        top = max(chosen, key=lambda k: (chosen[k], -k))
        yield i, names[top], chosen[top]


def test_against_brute_force(spark):
    rng = random.Random(6)
    made = [r for r in make(60)] + [(500 + k, text(rng, "aa", 5 * k) + " " + text(rng, "bb", 20) + (" " + text(rng, "cc", 15) if k % 2 else ""), None, "s", 1) for k in range(8)]
    made += [(600, None, "aa", "s", 1), (601, "", "aa", "s", 1), (602, "12 34 !", "bb", "s", 1), (603, "ÉÑ", "cc", "s", 1)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(made, SCHEMA)).collect()}
    for i, lang, score in plain_predictions(made):
        assert got[i][0] == lang and np.isclose(got[i][1], score, atol=1e-6)
