import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from solvlake.llm import substrings
from solvlake.llm.fm_index import DEPTH, FMIndex, repeated_windows
from tests.llm.corpus import documents, rows, with_extra

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(made, window):
    texts = [WORD.findall(r[1] or "") for r in made]
    times = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    for r, w in zip(made, texts):
        gone = {j for i in range(len(w) - window + 1) if times[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        yield (r[0] is None, r[0] or 0), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()


@pytest.mark.parametrize(("window", "crowd"), [(35, 2048), (35, 1), (12, 2048)])
def test_against_brute_force(spark, window, crowd):
    made = rows()
    got = substrings.report(documents(spark, made), window=window, crowd=crowd, shard_words=5000).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(brute(made, window))


@pytest.mark.parametrize("seed", range(3))
def test_few_words_in_many_orders(spark, seed):
    rng = random.Random(seed)
    made = [(i, " ".join(rng.choice("ab") * rng.choice([1, 1, 2]) for _ in range(rng.randrange(0, 90))), "en", "s", 1) for i in range(40)]
    got = substrings.report(documents(spark, made), window=8, gram=3, shard_words=300).collect()
    assert sorted(((False, r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(brute(made, 8))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=4, max_size=30), min_size=1, max_size=6))
def test_index_counts_and_windows(parts):
    text = np.array([x for p in parts for x in [0, *p]] + [0])
    index = FMIndex(text)
    joined = text.tolist()
    for pattern in {tuple(joined[i : i + n]) for n in (1, 2, 5) for i in range(len(joined) - n + 1)}:
        if 0 in pattern:
            continue
        low, high = np.array([0]), np.array([index.n])
        for x in reversed(pattern):
            low, high = index.prepend(np.array([x]), low, high)
        assert high[0] - low[0] == sum(tuple(joined[i : i + len(pattern)]) == pattern for i in range(len(joined)))
    starts = np.cumsum([1] + [len(p) + 1 for p in parts[:-1]])
    flags = repeated_windows(index, text, starts, starts + [len(p) for p in parts], 4)
    times = Counter(tuple(p[i : i + 4]) for p in parts for i in range(len(p) - 3))
    for s, p in zip(starts, parts):
        assert flags[s : s + len(p) - 3].tolist() == [times[tuple(p[i : i + 4])] > 1 for i in range(len(p) - 3)]
    assert DEPTH > 35


def test_clean_keeps_columns_and_empty_tables_work(spark):
    made = rows()
    df = with_extra(spark, made)
    got = substrings.clean(df)
    assert got.schema.names == df.schema.names
    want = {r.doc_id: r.kept_sha256 for r in substrings.report(documents(spark, made)).collect() if r.doc_id is not None}
    for r in got.collect():
        if r.doc_id is not None:
            assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id] and r.n_words == "z"
    assert substrings.report(df.limit(0)).count() == 0 and substrings.clean(df.limit(0)).count() == 0
