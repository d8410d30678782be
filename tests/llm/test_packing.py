import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import Row

from solvlake.llm import packing, tokens
from tests.llm.corpus import documents, rows, with_extra


def plain_best_fit(sizes, sources, clusters, capacity, slots):
    """Looks at every bin for each piece."""
    bins, out = [], []
    for n, s, c in zip(sizes, sources, clusters):
        fit = [(b["left"], b["age"], k) for k, b in enumerate(bins) if b["left"] >= n and c not in b["clusters"] and b["sources"][s] < slots]
        if fit:
            k = min(fit)[2]
        else:
            k = len(bins)
            bins.append({"left": capacity, "age": 0, "clusters": set(), "sources": Counter()})
        b = bins[k]
        b["left"] -= n
        b["age"] = len(out) + 1  # since when it has had this residual
        b["clusters"].add(c)
        b["sources"][s] += 1
        out.append(k)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.sampled_from("abc"), st.integers(0, 6)), max_size=40))
def test_equals_a_plain_search(pieces):
    pieces = sorted(pieces, key=lambda p: -p[0])
    sizes, sources, clusters = [p[0] for p in pieces], [p[1] for p in pieces], [p[2] for p in pieces]
    got = packing.best_fit(np.array(sizes, dtype=np.int64), sources, np.array(clusters, dtype=np.int64), 20, 2)
    assert got.tolist() == plain_best_fit(sizes, sources, clusters, 20, 2)


def test_pieces_cover_every_text_and_bins_hold_no_conflict(spark):
    made = rows()
    got = packing.pack(documents(spark, made), capacity=128, slots=2, block=16, tokenizer=None).collect()
    words = Counter()
    for i, text, *_ in made:
        words[i] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    total, bins = Counter(), defaultdict(list)
    for r in got:
        total[r.doc_id] += r.n_tokens
        bins[r.bin].append(r)
        assert r.start == r.piece * 128 and 0 <= r.n_tokens <= 128
    assert total == words
    source, texts = {r[0]: r[3] for r in made}, {r[0]: r[1] for r in made}
    for b in bins.values():
        assert sum(r.n_tokens for r in b) == b[0].bin_tokens <= 128 and len(b) == b[0].bin_pieces
        if None not in [r.doc_id for r in b]:
            assert max(Counter(source[r.doc_id] for r in b).values()) <= 2
            assert len({" ".join((texts[r.doc_id] or "").lower().split()) for r in b}) == len(b)


def test_fill_hot_source_and_empty_table(spark):
    rng = random.Random(4)
    made = [(i, "w " * rng.randrange(1, 400), "en", "src0" if i % 3 else f"s{i % 7}", 1) for i in range(600)]
    df = with_extra(spark, made)
    bins = packing.pack(df, capacity=512, tokenizer=None).select("bin", "bin_tokens").distinct().toPandas()
    assert bins.bin_tokens.mean() > 0.85 * 512
    assert packing.pack(df.limit(0)).count() == 0


def test_the_rows_alone_decide(spark):
    """However the rows are partitioned, whatever the settings, the same bins come out."""
    df = documents(spark, rows())
    want = sorted(map(str, packing.pack(df, capacity=64, block=20).collect()))
    for parts in (1, 7):
        assert sorted(map(str, packing.pack(df.repartition(parts), capacity=64, block=20).collect())) == want


def test_sequences_give_back_the_texts(spark):
    made = rows()
    df = with_extra(spark, made)
    encode = tokens.encoder(tokens.vocabulary(tokens.TOKENIZER), "x")
    got = packing.sequences(df, capacity=64, block=20).collect()
    told = packing.pack(df, capacity=64, block=20).collect()
    assert sorted(map(str, told)) == sorted(str(Row(**{k: v for k, v in r.asDict().items() if k != "tokens"})) for r in got)
    for r in got:
        assert len(r.tokens) == r.n_tokens <= 64
    by_id = defaultdict(dict)
    for r in got:
        by_id[r.doc_id].setdefault(r.piece, r.tokens)
    for i, text, *_ in made:
        if i is not None:
            assert [x for _, p in sorted(by_id[i].items()) for x in p] == encode(text or "")
    assert packing.sequences(df.limit(0)).count() == 0


def test_many_copies_of_a_row_are_dealt_apart(spark):
    df = documents(spark, [(None, "same text", "en", "s", 1)] * 9000)
    got = packing.pack(df, block=1000).toPandas()
    assert len(got) == 9000 and got.bin.nunique() == 9000 and got.bin.str.split("-").str[0].value_counts().max() < 1500
