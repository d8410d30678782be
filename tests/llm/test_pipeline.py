"""The pipeline's stages against brute force, each on its own input, and run() as a whole."""

import random

import pytest

import corpus_pipeline
from solvlake.llm import queries, shared, tokens
from tests.llm.corpus import documents, rows, with_extra
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_ngram_join import brute as groups
from tests.llm.test_ngram_join import grams
from tests.llm.test_quality import brute as counts
from tests.llm.test_quality import verdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "item_id long, text string"


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(rng.randrange(2, 10))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    texts = [prose(rng, rng.randrange(60, 300)) for _ in range(40)]
    near = texts[0].split()
    near[30] = "other"
    item = prose(rng, 25)
    texts += [texts[1], " ".join(near), texts[2], prose(rng, 40) + " " + item + " " + prose(rng, 40), "short text", None, "", "spam spam " * 200]
    texts += [prose(rng, 60) + " password=hunter22x " + prose(rng, 20)]
    made = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(made, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], PAGES).write.parquet(f"{path}/benchmark.parquet")
    return path, made, [(1, item)]


def test_every_stage(spark, tables):
    path, made, items = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert len(steps) == 5
    now = {r[0]: r for r in made}

    def step(name, df):
        got = steps[name](spark, df, path)
        assert got.columns == df.columns
        return got, {r.doc_id: tuple(r) for r in got.collect()}

    df, kept = step("quality_rules", docs)
    now = {i: r for i, r in now.items() if verdict(r[1], counts(r[1])[-1])}
    assert kept == now and len(now) < len(made)

    df, kept = step("ngram_jaccard_join", df)
    rows = list(now.values())
    _, group = groups(rows)
    first = {}
    for r, g in zip(rows, group):
        first[g if grams(r[1]) else ("alone", r[0])] = min(r, first.get(g, r))
    now = {r[0]: r for r in first.values()}
    assert kept == now

    df, kept = step("benchmark_decontamination", df)
    bad = {key[1] for key, *_, hit in contaminated(list(now.values()), items) if hit}
    now = {i: r for i, r in now.items() if i not in bad}
    assert kept == now and bad

    df, kept = step("secret_scans", df)
    assert kept.keys() == now.keys()
    changed = {i for i in now if kept[i] != now[i]}
    assert changed == {48} and "hunter22x" not in kept[48][1] and kept[48][4] == len(kept[48][1])

    packed = steps["best_fit_packing"](spark, df, path).toPandas()
    words = packed.groupby("doc_id").n_tokens.sum().to_dict()
    encode = tokens.encoder(tokens.vocabulary(tokens.TOKENIZER), "x")
    assert words == {i: len(encode(r[1])) for i, r in kept.items()}
    assert packed.groupby("bin").n_tokens.sum().max() <= 2048
    assert all(len(r.tokens) == r.n_tokens for r in packed.itertuples())

    whole = corpus_pipeline.run(spark, path).toPandas()
    assert whole.groupby("doc_id").n_tokens.sum().to_dict() == words


def test_odd_rows_pass_every_stage(spark, tmp_path):
    """Nulls, repeated rows, a very long text, and columns with names that operators use; then no rows at all."""
    made = rows() + [(777, prose(random.Random(1), 25_000), None, None, None)]
    spark.createDataFrame([(1, "nothing like it " * 8), (None, None), (None, "")], PAGES).write.parquet(f"{tmp_path}/benchmark.parquet")
    for n, df in (("some", with_extra(spark, made)), ("none", with_extra(spark, made).limit(0)), ("slim", documents(spark, made).drop("n_chars"))):
        left = {}
        for name, stage in corpus_pipeline.STAGES:
            got = shared.stored(stage(spark, df, str(tmp_path)), shared.place(spark, name))
            left[name] = [r.doc_id for r in got.select("doc_id").collect()]
            if name != corpus_pipeline.STAGES[-1][0]:
                assert got.columns == df.columns and [f.dataType for f in got.schema] == [f.dataType for f in df.schema]
                df = got
        if n == "none":
            assert not any(left.values())
            continue
        kept = {k for k, r in enumerate(made) if verdict(r[1], counts(r[1])[-1])}
        assert sorted(map(str, left["quality_rules"])) == sorted(str(made[k][0]) for k in kept)
        assert left["ngram_jaccard_join"].count(3) == min(1, left["quality_rules"].count(3))
        assert set(left["best_fit_packing"]) == set(left["secret_scans"]) == set(left["benchmark_decontamination"]) == set(left["ngram_jaccard_join"])
        assert any(len(made[k][1]) > 100_000 and made[k][0] in left["best_fit_packing"] for k in kept)
    assert shared.tidy(spark) > 0 and shared.tidy(spark) == 0


def test_registered_queries():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{n}" for n in range(1, 11)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
