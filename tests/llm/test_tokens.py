import pytest

from solvlake.llm import shared, tokens
from solvlake.sources import files
from tests.llm.corpus import documents, rows, with_extra


def totals(rollup):
    return {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def brute(made):
    count, out = tokens.counter(tokens.vocabulary(tokens.TOKENIZER), "x"), {}
    for _, text, lang, source, _ in made:
        n, k = out.get((source, lang), (0, 0))
        out[source, lang] = (n + 1, k + count(text or ""))
    return out


def test_inserts_deletes_and_revisions_add_up(spark):
    made = rows()
    old, new = made[:10], [(r[0], (r[1] or "") + " and more", "de", r[3], r[4]) for r in made[:10]]
    rollup = tokens.Rollup(spark, shared.place(spark, "rollup"))
    assert totals(rollup) == {}
    assert rollup.commit("one", tokens.inserts(documents(spark, made)))
    assert totals(rollup) == brute(made)
    assert rollup.commit("two", tokens.revisions(documents(spark, old), documents(spark, new)))
    assert rollup.commit("three", tokens.deletes(documents(spark, made[10:20])))
    assert totals(rollup) == brute(new + made[20:])
    # a batch that is sent again changes nothing, whatever it holds
    assert not rollup.commit("two", tokens.inserts(documents(spark, made)))
    assert totals(rollup) == brute(new + made[20:])
    assert rollup.commit("empty", tokens.inserts(documents(spark, made).limit(0)))
    snapshot = shared.place(spark, "snapshot")
    rollup.compact(snapshot)
    after = tokens.Rollup(spark, snapshot)
    assert totals(after) == brute(new + made[20:])
    # the snapshot remembers what it covers
    assert after.batches() == {"one", "two", "three", "empty"}
    assert not after.commit("three", tokens.inserts(documents(spark, made)))
    assert after.commit("four", tokens.deletes(documents(spark, made[20:])))
    assert totals(after) == brute(new)
    with pytest.raises(FileExistsError):
        rollup.compact(snapshot)


def test_an_unfinished_attempt_does_not_count(spark):
    rollup = tokens.Rollup(spark, shared.place(spark, "rollup"))
    tokens.delta(tokens.inserts(documents(spark, rows()))).write.parquet(f"{rollup.path}/deltas/one-lost")
    assert totals(rollup) == {}
    rollup.commit("one", tokens.inserts(with_extra(spark, rows())))
    assert totals(rollup) == brute(rows())


def test_versions_are_apart_and_bad_input_is_refused(spark):
    rollup = tokens.Rollup(spark, shared.place(spark, "rollup"))
    df = documents(spark, rows()[:5])
    rollup.commit("a", tokens.inserts(df))
    rollup.commit("b", tokens.inserts(df), "/opt/tokenizers/byte_bpe_50k.tiktoken")
    assert {r.tokenizer_version for r in rollup.totals().collect()} == {"byte_bpe_multi_50k", "byte_bpe_50k"}
    with pytest.raises(ValueError, match="batch id"):
        rollup.commit("a/b", tokens.inserts(df))
    with pytest.raises(Exception, match="sign 1 or -1"):
        tokens.delta(tokens.inserts(df).selectExpr("2 AS sign", "text", "source", "lang")).count()


def test_a_crash_before_or_while_the_marker_is_written(spark):
    rollup = tokens.Rollup(spark, shared.place(spark, "rollup"))
    made = rows()
    marker = rollup._marker("one")
    files.write_text(spark, marker, "")  # what a writer that died between create and write leaves
    files.write_text(spark, marker.replace("/one.json", "/.one.json.part"), '{"delta"')  # and one that died while it wrote
    assert not rollup.committed("one") and totals(rollup) == {}
    assert rollup.commit("one", tokens.inserts(documents(spark, made)))
    assert not rollup.commit("one", tokens.inserts(documents(spark, made)))
    assert totals(rollup) == brute(made)


def test_of_two_runs_of_a_batch_one_counts(spark, monkeypatch):
    rollup = tokens.Rollup(spark, shared.place(spark, "rollup"))
    made = rows()[:5]
    rollup.commit("one", tokens.inserts(documents(spark, made)))
    monkeypatch.setattr(tokens.Rollup, "committed", lambda self, batch: False)  # the other run looked before this one committed
    assert not rollup.commit("one", tokens.inserts(documents(spark, made)))
    assert totals(rollup) == brute(made)
