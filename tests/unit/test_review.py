import pytest
from pyspark.sql import functions as F

from solvlake.operators import qa, versions
from solvlake.plans.review import Staging, included, preview
from solvlake.plans.store import CommitError, Store
from solvlake.sources import files
from tests.unit.test_store import commit, measured


def test_previews_and_ticked_ones(spark):
    pages = [("new", 0, "text", "doi: 10.1/NEW.", " A title ", True, False), ("new", 1, "more", None, "A second", True, False), ("same", 0, "see 10.5555/x", None, "", False, True), ("byid", 0, "10.1234/KNOWN;", "", None, False, True)]
    pages = spark.createDataFrame(pages, "content_sha256 string, page_index int, text string, meta string, title string, has_image boolean, has_text boolean")
    uploads = spark.createDataFrame([("new", "a.pdf"), ("same", "b.pdf"), ("byid", "c.pdf"), ("unreadable", "d.pdf")], "content_sha256 string, path string")
    known = spark.createDataFrame([(7, "same", None), (9, "x", "10.1234/known")], "paper_id long, content_sha256 string, doi string")
    told = preview(uploads, pages, known)
    got = {r.path: (r.doi, r.title, r.n_pages, r.is_raster_figure, r.status, r.reason) for r in told.collect()}
    assert got["a.pdf"][1:] == ("A title", 2, 1, "new", None)
    assert got["b.pdf"][1:] == (None, 1, 0, "existing (paper_id=7)", "content_hash")
    assert got["c.pdf"] == ("10.1234/known", None, 1, 0, "existing (paper_id=9)", "doi")
    assert got["d.pdf"] == (None, None, 0, None, "new", None)
    fresh, there = included(told, spark.createDataFrame([("new",), ("same",), ("same",)], "content_sha256 string"))
    assert [r.path for r in fresh.collect()] == ["a.pdf"] and [r.path for r in there.collect()] == ["b.pdf"]


def test_staging_survives_and_reject_leaves_the_store_alone(spark, tmp_path):
    store, staging = Store(spark, str(tmp_path / "store")), Staging(spark, str(tmp_path / "staging"))
    schema = "item_id string, doi string, counts array<int>"
    assert staging.restore(schema).count() == 0
    for item in ("one", "two", "three"):
        assert staging.stage(item, measured(spark, 3), {"doi": f"10.1/{item}", "counts": [19, 19]})
    assert not staging.stage("one", measured(spark, 9), {}) and staging.rows("one").count() == 3
    files.delete(spark, f"{staging.path}/rows/two")
    files.write_text(spark, f"{staging.path}/meta/bad.json", "{")
    again = Staging(spark, staging.path)
    assert {(r.item_id, r.doi) for r in again.restore(schema).collect()} == {("one", "10.1/one"), ("three", "10.1/three")}
    assert "two" not in again._listed("meta") and "bad" not in again._listed("meta")
    again.reject("one")
    assert [r.item_id for r in again.restore(schema).collect()] == ["three"]
    assert store.table("papers").count() == store.table("review_log").count() == 0
    with pytest.raises(ValueError, match="item id"):
        again.reject("../x")


def test_pending_runs_are_reviewed(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    commit(store, measured(spark))
    run = store.insert_run(1, prompt_version="extraction_v6", n_rows=4, qa_passed=False, input_tokens=7)
    got = store.runs().filter(F.col("prompt_run_id") == run).first()
    assert (got.status, got.reviewed_at, got.qa_passed, got.input_tokens, got.n_rows_returned) == ("pending", None, 0, 7, 4)
    assert store.current_best().count() == 10
    store.set_status(run, "rejected")
    got = store.runs().filter(F.col("prompt_run_id") == run).first()
    assert got.status == "rejected" and got.reviewed_at is not None
    with pytest.raises(ValueError, match="pending"):
        store.set_status(run, "pending")
    with pytest.raises(CommitError, match="no paper"):
        store.insert_run(5, prompt_version="x")
    with pytest.raises(CommitError, match="no run"):
        store.set_status(99, "approved")


def test_a_writer_that_died_does_not_stop_the_next(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    files.write_text(spark, f"{store.path}/manifests/{1:012d}.json", "")  # between create and write
    files.write_text(spark, f"{store.path}/manifests/.{2:012d}.json.part", '{"com')
    assert store.manifests() == []
    commit(store, measured(spark))
    commit(store, measured(spark, 4), version="extraction_v6")
    assert [m["commit"] for m in store.manifests()] == [1, 2] and store.current_best().count() == 4
    assert files.publish_text(spark, f"{store.path}/x", "a") and not files.publish_text(spark, f"{store.path}/x", "b")
    reader = Store(spark, store.path, read_only=True)
    assert reader.current_best().count() == 4
    with pytest.raises(PermissionError):
        reader.insert_run(1, prompt_version="x")
    with pytest.raises(FileNotFoundError):
        Store(spark, str(tmp_path / "none"), read_only=True)


def test_lookups(spark):
    papers = spark.createDataFrame([(1, "abc", "10.1234/test.doi"), (2, "def", None), (3, "ghi", " ")], "paper_id long, content_sha256 string, doi string")
    find = lambda **k: [r.paper_id for r in versions.lookup(papers, **k).collect()]
    assert find(content_sha256="def") == [2] and find(doi=" 10.1234/TEST.DOI ") == [1] and find(paper_id=3) == [3]
    assert find(doi="") == find(doi=" ") == find(content_sha256="no") == find(paper_id=9) == find() == []


def test_prompts_without_the_placeholder_are_an_error(spark, tmp_path):
    (tmp_path / "v1.md").write_text("use {rows}")
    (tmp_path / "v2.md").write_text("nothing")
    assert files.prompts(spark, str(tmp_path)).count() == 2
    with pytest.raises(Exception, match="v2"):
        files.prompts(spark, str(tmp_path), "{rows}").collect()


def test_sidecars_are_written_one_a_row(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "batch_id string, n int, note string")
    files.write_sidecars(df, str(tmp_path / "side"), "batch_id")
    assert sorted(files.sidecars(spark, str(tmp_path / "side"), "batch_id string, n int, note string").collect()) == sorted(df.collect())


def test_patterns_match_as_patterns_if_they_are_simple(spark):
    cases = [("Nd", "nd", True), ("Nd", "N.", True), ("La (III)", "La (III)", False), ("La III", "La (III)", True), ("La+", "La(", False), ("La(", "La(", True), ("Dy", "^y", False), ("Dy", "Nd|Dy", True), ("a", "*", False), ("a\\", "\\", True), ("Pr", "[PN]", True), ("x[", "[", True)]
    df = spark.createDataFrame(cases, "text string, pattern string, want boolean")
    got = df.select("*", qa.contains_pattern(F.col("text"), F.col("pattern")).alias("got")).collect()
    assert [(r.text, r.pattern, r.got) for r in got] == cases


def test_reports_are_read_back(spark):
    runs = spark.createDataFrame([(1,), (2,)], "run int")
    found = qa.flags(spark.createDataFrame([(1, "La", 3)], "run int, s string, n int"), ("run",), "rule", qa.RED, F.col("s"), F.col("n"), F.lit("why"))
    told = qa.verdicts(runs, found, ("run",)).withColumn("flags", qa.read_report(F.col("report")))
    assert {r.run: [tuple(f) for f in r.flags] for r in told.collect()} == {1: [("rule", "RED", "La", 3, "why")], 2: []}
    assert spark.range(1).select(qa.read_report(F.lit("garbage")).alias("f")).first().f == []


def test_two_responses_of_one_id_do_not_mix(spark):
    from solvlake.sources.responses import parse, results_of

    said = spark.createDataFrame([("x", '{"rows": [{"pH": "bad"}]}'), ("x", '{"rows": [{"pH": 1}, {"pH": 2}]}'), ("y", "none")], "custom_id string, raw_text string")
    assert sorted((r.custom_id, r.error or "", r.n_rows, r.coercion_failures) for r in parse(said)[2].collect()) == [("x", "", 1, 1), ("x", "", 2, 0), ("y", "no JSON object", 0, 0)]
    asked = spark.createDataFrame([("x",), ("z",)], "custom_id string")
    assert {(r.custom_id, r.n_rows, r.error) for r in results_of(asked, parse(said)[2]).collect()} == {("x", 1, None), ("x", 2, None), ("z", None, "no result returned")}
