import pytest
from pyspark.sql import functions as F

from solvlake.operators import ranges, versions
from solvlake.plans.store import CommitError, Store
from solvlake.schema import SCHEMA
from solvlake.streaming import ingest


def measured(spark, n=10, **more):
    rows = [{f.name: None for f in SCHEMA} | {"element": "La", "ph": 1 + 0.3 * i, "extract_pct": 10.0 + 7 * i} | more for i in range(n)]
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).withColumn("row_ord", F.monotonically_increasing_id())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path))


def commit(store, rows, sha="abc", version="extraction_v5", **more):
    return store.commit_extraction(rows, content_sha256=sha, pdf_path=f"{sha}.pdf", prompt_version=version, **more)


def test_versions_coexist_and_the_latest_approved_is_current(spark, store):
    stated = spark.createDataFrame([(0, "La", 3.0, "pH", 60.0, "Extract%", "q"), (1, "", 3.0, "pH", 60.0, "Extract%", "q")], "endpoint_ord int, element string, x_value double, x_basis string, y_value double, y_metric string, source_quote string")
    assert commit(store, measured(spark), doi="10.1/X ", endpoints=stated) == {"paper_id": 1, "prompt_run_id": 1, "rows_merged": 10}
    assert commit(store, measured(spark, 4, sf_pct=float("nan")), sha="other", doi=" 10.1/x", version="extraction_v5.1")["paper_id"] == 1
    assert commit(store, measured(spark, 3), sha="abc", version="extraction_v10")["paper_id"] == 1
    best = store.current_best()
    assert best.count() == 4 and best.filter("sf_pct IS NOT NULL").count() == 0  # versions compare as text
    assert store.table("text_endpoints").count() == 1 and store.table("papers").first().doi == "10.1/x"
    assert [r.extraction_id for r in store.table("extractions").orderBy("extraction_id").collect()] == list(range(1, 18))
    assert "Extract%" in store.views()["v_current_best"].columns


def test_a_refused_commit_leaves_nothing(spark, store):
    commit(store, measured(spark), qa_passed=False, override=True)
    before = {n: store.table(n).count() for n in ("papers", "prompt_runs", "extractions", "review_log")}
    with pytest.raises(CommitError, match="one approved run"):
        commit(store, measured(spark))
    assert {n: store.table(n).count() for n in before} == before
    assert store.table("review_log").first().note == "[RED-flag override] no reason given"
    with pytest.raises(CommitError, match="status"):
        store.publish({"run_status": spark.createDataFrame([(9, 1, "maybe")], "event_id long, prompt_run_id long, status string")})
    with pytest.raises(CommitError, match="no paper"):
        store.publish({"review_log": spark.createDataFrame([(9, 7, 1, "approve")], "review_id long, paper_id long, prompt_run_id long, action string")})
    with pytest.raises(FileNotFoundError):
        Store(spark, f"{store.path}/none", create=False)


def test_status_events(spark, store):
    commit(store, measured(spark))
    store.publish({"run_status": spark.createDataFrame([(2, 1, "rejected")], "event_id long, prompt_run_id long, status string")})
    assert store.runs().first().status == "rejected" and store.current_best().count() == 0


def test_browse_and_ranges(spark, store):
    commit(store, measured(spark, 5, extractant="Cyanex 272", extractant_mm=500.0))
    commit(store, measured(spark, 5, extractant="D2EHPA", element="Dy"), sha="b")
    papers = versions.paper_list(store.table("papers"), store.runs().filter("status = 'approved'"), store.current_best())
    assert [(r.approved_runs, r.current_best_rows) for r in papers.orderBy("paper_id").collect()] == [(1, 5), (1, 5)]
    assert [r.prompt_run_id for r in versions.history(store.runs(), store.table("papers"), "prompt_run_id").collect()] == [2, 1]
    assert versions.history(store.runs(), store.table("papers"), "prompt_run_id", only=1).count() == 1
    row = ranges.typical_ranges(store.current_best(), "Cyanex 272", "la").first()
    assert (row.n_papers, row.n_rows, row.ph_min, row.extract_pct_median, row.conc_max) == (1, 5, 1.0, 24.0, 500.0)
    assert ranges.typical_ranges(store.current_best(), "D2EHPA", "Y").count() == 1
    assert ranges.typical_ranges(store.current_best(), "D2EHPA", "Y", exact=True).count() == 0
    assert ranges.typical_ranges(store.current_best(), "none", "La").first() is None
    assert [r.extractant for r in ranges.extractants(store.current_best()).collect()] == ["Cyanex 272", "D2EHPA"]


def test_duplicates_by_hash_first_then_doi(spark):
    known = spark.createDataFrame([(1, "abc", "10.1234/test.doi"), (2, "def", None)], "paper_id long, content_sha256 string, doi string")
    new = spark.createDataFrame([("abc", None), ("x", " 10.1234/TEST.DOI "), ("y", ""), ("def", "10.1234/test.doi")], "content_sha256 string, doi string")
    got = {r.content_sha256: (r.match_id, r.reason) for r in versions.find_duplicates(new, known).collect()}
    assert got == {"abc": (1, "content_hash"), "x": (1, "doi"), "y": (None, None), "def": (2, "content_hash")}


def test_ingestion_reads_new_files_once(spark, tmp_path):
    source, target, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    (source / "one.txt").write_text('{"rows": [{"pH": 1}]}')
    (source / "two.txt").write_text("garbage")
    ingest.ingest(spark, str(source), target, mark)
    (source / "three.txt").write_text('{"rows": [{"pH": 3}]}')
    for _ in range(2):
        ingest.ingest(spark, str(source), target, mark)
    assert sorted((r.custom_id, r.ph) for r in spark.read.parquet(f"{target}/rows").collect()) == [("one", 1.0), ("three", 3.0)]
    review = spark.read.parquet(f"{target}/review")
    assert {r.custom_id: (r.error, r.verdict) for r in review.collect()} == {"one": (None, "RED"), "three": (None, "RED"), "two": ("no JSON object", None)}
    done = spark.createDataFrame([("one",)], "custom_id string")
    assert {r.custom_id for r in ingest.pending(review, done).collect()} == {"two", "three"}


def test_the_log_is_read_from_checkpoints_and_as_of_a_commit(spark, store, monkeypatch):
    from solvlake.plans import store as module

    monkeypatch.setattr(module, "CHECKPOINT_EVERY", 2)
    for k in range(3):
        commit(store, measured(spark, 2 + k), sha=f"s{k}", version="v1", doi=f"10.1/{k}")
    opened = Store(spark, store.path)
    assert opened._checkpoints() == [2] and opened.state().commit == 3 and [opened.table("extractions", n).count() for n in (0, 1, 2, 3)] == [0, 2, 5, 9]
    with pytest.raises(ValueError, match="no commit 9"):
        opened.state(9)
    # a paper is found again by either key, among the folders that may hold it
    assert commit(opened, measured(spark), sha="other", version="v2", doi=" 10.1/1")["paper_id"] == 2
    assert commit(opened, measured(spark), sha="s2", version="v2")["paper_id"] == 3
    before = opened.state().commit
    assert opened.compact() == before + 1 and len(opened.state().of("extractions")) == 1 and opened.compact() == before + 1
    assert opened.table("extractions").count() == 29 and opened.table("extractions", 3).count() == 9
    with pytest.raises(CommitError, match="one approved run"):
        commit(opened, measured(spark), sha="s0", version="v1")
    assert opened.vacuum(opened.state().commit) > 0 and Store(spark, store.path).current_best().count() == 22


def test_writers_that_race(spark, store):
    """Both had read the same state; the slower one takes in the other's commit and tries again."""
    one, two = Store(spark, store.path), Store(spark, store.path)
    commit(one, measured(spark, 2))
    seen = two.state()
    commit(one, measured(spark, 3), sha="b")
    two.state = lambda as_of=None, real=two.state, first=[seen]: first.pop() if first else real(as_of)  # as if it had not looked again
    assert commit(two, measured(spark, 4), sha="c") == {"paper_id": 3, "prompt_run_id": 3, "rows_merged": 4}
    del two.state
    two.state = lambda as_of=None, real=Store.state.__get__(two), first=[seen]: first.pop() if first else real(as_of)
    with pytest.raises(CommitError, match="one approved run"):
        commit(two, measured(spark, 4), sha="b")
    del two.state
    assert sorted(r.extraction_id for r in one.table("extractions").collect()) == list(range(1, 10))


def test_unique_keys_across_folders(spark, store):
    papers = lambda *rows: {"papers": spark.createDataFrame(rows, "paper_id long, content_sha256 string, doi string")}
    store.publish(papers(*[(k, f"s{k}", f"10.1/{k}") for k in range(1, 40)]))
    store.publish(papers((100, "x", None), (101, "y", None)))
    for rows, what in (([(200, "s7", None)], "content_sha256"), ([(200, "new", "10.1/9")], "doi"), ([(100, "new", None)], "paper_id"), ([(200, "n", None), (200, "m", None)], "paper_id"), ([(200, None, None)], "NULL")):
        with pytest.raises(CommitError, match=what):
            store.publish(papers(*rows))
    assert store.table("papers").count() == 41 and store.state().commit == 2


def test_schema_versions(spark, tmp_path):
    old = Store(spark, str(tmp_path), version=1)
    commit(old, measured(spark), input_tokens=5)
    assert "input_tokens" not in old.table("prompt_runs").columns
    new = Store(spark, str(tmp_path))
    assert [r.input_tokens for r in new.table("prompt_runs").collect()] == [None]
    commit(new, measured(spark, 3), version="extraction_v6", input_tokens=7)
    assert {r.prompt_version: r.input_tokens for r in new.table("prompt_runs").collect()} == {"extraction_v5": None, "extraction_v6": 7}
    assert [m["schema"] for m in new.manifests()] == [1, 2] and new.state().version == 2
    late = Store(spark, str(tmp_path), version=1)  # an old writer does not take the store back
    commit(late, measured(spark), version="extraction_v7", input_tokens=9)
    assert sorted(r.input_tokens or 0 for r in new.table("prompt_runs").collect()) == [0, 7, 9]
    new.compact()
    assert sorted(r.input_tokens or 0 for r in Store(spark, str(tmp_path)).table("prompt_runs").collect()) == [0, 7, 9]
    with pytest.raises(PermissionError):
        Store(spark, str(tmp_path), read_only=True).compact()
