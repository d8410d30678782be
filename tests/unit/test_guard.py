import json

import pytest

from solvlake.plans import dialect, guard


@pytest.fixture(scope="module")
def views(spark):
    papers = spark.createDataFrame([(1, "10.1/a", "Dy"), (2, None, "Y")], "paper_id long, doi string, title string")
    best = spark.createDataFrame([(1, 2.5), (2, None)], "paper_id long, `Extract%` double")
    return {"papers": papers, "v_current_best": best, "text_endpoints": papers, "prompt_runs": papers}


ALLOWED = [
    "SELECT * FROM papers", "select count(*) from papers;", "SELECT p.title FROM papers p JOIN v_current_best v ON p.paper_id = v.paper_id", "WITH x AS (SELECT * FROM papers) SELECT * FROM x", "SELECT * FROM papers -- DROP TABLE papers", "SELECT /* ; */ 1",
    "SELECT title FROM papers UNION SELECT title FROM prompt_runs", "SELECT 'DROP TABLE x; --' AS s FROM papers", "SELECT replace(title, 'D', 'd') FROM papers", 'SELECT "Extract%" FROM "v_current_best"', "SELECT * FROM PAPERS", "SELECT row_number() OVER (ORDER BY paper_id) FROM papers",
    "SELECT title AS begin, doi AS commit, paper_id AS release FROM papers", "SELECT title FROM papers EXCEPT SELECT title FROM prompt_runs", "SELECT title FROM papers INTERSECT SELECT title FROM prompt_runs",
]
REFUSED = [
    ("", "no query"), ("  -- only this", "no query"), ("SELECT 1; SELECT 2", "one statement"), ("DROP TABLE papers", "starts with SELECT"), ("PRAGMA x", "starts with SELECT"), ("SELECT * FROM extractions", "allow-list"), ("SELECT * FROM papers, review_log", "allow-list"), ("SELECT * FROM papers WHERE paper_id IN (SELECT paper_id FROM review_log)", "allow-list"),
    ("SELECT (SELECT max(review_id) FROM review_log) FROM papers", "allow-list"), ("WITH x AS (SELECT * FROM review_log) SELECT * FROM x", "allow-list"), ("SELECT 'review_log AS (' FROM review_log", "allow-list"), ("SELECT * FROM `review_log`", "allow-list"), ("SELECT * FROM parquet.`/tmp`", "allow-list"), ("SELECT * FROM range(5)", "allow-list"),
    ("WITH papers AS (SELECT 1 AS a) SELECT * FROM papers", "CTE"), ("SELECT * FROM papers WHERE 1 = 1 DELETE", "query failed"), ("WITH x AS (SELECT 1) INSERT INTO papers SELECT * FROM x", "may only read"), ("WITH x AS (SELECT 1) DELETE FROM papers", "may only read"), ("SELECT reflect('java.lang.System', 'exit', 1)", "function"), ("SELECT `reflect`('java.lang.System', 'exit', 1)", "function"), ("SELECT FROM WHERE", "query failed"), ("SELECT nope FROM papers", "query failed"),
]


@pytest.mark.parametrize("sql", ALLOWED)
def test_allowed(spark, views, sql):
    assert isinstance(json.loads(guard.query_database(spark, sql, views, timeout=60)), list)


@pytest.mark.parametrize(("sql", "why"), REFUSED)
def test_refused(spark, views, sql, why):
    assert why in json.loads(guard.query_database(spark, sql, views, timeout=60))["error"]


def test_limit_is_added_only_where_the_result_has_none(spark, views):
    many = {"papers": spark.range(2000).withColumnRenamed("id", "paper_id")}
    assert guard.guarded(spark, "SELECT * FROM papers", many).count() == 500
    assert guard.guarded(spark, "SELECT * FROM papers LIMIT 700", many).count() == 700
    assert guard.guarded(spark, "SELECT * FROM (SELECT * FROM papers LIMIT 900)", many).count() == 500
    assert guard.guarded(spark, "WITH x AS (SELECT * FROM papers LIMIT 900) SELECT * FROM x", many).count() == 500
    assert guard.guarded(spark, "WITH x AS (SELECT * FROM papers) SELECT * FROM x LIMIT 600", many).count() == 600


def test_rows_keep_nulls_and_like_is_a_choice(spark, views):
    assert json.loads(guard.query_database(spark, 'SELECT paper_id, "Extract%" FROM v_current_best ORDER BY 1', views, timeout=60)) == [{"paper_id": 1, "Extract%": 2.5}, {"paper_id": 2, "Extract%": None}]
    asked = "SELECT title FROM papers WHERE title LIKE '%Y%'"
    assert guard.guarded(spark, asked, views).count() == 1 and guard.guarded(spark, asked, views, sqlite=True).count() == 2
    assert dialect.sqlite(spark, "SELECT 'a LIKE b' LIKE 'x'") == "SELECT 'a LIKE b' ILIKE 'x'"


def test_timeout(spark):
    big = {"papers": spark.range(3_000_000)}
    said = guard.query_database(spark, "SELECT count(*) FROM papers a JOIN papers b ON a.id % 7 = b.id % 7 AND a.id + b.id > 3", big, timeout=1)
    assert json.loads(said) == {"error": "query failed: timeout"}


def test_no_answer_is_cut_in_silence(spark, monkeypatch):
    monkeypatch.setattr(guard, "MOST_ROWS", 50)
    many = {"papers": spark.range(60).withColumnRenamed("id", "paper_id")}
    assert "more than 50 rows" in json.loads(guard.query_database(spark, "SELECT * FROM papers LIMIT 60", many, timeout=60))["error"]
    assert len(json.loads(guard.query_database(spark, "SELECT * FROM papers LIMIT 50", many, timeout=60))) == 50


#: What SQLite answers.
MEANT = [
    ("7/2", 3), ("-7/2", -3), ("7/2.0", 3.5), ("7.0/2", 3.5), ("(7/2)/2", 1), ("7/2/2", 1), ("100/(7/2)", 33), ("7/0", None), ("7.0/0", None), ("7/2*1.0", 3.0), ("(3+4)/(1+1)", 3), ("'7/2'", "7/2"), ("7 /* a/b */ / 2", 3), ("n/2", 2), ("x/2", 1.25), ("sum(n)/2", 2), ("1 || 'a'", "1a"),
    ("'Dy' LIKE 'dY'", True), ("'Dy' NOT LIKE '%Y'", False), ("'a_b' LIKE 'A!_b' ESCAPE '!'", True), ("strftime('%Y-%m', '2024-03-05 06:07:08')", "2024-03"), ("strftime('100%% %H:%M:%S %j %w', '2024-03-05 06:07:08')", "100% 06:07:08 065 2"), ("datetime('2024-03-05')", "2024-03-05 00:00:00"), ("datetime('no date')", None), ("ifnull(NULL, 3)/2", 1), ("round(julianday('2000-01-01 12:00:00'), 3)", 2451545.0),
    ("ppm_to_mM(162.5, atomic_mass('Dy'))", 1.0), ("ppm_to_mM(1, 0)", None), ("mass_mg_in_volume(10, 500, atomic_mass('no'))", None), ("MOLAR_RATIO_FROM_CONC(500, 50)", 10.0), ("CASE WHEN 5/2 = 2 THEN 'whole' ELSE 'no' END", "whole"), ("(SELECT max(n)/2 FROM papers)", 2),
]


def test_sqlite_meaning(spark):
    papers = {"papers": spark.createDataFrame([(5, 2.5)], "n int, x double")}
    asked = ", ".join(f"{e} AS c{i}" for i, (e, _) in enumerate(MEANT) if "sum(" not in e)
    got = guard.guarded(spark, f"SELECT {asked} FROM papers -- 1/2 LIKE", papers, sqlite=True).first().asDict()
    assert got == {f"c{i}": v for i, (e, v) in enumerate(MEANT) if "sum(" not in e}
    one = guard.guarded(spark, "WITH q AS (SELECT n/2 AS h FROM papers WHERE n/2 > 1) SELECT sum(h)/2 AS s FROM q GROUP BY h/2 HAVING sum(h)/2 = 1 ORDER BY s/2", papers, sqlite=True)
    assert [r.s for r in one.collect()] == [1]


def test_functions_off_the_list(spark, views):
    for call in ("current_user()", "input_file_name()", "raise_error('x')", "java_method('java.util.UUID', 'randomUUID')"):
        assert "function" in json.loads(guard.query_database(spark, f"SELECT {call} FROM papers", views, timeout=60))["error"]
