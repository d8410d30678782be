import json

import pytest

from solvlake.schema import DISPLAY, INTERNAL
from solvlake.sources.responses import parse

ELEMENT = DISPLAY["element"]


def fenced(obj) -> str:
    return f"some work\n```json\n{json.dumps(obj)}\n``` done"


def positional(names=None, size=26):
    names = names or list(DISPLAY.values())
    return {"columns": names, "rows": [[({"pH": 2.5, ELEMENT: "La"}).get(n) for n in names][:size]]}


def parsed(spark, *texts):
    return parse(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "custom_id string, raw_text string"))


def test_both_row_shapes_and_order(spark):
    back = list(DISPLAY.values())[::-1]
    rows, endpoints, summary = parsed(spark, fenced({"rows": [{"pH": "abc", ELEMENT: "La"}, {"pH": " 2.5 ", "Extract%": True}], "text_endpoints": [{"element": "La", "x_value": "3", "x_basis": "pH"}, 5]}), fenced(positional()), fenced(positional(back)), 'x {"rows": [{"pH": 3}]} y')
    got = {(r.custom_id, r.row_ord): (r.element, r.ph, r.extract_pct) for r in rows.collect()}
    assert got == {("0", 0): ("La", None, None), ("0", 1): (None, 2.5, 1.0), ("1", 0): ("La", 2.5, None), ("2", 0): ("La", 2.5, None), ("3", 0): (None, 3.0, None)}
    assert [(r.custom_id, r.element, r.x_value, r.x_basis, r.y_value) for r in endpoints.collect()] == [("0", "La", 3.0, "pH", None)]
    assert {r.custom_id: (r.error, r.n_rows, r.coercion_failures) for r in summary.collect()} == {"0": (None, 2, 1), "1": (None, 1, 0), "2": (None, 1, 0), "3": (None, 1, 0)}
    assert len(rows.columns) == 28 and set(INTERNAL) == set(DISPLAY.values())


@pytest.mark.parametrize(("said", "error"), [
    ("no json", "no JSON object"), ("", "no JSON object"), ("} {", "no JSON object"), ("```json\n{bad}\n```", "no JSON object"),
    (fenced({"rows": [[1, 2]]}), "positional rows without columns"), (fenced(positional(["PH" if n == "pH" else n for n in DISPLAY.values()])), "columns differ from the contract"),
    (fenced(positional(size=2)), "row length differs from columns"), (fenced({"rows": "x"}), "rows is not a list"), (fenced({"rows": [{"pH": 1}, 7]}), "row is not an object"),
    (fenced({"rows": None}), None), (fenced({"rows": {}}), None), (fenced({"rows": []}), None), (fenced({"a": 1}), None),
])
def test_errors(spark, said, error):
    rows, endpoints, summary = parsed(spark, said)
    assert summary.first().error == error and rows.count() == endpoints.count() == 0


def test_last_good_block_wins_and_null_text(spark):
    rows, _, summary = parsed(spark, '```json\n{"rows": [{"pH": 1}]}\n``` then ```\n{"rows": [{"pH": 2}]}\n``` then ```json\n{broken}\n```', None)
    assert [r.ph for r in rows.collect()] == [2.0]
    assert {r.custom_id: r.error for r in summary.collect()} == {"0": None, "1": "no JSON object"}


def test_a_response_is_parsed_once(spark):
    """A filter on the error does not bring the parsing with it, once for each mention."""
    rows, _, _ = parse(spark.range(3).selectExpr("CAST(id AS STRING) AS custom_id", "concat('{\"rows\": [{\"pH\": ', id, '}]}') AS raw_text"))
    rows.collect()
    plan = rows._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp_extract_all") <= 2  # where it is made, once to be counted and once to be read


def test_the_summary_parses_once(spark):
    _, _, summary = parse(spark.range(3).selectExpr("CAST(id AS STRING) AS custom_id", "concat('{\"rows\": [{\"pH\": ', id, '}]}') AS raw_text"))
    plan = summary._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("regexp_extract_all") <= 2


def test_outcomes_parse_a_text_once(spark, tmp_path):
    """Rows and errors by one pass over the texts, without a join, and as parse() tells them."""
    from solvlake import queries
    from solvlake.sources.responses import outcomes

    texts = ['{"rows": [{"pH": 1, "Extractant": "A"}, {"pH": "x"}]}', '{"rows": []}', "none", '{"rows": [[1]]}', '{"rows": [{"pH": 2}, 3]}', '{"rows": 5}', '{"columns": ["pH", "pH", null], "rows": [[1, 2, 3]]}', None]
    said = spark.createDataFrame([(str(i), s) for i, s in enumerate(texts)], "custom_id string, raw_text string")
    rows, _, summary = parse(said)
    want = summary.select("custom_id", "error").join(rows, "custom_id", "left")
    got = outcomes(said).select(*want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 9
    spark.range(8).selectExpr("id AS event_id", "id / 2.0D AS value").write.parquet(f"{tmp_path}/events.parquet")
    told = queries.QUERIES["f7_positional_rows"](spark, str(tmp_path))
    assert told.filter("error IS NULL AND extractant = 'D2EHPA'").count() == 2 and told.count() == 8
    assert "Join" not in told._jdf.queryExecution().optimizedPlan().toString()
