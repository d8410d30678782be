import pytest

from solvlake.operators import qa
from solvlake.schema import NUMERIC

COLUMNS = "custom_id string, row_ord int, element string, ph double, extract_pct double, recovery_pct double, sf_pct double, extractant_mm double, extract_temp_c double, acid_m double, leach_min double, strip_temp_c double, extractant_type string, mixing_method string"
ENDPOINTS = "custom_id string, endpoint_ord int, element string, x_value double, x_basis string, y_value double, y_metric string"


def frame(spark, rows):
    full = [dict.fromkeys([c.split()[0] for c in COLUMNS.split(", ")]) | {"custom_id": "r", "row_ord": i} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.values()) for r in full], COLUMNS)


def found(spark, rows, endpoints=(), known=(), failures=0, curve=True):
    df = frame(spark, rows)
    runs = spark.createDataFrame([("r", len(rows), failures)], "custom_id string, n_rows long, coercion_failures long")
    eps = spark.createDataFrame([("r", i, *e) for i, e in enumerate(endpoints)], ENDPOINTS)
    counts = spark.createDataFrame([("r", n) for n in known], "custom_id string, n long") if known else None
    flags = qa.run_rules(df, runs, eps, counts, figure_is_curve=curve)
    verdict = qa.verdicts(runs, flags, ("custom_id",)).first()
    return sorted((f.rule, f.severity) for f in flags.collect()), verdict.verdict, verdict.passed


def curve(element="La", n=12, **more):
    return [{"element": element, "ph": 1 + 0.3 * i, "extract_pct": min(99.0, 10.0 + 7 * i)} | more for i in range(n)]


def test_good_curve(spark):
    assert found(spark, curve()) == ([], "GREEN", True)


def test_sparse(spark):
    rows = [{"element": "Yb", "ph": 1.0, "extract_pct": 20.0}, {"element": "Yb", "ph": 5.0, "extract_pct": 90.0}]
    assert found(spark, rows) == ([("row_count_sanity", "RED")], "RED", False)
    assert found(spark, rows, curve=False) == ([], "GREEN", True)
    assert found(spark, [r | {"element": None} for r in rows])[0] == [("row_count_sanity", "RED")]


@pytest.mark.parametrize("change", [{"extract_pct": 150.0}, {"recovery_pct": -1.0}, {"ph": 14.5}, {"sf_pct": -0.1}])
def test_bounds(spark, change):
    rows = curve()
    rows[0] |= change
    assert ("axis_bounds", "RED") in found(spark, rows)[0]


def test_nan_is_not_out_of_bounds(spark):
    rows = curve()
    rows[0]["sf_pct"] = float("nan")
    assert found(spark, rows)[1] == "GREEN"


def test_empty_and_garbled(spark):
    assert found(spark, []) == ([("schema_conformance", "RED")], "RED", False)
    assert found(spark, curve(), failures=3)[0] == [("schema_conformance", "RED")]


def test_vocabulary(spark):
    assert found(spark, curve(extractant_type="totally-new"))[0:2] == ([("vocabulary", "AMBER")], "AMBER")
    assert found(spark, curve(extractant_type="  ACIDIC ", mixing_method=" "))[1] == "GREEN"


def test_monotonicity_and_duplicates(spark):
    zigzag = [{"element": "La", "ph": float(i), "extract_pct": 50.0 + 20 * (i % 2)} for i in range(8)]
    assert found(spark, zigzag)[0] == [("monotonicity", "AMBER")]
    assert found(spark, [r | {"extractant_mm": float(i % 4)} for i, r in enumerate(zigzag)])[0] == []
    assert found(spark, curve() + curve(n=1))[0] == [("duplicate_rows", "AMBER")]


SWEEP = [{"element": "La", "ph": 1.75, "extract_pct": y, "extractant_mm": x} for x, y in ((50.0, 0.24), (100.0, 25.66), (250.0, 7.38), (500.0, 14.1), (1000.0, 26.92))]
PH_SWEEP = [{"element": "La", "ph": 0.87 + 0.15 * i, "extract_pct": min(99.0, 2.0 + 6 * i), "extractant_mm": 500.0} for i in range(14)]


@pytest.mark.parametrize(("rows", "endpoint", "red"), [
    (curve("Nd"), ("Nd", 3.0, "pH", 95.0, "Extract%"), True), (curve("Nd"), ("Nd", 3.1, "pH", 59.0, "Extract%"), False),
    (curve("Nd"), ("Nd", 9.0, "pH", 95.0, "Extract%"), True), (curve("Nd"), ("nd", 9.0, "logD", 95.0, "Extract%"), False), (curve("Nd"), ("Nd", 3.0, "pH", 9.0, "logD"), False),
    (curve("Nd"), ("Missing", 1.0, "pH", 10.0, "Extract%"), False), (curve("Nd"), (None, 1.0, "pH", 10.0, "Extract%"), False), (curve("Nd"), ("N(d", 1.0, "pH", 90.0, "Extract%"), True),
    (PH_SWEEP + SWEEP, ("La", 1.75, "pH", 14.02, "Extract%"), False), (PH_SWEEP + SWEEP, ("La", 1.75, "pH", 60.0, "Extract%"), True),
    (PH_SWEEP + SWEEP, ("La", 990.0, "extractant_conc_mM", 20.0, "Extract%"), False), (curve("Nd"), ("Nd", None, "pH", 95.0, "Extract%"), False),
])
def test_stated_values(spark, rows, endpoint, red):
    assert (("text_endpoint_cross_check", "RED") in found(spark, rows, [endpoint])[0]) == red


def test_two_experiments_are_not_pooled(spark):
    assert "monotonicity" not in [r for r, _ in found(spark, PH_SWEEP + SWEEP)[0]]


def test_known_counts(spark):
    full = curve("La", 19) + curve("Ce", 19) + curve("Nd", 19)
    assert found(spark, full, known=(19, 19, 19))[0] == []
    short = curve("La", 19) + curve("Ce", 10) + curve("Nd", 9)
    assert found(spark, short, known=(19, 19, 19))[0] == [("deterministic_curve_count", "AMBER")]
    assert len(NUMERIC) == 16
