import math

import pytest
from pyspark.sql import functions as F

from solvlake import schema
from solvlake.functions import chem, text


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


@pytest.mark.parametrize(("said", "value"), [("1.5", 1.5), (" 1.5 ", 1.5), ("1e3", 1000.0), ("inf", math.inf), ("1.5d", None), ("1.5f", None), ("", None), ("95%", None), ("1,000", None), ("0x10", None), ("nan", None), (None, None)])
def test_number(spark, said, value):
    assert one(spark, schema.number(F.lit(said).cast("string"))) == value


def test_conform_adds_drops_orders_and_casts(spark):
    df = spark.createDataFrame([("2.5", "x", "La", 1)], "`pH` string, extra string, element string, row_ord int")
    got = schema.conform(df, ("row_ord",))
    assert got.columns == ["row_ord", *schema.NAMES] and len(schema.NAMES) == 26 and len(schema.NUMERIC) == 16
    row = got.first()
    assert (row.ph, row.element, row.doi) == (2.5, "La", None)
    assert schema.to_display(got).columns[1:] == list(schema.DISPLAY.values())


def test_coercion_failures(spark):
    df = spark.createDataFrame([("a", "1", ""), (None, "x", "3%")], "ph string, extract_pct string, sf_pct string")
    assert [r.n for r in df.select(schema.coercion_failures(df).alias("n")).collect()] == [1, 2]


@pytest.mark.parametrize(("said", "doi"), [("see 10.1234/ABC.x-1). end", "10.1234/abc.x-1"), ("10.12/short", None), ("none", None), (None, None), ("(10.1000/a(b)>.;", "10.1000/a(b")])
def test_doi(spark, said, doi):
    assert one(spark, text.find_doi(F.lit(said).cast("string"))) == doi


def test_text_functions(spark):
    assert one(spark, text.colour(F.lit(1.0), F.lit(0.0), F.lit(0.5))) == "#ff0080"
    assert one(spark, text.colour(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.5))) == "#000000"
    assert [one(spark, text.significant(F.lit(x))) for x in (1.23456, 12345.6, 0.000123456, -2.0)] == [1.235, 12350.0, 0.0001235, -2.0]
    assert one(spark, text.share_text(F.lit(1), F.lit(3))) == "33%" and one(spark, text.share_text(F.lit(0), F.lit(0))) == "0%"
    assert one(spark, text.normal(F.lit("  Shaking "))) == "shaking" and one(spark, text.normal(F.lit("  "))) is None


def test_conversions_are_inverse(spark):
    la = chem.mass_of(F.lit("La"))
    assert one(spark, la) == 138.91 and one(spark, chem.mass_of(F.lit("Xx"))) is None and chem.RARE_EARTHS[-1] == "Sc"
    assert one(spark, chem.mm_to_ppm(chem.ppm_to_mm(F.lit(500.0), la), la)) == pytest.approx(500)
    assert one(spark, chem.ratio_from_conc(chem.conc_from_ratio(F.lit(2.0), F.lit(5.0)), F.lit(2.0))) == 5
    assert one(spark, chem.litres_for(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, chem.mg_in(F.lit(2.0), F.lit(500.0), la)) == pytest.approx(138.91)
    assert one(spark, chem.percent_from_log_d(F.lit(0.0))) == 50 and one(spark, chem.strip_percent(F.lit(3.0))) == 25


GIVEN = "element string, feed_value double, feed_unit string, target_molar_ratio double, target_extractant_conc_mM double, volume_mL double"


@pytest.mark.parametrize(("given", "want", "warned"), [
    (("La", 138.91, "ppm", 5.0, None, 1000.0), {"ree_mM": 1.0, "extractant_conc_mM": 5.0, "molar_ratio": 5.0, "ree_mmol_total": 1.0, "ree_mass_mg": 138.91, "extractant_mmol_total": 5.0}, 0),
    (("La", 2.0, "mM", None, 10.0, None), {"ree_ppm": 277.82, "molar_ratio": 5.0, "ree_mass_mg": None}, 0),
    (("La", 2.0, "mM", 5.0, 20.0, None), {"molar_ratio": 5.0, "extractant_conc_mM": 20.0}, 1),
    (("La", 2.0, "mM", 5.0, 10.2, None), {"molar_ratio": 5.0, "extractant_conc_mM": 10.2}, 0),
    (("La", None, "ppm", 5.0, None, 10.0), {"molar_ratio": None, "extractant_conc_mM": None, "ree_mM": None}, 1),
    (("La", 0.0, "ppm", None, 5.0, 10.0), {"molar_ratio": None, "extractant_conc_mM": 5.0, "ree_mM": 0.0}, 0),
    (("Xx", 1.0, "ppm", 5.0, 5.0, 1.0), {"ree_mM": None, "molar_ratio": None, "error": "unknown element Xx"}, 0),
])
def test_solve(spark, given, want, warned):
    row = chem.solve(spark.createDataFrame([given], GIVEN)).first().asDict()
    for k, v in want.items():
        assert row[k] == (v if v is None or isinstance(v, str) else pytest.approx(v)), k
    assert len(row["warnings"]) == warned


def test_calculate_explains_itself(spark):
    asked = [("ppm_to_mM", "La", 138.91, None, None), ("nope", "La", 1.0, None, None), ("ppm_to_mM", None, 1.0, None, None), ("ppm_to_mM", "Xx", 1.0, None, None), ("volume_for_target_moles", None, None, 1.0, 0.0), (None, None, None, None, None)]
    rows = chem.calculate(spark.createDataFrame(asked, "operation string, element string, ppm double, target_mmol double, conc_mM double")).collect()
    assert [(r.result, r.error) for r in rows] == [(1.0, None), (None, "unknown operation nope"), (None, "missing: mass"), (None, "unknown element Xx"), (None, "division by zero"), (None, "unknown operation NULL")]
