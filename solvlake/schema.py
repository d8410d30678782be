"""The 26-column measurement contract: names, types, conforming and coercion accounting."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Display names in contract order, with the engine's own names and types.
CONTRACT: list[tuple[str, str, str]] = [
    ("reference_no", "Reference No.", "string"),
    ("doi", "DOI", "string"),
    ("treatment", "Treatment", "string"),
    ("sources", "Sources", "string"),
    ("material_process", "Material Process", "string"),
    ("si_pct", "Si (%)", "double"),
    ("al_pct", "Al (%)", "double"),
    ("zn_pct", "Zn (%)", "double"),
    ("fe_pct", "Fe (%)", "double"),
    ("element", "Rare Earth Elements (REY:La, Ce, Nd)", "string"),
    ("rre_ppm", "RRE composition (ppm)", "double"),
    ("rre_mm", "RRE composition (mM)", "double"),
    ("extractant", "Extractant", "string"),
    ("extractant_type", "Extractant type", "string"),
    ("extractant_mm", "Extractant Conc. (mM)", "double"),
    ("molar_ratio", "Molar ratio of EX/REE", "double"),
    ("extract_pct", "Extract%", "double"),
    ("extract_temp_c", "Extract Temperature (oC)", "double"),
    ("ph", "pH", "double"),
    ("sf_pct", "Separation factor (SF%)", "double"),
    ("acid_solution", "Acid Solution", "string"),
    ("acid_m", "Acid Solution conc. (M)", "double"),
    ("mixing_method", "mixing method", "string"),
    ("strip_temp_c", "Stripping Temperature (oC)", "double"),
    ("leach_min", "Leaching time (minute)", "double"),
    ("recovery_pct", "Recovery %", "double"),
]
NAMES = [n for n, _, _ in CONTRACT]
DISPLAY = {n: d for n, d, _ in CONTRACT}
INTERNAL = {d: n for n, d, _ in CONTRACT}
NUMERIC = [n for n, _, t in CONTRACT if t == "double"]
SCHEMA = T.StructType([T.StructField(n, T.DoubleType() if t == "double" else T.StringType()) for n, _, t in CONTRACT])


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def number(c: Column) -> Column:
    """Text to double, NULL where it is no number. A Java suffix (1.5d) is none; neither is NaN."""
    text = c.cast("string")
    return F.when(~text.rlike(r"(?i)(?:nan|[0-9.][df])\s*$"), F.trim(text).try_cast("double"))


def failed(c: Column) -> Column:
    """1 for a cell that holds something but no number."""
    return F.when(c.isNotNull() & (c.cast("string") != "") & number(c).isNull(), 1).otherwise(0)


def coercion_failures(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Failed numeric cells of a row, summed over the numeric columns that are there."""
    return reduce(add, [failed(F.col(c)) for c in (columns or [n for n in NUMERIC if n in df.columns])], F.lit(0))


def conform(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 26 columns in order (by either name), missing ones NULL, others dropped but for keep."""
    have = {c: c for c in df.columns} | {INTERNAL[c]: c for c in df.columns if c in INTERNAL}

    def cell(name: str, kind: str) -> Column:
        if name not in have:
            return F.lit(None).cast(kind).alias(name)
        c = F.col(f"`{have[name]}`")
        return (number(c) if kind == "double" else c.cast("string")).alias(name)

    return df.select(*keep, *[cell(n, t) for n, _, t in CONTRACT])


def to_display(df: DataFrame) -> DataFrame:
    """Contract columns under their display names, the rest as they are."""
    return df.select(*[F.col(f"`{c}`").alias(DISPLAY.get(c, c)) for c in df.columns])
