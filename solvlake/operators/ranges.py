"""Typical ranges of earlier measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvlake.operators import ordered


def matches(extractant: Column, element: Column, wanted: str, symbol: str, exact: bool = False) -> Column:
    """Extractant as it stands; element as a substring in any case (so Y finds Dy), or exactly."""
    if exact:
        return (extractant == wanted) & (F.lower(element) == symbol.lower())
    literal = symbol.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return (extractant == wanted) & F.ilike(element, F.lit(f"%{literal}%"))


def summary(rows: DataFrame, paper: str, values: dict[str, str], keys: tuple[str, ...] = (), most: int = ordered.MOST) -> DataFrame:
    """Papers, rows, and least, median and largest value of each column; no row where there are no rows. Medians of
    groups of more than `most` rows are found by rank and not in one task's memory."""
    large = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > most)
    by_rank = not large.isEmpty()
    kinds = (("min", F.min), *(() if by_rank else (("median", F.median),)), ("max", F.max))
    stats = [f(c).alias(f"{name}_{kind}") for name, c in values.items() for kind, f in kinds]
    told = rows.groupBy(*keys).agg(F.count_distinct(paper).alias("n_papers"), F.count("*").alias("n_rows"), *stats).filter("n_rows > 0")
    if not by_rank:
        return told
    middle = ordered.medians(rows, list(keys), {f"{name}_median": F.col(c) for name, c in values.items()}, most).withColumnsRenamed({k: f"{k}_" for k in keys})
    joined = told.join(middle, ordered.same(told, middle, list(keys), list(keys), "_")) if keys else told.crossJoin(middle)  # a row each
    return joined.select(*keys, "n_papers", "n_rows", *[f"{name}_{kind}" for name in values for kind in ("min", "median", "max")])


def typical_ranges(best: DataFrame, extractant: str, element: str, exact: bool = False) -> DataFrame:
    found = best.filter(matches(F.col("extractant"), F.col("element"), extractant, element, exact))
    return summary(found, "paper_id", {"ph": "ph", "conc": "extractant_mm", "extract_pct": "extract_pct"})


def outside(target: Column, low: Column, high: Column) -> Column:
    """Whether a target lies outside a known range; false where nothing is known."""
    return F.coalesce((target < low) | (target > high), F.lit(False))


def extractants(best: DataFrame, column: str = "extractant") -> DataFrame:
    return best.filter(F.col(column).isNotNull()).select(column).distinct().orderBy(column)
