"""Text and formatting functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what a DOI looks like.
DOI = r"(?i)10\.\d{4,9}/[-._;()/:A-Za-z0-9]+"


def find_doi(text: Column) -> Column:
    """First DOI in a text, lower-cased, without trailing punctuation; NULL if there is none."""
    found = F.regexp_extract(text, DOI, 0)
    return F.when(found != "", F.lower(F.regexp_replace(found, r"[.,;)\]>]+$", "")))


def canonical_doi(doi: Column) -> Column:
    """A DOI for comparing; NULL if blank."""
    return F.nullif(F.lower(F.trim(doi)), F.lit(""))


def normal(value: Column) -> Column:
    """Vocabulary form: trimmed, lower case; NULL if blank."""
    text = F.lower(F.trim(value))
    return F.when(text != "", text)


def colour(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb of channels from 0 to 1, halves to even; black where there is none."""
    part = lambda v: F.lpad(F.lower(F.hex(F.bround(v * 255).cast("long"))), 2, "0")
    return F.coalesce(F.concat(F.lit("#"), part(r), part(g), part(b)), F.lit("#000000"))


def significant(x: Column, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits - 1}e", x).cast("double")


def stale(started: Column, now: Column, minutes: int = 10) -> Column:
    """Whether a lock that was taken at started no longer holds."""
    return now - started >= F.expr(f"INTERVAL {minutes} MINUTES")


def share_text(part: Column, total: Column) -> Column:
    """Whole percent, 0% of nothing."""
    return F.concat(F.coalesce(F.bround(100 * F.try_divide(part, total)), F.lit(0)).cast("long").cast("string"), F.lit("%"))
