"""Semi-structured extraction responses to rows of the contract, in one plan of VARIANT expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvlake.schema import CONTRACT, DISPLAY, failed, number

# Fixed value: a fenced block with one JSON object.
FENCE = r"(?s)```(?:json)?\s*(\{.*?\})\s*```"
ENDPOINT = {"element": "string", "x_value": "double", "x_basis": "string", "y_value": "double", "y_metric": "string", "source_quote": "string"}


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _brace_span(text: Column) -> Column:
    first = F.instr(text, "{")
    last = F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((first > 0) & (F.instr(text, "}") > 0) & (last > first), F.substring(text, first, last - first + 1))


def json_object(text: Column) -> Column:
    """The last fenced block that parses to an object, or else the outermost brace span; NULL if none does."""
    blocks = F.regexp_extract_all(text, F.lit(FENCE), F.lit(1))
    texts = F.when(F.size(blocks) > 0, F.reverse(blocks)).otherwise(F.array_compact(F.array(_brace_span(text))))
    return F.try_element_at(F.filter(F.transform(texts, F.try_parse_json), lambda v: _is(v, "OBJECT")), F.lit(1))


def _once(df: DataFrame, *kept: str, **made: Column) -> DataFrame:
    """df's columns kept and the columns made. These are computed once a row, as rows of a one-row list: in a plain
    projection, a filter on what is made of them would have them computed again for each mention."""
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def examined(responses: DataFrame, id_col: str = "custom_id", text_col: str = "raw_text") -> DataFrame:
    """id, error, rows (as array<variant>), columns, endpoints of each response."""
    step = _once(_once(responses, id_col, obj=json_object(F.col(text_col))), id_col, "obj", raw=F.try_variant_get("obj", "$.rows", "variant"))
    raw = F.col("raw")
    empty = raw.isNull() | F.is_variant_null(raw) | F.coalesce(F.to_json(raw).isin("false", "0", '""', "{}", "0.0"), F.lit(False))
    listed = _is(raw, "ARRAY")
    step = _once(
        step, id_col, none=F.col("obj").isNull(), unlisted=~listed & ~empty, rows=F.when(listed, F.try_variant_get("obj", "$.rows", "array<variant>")).otherwise(F.array().cast("array<variant>")),
        columns=F.when(_is(F.try_variant_get("obj", "$.columns", "variant"), "ARRAY"), F.try_variant_get("obj", "$.columns", "array<string>")),
        endpoints=F.filter(F.coalesce(F.when(_is(F.try_variant_get("obj", "$.text_endpoints", "variant"), "ARRAY"), F.try_variant_get("obj", "$.text_endpoints", "array<variant>")), F.array().cast("array<variant>")), lambda e: _is(e, "OBJECT")),
    )
    step = _once(step, id_col, "none", "unlisted", "rows", "columns", "endpoints", positional=_is(F.try_element_at("rows", F.lit(1)), "ARRAY"))
    positional = F.col("positional")
    names = F.array(*[F.lit(d) for _, d, _ in CONTRACT])
    size = lambda v: F.size(F.try_variant_get(v, "$", "array<variant>"))
    error = (
        F.when(F.col("none"), "no JSON object")
        .when(F.col("unlisted"), "rows is not a list")
        .when(positional & F.col("columns").isNull(), "positional rows without columns")
        .when(positional & ((F.size(F.array_except(names, "columns")) > 0) | (F.size(F.array_except("columns", names)) > 0) | (F.size("columns") != len(CONTRACT))), "columns differ from the contract")
        .when(positional & F.exists("rows", lambda r: ~_is(r, "ARRAY") | (size(r) != F.size("columns"))), "row length differs from columns")
        .when(~positional & F.exists("rows", lambda r: ~_is(r, "OBJECT")), "row is not an object")
    )
    return _once(step, id_col, "positional", "rows", "columns", "endpoints", error=error)


def _cells(told: DataFrame, id_col: str, outer: bool = False) -> DataFrame:
    """id, row_ord and a map of variants for each row of the responses without error; if outer, with the error and a row
    of NULLs for responses that have one, or no rows."""
    if outer:
        each = told.select(id_col, "error", "positional", "columns", F.posexplode_outer(F.when(F.col("error").isNull(), F.col("rows"))).alias("row_ord", "row"))
    else:
        each = told.filter("error IS NULL").select(id_col, "positional", "columns", F.posexplode("rows").alias("row_ord", "row"))
    keyed = F.when(F.col("positional"), F.map_from_arrays("columns", F.try_variant_get("row", "$", "array<variant>"))).otherwise(F.try_variant_get("row", "$", "map<string,variant>"))
    return each.select(id_col, *["error"] * outer, "row_ord", keyed.alias("cells"))


def _text(v: Column) -> Column:
    return F.when(~F.is_variant_null(v), F.try_variant_get(v, "$", "string"))


def _number(v: Column) -> Column:
    return F.when(_is(v, "BOOLEAN"), F.try_variant_get(v, "$", "double")).otherwise(number(_text(v)))


def _truth(v: Column) -> Column:
    return F.when(F.try_variant_get(v, "$", "boolean"), "1").otherwise("0")


def _contract(cells: DataFrame) -> DataFrame:
    """The contract's columns in place of the map."""
    kept = [c for c in cells.columns if c != "cells"]
    # over arrays of cells rather than column by column, which would be too much code to compile
    at = lambda n: F.try_element_at("cells", n)
    numeric, textual = ([(n, d) for n, d, t in CONTRACT if (t == "double") == kind] for kind in (True, False))
    said = F.transform(F.array(*[F.lit(d) for _, d in numeric]), lambda n: F.when(_is(at(n), "BOOLEAN"), _truth(at(n))).otherwise(_text(at(n))))
    words = F.transform(F.array(*[F.lit(d) for _, d in textual]), lambda n: _text(at(n)))
    place = {n: ("numbers", i) for i, (n, _) in enumerate(numeric)} | {n: ("words", i) for i, (n, _) in enumerate(textual)}
    read = cells.select(*kept, said.alias("said"), words.alias("words")).withColumn("numbers", F.transform("said", number))
    return read.select(*kept, *[F.col(place[n][0])[place[n][1]].alias(n) for n, _, _ in CONTRACT])


def outcomes(responses: DataFrame, id_col: str = "custom_id", text_col: str = "raw_text") -> DataFrame:
    """id, error, row_ord and the contract's columns: each row of each response, and a row of NULLs for a response with
    an error or without rows. A text is parsed once, and nothing is shuffled, as a join of parse()'s results would."""
    return _contract(_cells(examined(responses, id_col, text_col), id_col, outer=True))


def parse(responses: DataFrame, id_col: str = "custom_id", text_col: str = "raw_text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, endpoints, summary): contract rows with row_ord; endpoint records; and, for each response,
    error, row count and coercion failures."""
    told = examined(responses, id_col, text_col)
    numeric = [d for _, d, t in CONTRACT if t == "double"]
    # a response's cells are counted in its own row, so that two responses of one id do not mix
    ok = F.col("error").isNull()
    keyed = lambda r: F.when(F.col("positional"), F.map_from_arrays("columns", F.try_variant_get(r, "$", "array<variant>"))).otherwise(F.try_variant_get(r, "$", "map<string,variant>"))
    cell = lambda v: F.when(_is(v, "BOOLEAN"), _truth(v)).otherwise(_text(v))
    names = F.array(*map(F.lit, numeric))
    bad = lambda r: F.size(F.filter(F.transform(names, lambda n: cell(F.try_element_at(keyed(r), n))), lambda x: failed(x) == 1))
    failures = F.aggregate(F.transform("rows", bad), F.lit(0).cast("long"), lambda a, x: a + x)
    zero = F.lit(0).cast("long")
    rows = _contract(_cells(told, id_col))
    summary = told.select(id_col, "error", F.when(ok, F.size("rows").cast("long")).otherwise(zero).alias("n_rows"), F.when(ok, failures).otherwise(zero).alias("coercion_failures"))
    each = told.filter("error IS NULL").select(id_col, F.posexplode("endpoints").alias("endpoint_ord", "e"))
    endpoints = each.select(id_col, "endpoint_ord", *[(_number(F.try_variant_get("e", f"$.{n}", "variant")) if t == "double" else _text(F.try_variant_get("e", f"$.{n}", "variant"))).alias(n) for n, t in ENDPOINT.items()])
    return rows, endpoints, summary


def results_of(requests: DataFrame, results: DataFrame, key: str = "custom_id") -> DataFrame:
    """Every request with its result's columns, and an error where there is no result or it has one."""
    error = F.when(F.col("_seen").isNull(), "no result returned")
    told = requests.select(key).join(results.withColumn("_seen", F.lit(True)), key, "left")
    return told.withColumn("error", F.coalesce(error, F.col("error")) if "error" in results.columns else error).drop("_seen")
