"""Quality rules over measurements: each is one plan for all runs at once and gives flags.

A flag is (scope columns, rule, severity, subject, n, detail). `scope` names what one verdict is about,
as a rule the run; rules never mix rows of different scopes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvlake.operators import asof, ordered

RED, AMBER, GREEN = "RED", "AMBER", "GREEN"
UNSPECIFIED = "(unspecified)"
LEAST_ROWS = 8
NOISE = 5.0
PH_TOLERANCE, PERCENT_TOLERANCE = 0.3, 10.0
SHORT_OF = 0.8
#: Counts that a message names at most.
NAMED = 10
#: Patterns that always compile.
SIMPLE = r"^\^?(?:(?:[^\\^$.|?*+()\[\]{}]|\.|\[[A-Za-z0-9 ]+\]|\((?:[^\\^$.|?*+()\[\]{}]|\.|\|)+\))[*+?]?|\|)+\$?$"
# Plausible ranges, columns of stated values, and the vocabulary.
BOUNDS = {"extract_pct": (0.0, 100.0), "recovery_pct": (0.0, 100.0), "ph": (-1.0, 14.0), "sf_pct": (0.0, float("inf"))}
Y_COLUMNS = {"Extract%": "extract_pct", "extract%": "extract_pct", "Recovery %": "recovery_pct", "recovery %": "recovery_pct", "recovery": "recovery_pct"}
X_COLUMNS = {"pH": "ph", "ph": "ph", "extractant_conc_mM": "extractant_mm", "extractant_conc": "extractant_mm"}
VOCABULARY = {
    "extractant_type": ["acidic", "basic", "neutral", "solvating", "chelating", "cation exchanger", "anion exchanger"],
    "mixing_method": ["shaking", "magnetic stirring", "mechanical stirring", "vortex", "orbital shaker"],
}
CURVE_KEYS = ("extractant_mm", "extract_temp_c", "acid_m", "leach_min", "strip_temp_c")


def label(c: str = "element") -> Column:
    return F.coalesce(c, F.lit(UNSPECIFIED))


def flags(df: DataFrame, scope: tuple[str, ...], rule: str, severity: str, subject: Column, n: Column, detail: Column) -> DataFrame:
    return df.select(*scope, F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), n.cast("long").alias("n"), detail.cast("string").alias("detail"))


def schema_conformance(runs: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """runs: scope, n_rows, coercion_failures."""
    bad = runs.filter("n_rows = 0 OR coercion_failures > 0")
    return flags(bad, scope, "schema_conformance", RED, F.lit(None), F.when(F.col("n_rows") == 0, 0).otherwise(F.col("coercion_failures")), F.when(F.col("n_rows") == 0, "no rows").otherwise("cells that are no numbers"))


def sparse_groups(df: DataFrame, keys: list[Column | str], least: int = LEAST_ROWS) -> DataFrame:
    """Groups of fewer rows than least."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") < least)


def row_count_sanity(df: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    few = sparse_groups(df, [*scope, label().alias("label")])
    return flags(few, scope, "row_count_sanity", RED, F.col("label"), F.col("n"), F.concat(F.lit(f"fewer than {LEAST_ROWS} points")))


def out_of_bounds(df: DataFrame, scope: tuple[str, ...], bounds: dict[str, tuple[float, float]], ordinal: str) -> DataFrame:
    """scope, column, n, example (the first by ordinal) of the columns with values outside their bounds."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for c, (lo, hi) in bounds.items()]))
    each = df.select(*scope, ordinal, cells.alias("c")).select(*scope, ordinal, "c.*").filter(~F.isnan("v") & ((F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi"))))
    return each.groupBy(*scope, "column").agg(F.count("*").alias("n"), F.min_by("v", ordinal).alias("example"))


def axis_bounds(df: DataFrame, scope: tuple[str, ...], ordinal: str = "row_ord") -> DataFrame:
    return flags(out_of_bounds(df, scope, BOUNDS, ordinal), scope, "axis_bounds", RED, F.col("column"), F.col("n"), F.concat(F.lit("e.g. "), F.col("example").cast("string")))


def curve_sizes(df: DataFrame, keys: list[Column | str]) -> DataFrame:
    """Rows of each group; a NULL key is a key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def matching_or_all(df: DataFrame, keys: list[str], hit: Column) -> DataFrame:
    """In each group the rows that hit, or all of them if none does."""
    told = df.withColumn("_hit", F.coalesce(hit, F.lit(False))).withColumn("_any", F.max("_hit").over(Window.partitionBy(*keys)))
    return told.filter("_hit OR NOT _any").drop("_hit", "_any")


def contains_pattern(text: Column, pattern: Column) -> Column:
    """Whether a text contains a pattern, in any case. The pattern is a regular expression if it is of simple
    shape (letters, dots, one level of brackets and groups, repetitions, alternatives), so that none can fail
    to compile; any other is looked for as it stands."""
    quoted = F.regexp_replace(pattern, r"([\\^$.|?*+()\[\]{}])", r"\\$1")
    return F.regexp(text, F.concat(F.lit("(?i)"), F.when(pattern.rlike(SIMPLE), pattern).otherwise(quoted)))


def reversals(df: DataFrame, keys: list[str], x: str, y: str, ordinal: str, noise: float = NOISE, most: int = ordered.MOST) -> DataFrame:
    """keys, n, ups, downs: steps along x that rise or fall by more than the noise. Curves of more than `most` points are
    walked part by part, and the steps between parts are taken from their first and last points."""
    at = ordered.parted(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, x, most)
    steps = at.rows.withColumn("_d", F.col(y) - F.lag(y).over(at.window(x, ordinal)))
    rise, fall = (lambda d: d > noise), (lambda d: d < -noise)
    counts = [F.count("*").alias("n"), F.count_if(rise(F.col("_d"))).alias("ups"), F.count_if(fall(F.col("_d"))).alias("downs")]
    if not at.cut:
        return steps.groupBy(*keys).agg(*counts)
    place = F.struct(F.col(x), F.col(ordinal))
    parts = steps.groupBy(*keys, ordered.PART).agg(*counts, F.min_by(y, place).alias("_head"), F.max_by(y, place).alias("_tail"))
    between = F.col("_head") - F.lag("_tail").over(Window.partitionBy(*keys).orderBy(ordered.PART))  # a row a part
    told = parts.withColumn("_d", between)
    more = lambda c, hit: (F.sum(c) + F.count_if(hit(F.col("_d")))).alias(c)
    return told.groupBy(*keys).agg(F.sum("n").alias("n"), more("ups", rise), more("downs", fall))


def monotonicity(df: DataFrame, scope: tuple[str, ...], ordinal: str = "row_ord") -> DataFrame:
    """Curves are rows of one element under the same fixed conditions; NULL conditions are a condition."""
    curves = reversals(df.withColumn("_label", label()), [*scope, "_label", *CURVE_KEYS], "ph", "extract_pct", ordinal)
    bad = curves.filter("n >= 4 AND ups >= 2 AND downs >= 2")
    return flags(bad, scope, "monotonicity", AMBER, F.col("_label"), F.col("ups") + F.col("downs"), F.concat_ws(" ", "ups", F.lit("rises,"), "downs", F.lit("falls")))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose keys are there more than once; rows with a NULL key are not compared."""
    counted = df.dropna(subset=keys).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    return counted.filter("_n > 1").drop("_n")


def duplicate_rows(df: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    keys = ["element", "ph", "extract_pct"]
    same = df.dropna(subset=keys).groupBy(*scope, *keys).agg(F.count("*").alias("k")).filter("k > 1").groupBy(*scope).agg(F.sum("k").alias("n"))
    return flags(same, scope, "duplicate_rows", AMBER, F.lit(None), F.col("n"), F.lit("same element, pH and extraction"))


def novel_values(df: DataFrame, scope: tuple[str, ...], column: str, known: list[str], ordinal: str) -> DataFrame:
    """scope, value, first ordinal of values that are not in the vocabulary, as written."""
    norm = F.lower(F.trim(F.col(column)))
    new = df.filter((norm != "") & ~norm.isin(known))
    return new.groupBy(*scope, F.col(column).alias("value")).agg(F.min(ordinal).alias("first"))


def vocabulary(df: DataFrame, scope: tuple[str, ...], ordinal: str = "row_ord") -> DataFrame:
    def rule(column: str, known: list[str]) -> DataFrame:
        new = novel_values(df, scope, column, known, ordinal).groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct("first", "value"))).alias("all"))
        return flags(new, scope, "vocabulary", AMBER, F.lit(column), F.size("all"), F.array_join("all.value", ", "))

    return reduce(DataFrame.unionByName, [rule(c, v) for c, v in VOCABULARY.items()])


def matched_elements(rows: DataFrame, wanted: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """scope, wanted, element: the elements of a scope's rows that each wanted pattern of the scope fits (as a
    case-insensitive pattern, or as text if it is no simple one), or all of them if it fits none or is blank. Each
    pattern meets each different element once, however many rows there are; NULL is an element."""
    names = rows.select(*scope, "element").distinct()
    asked = wanted.select(*scope, "wanted").distinct()
    met = asked.join(names, ordered.same(asked, names, list(scope), list(scope))).select(*[asked[c] for c in scope], "wanted", "element")
    fits = F.coalesce((F.col("wanted") == "") | contains_pattern(F.col("element"), F.col("wanted")), F.col("wanted").isNull())
    return matching_or_all(met, [*scope, "wanted"], fits)


def text_endpoints(df: DataFrame, endpoints: DataFrame, scope: tuple[str, ...], ordinal: str = "row_ord", ep: str = "endpoint_ord") -> DataFrame:
    """Stated values against digitised ones. An endpoint's element is matched as a case-insensitive pattern
    (as text if it is no simple one); if no row matches, all rows of the scope are taken."""
    x_of, y_of = (F.create_map(*[F.lit(v) for p in m.items() for v in p]) for m in (X_COLUMNS, Y_COLUMNS))
    stated = endpoints.withColumn("x_col", F.try_element_at(x_of, F.col("x_basis"))).withColumn("y_col", F.try_element_at(y_of, F.col("y_metric")))
    stated = stated.filter("x_col IS NOT NULL AND y_col IS NOT NULL AND x_value IS NOT NULL AND y_value IS NOT NULL")
    tolerance = F.when(F.col("x_col") == "ph", PH_TOLERANCE)  # others: the nearest
    stated = stated.select(*scope, ep, F.col("element").alias("wanted"), "x_col", "y_col", F.col("x_value").alias("x0"), F.col("y_value").alias("y0"), tolerance.alias("tolerance"))
    if stated.isEmpty():  # the joins below take several jobs
        none = F.lit(None)
        return flags(stated.limit(0), scope, "text_endpoint_cross_check", RED, none, none, none)
    elements = matched_elements(df, stated, scope).withColumnsRenamed({c: f"{c}_" for c in (*scope, "wanted")})
    under = stated.join(elements, ordered.same(stated, elements, [*scope, "wanted"], [*scope, "wanted"], "_")).drop(*[f"{c}_" for c in (*scope, "wanted")])
    place = lambda names: F.array(*[F.struct(F.lit(n).alias("col"), F.col(n).cast("double").alias("v")) for n in sorted(set(names.values()))])
    each = df.select(*scope, ordinal, "element", F.explode(place(X_COLUMNS)).alias("x"), place(Y_COLUMNS).alias("ys")).filter("x.v IS NOT NULL")
    points = each.select(*scope, "element", F.col("x.col").alias("x_col"), F.col("x.v").alias("x"), F.explode("ys").alias("y"), ordinal)
    points = points.select(*scope, "element", "x_col", F.col("y.col").alias("y_col"), "x", F.col("y.v").alias("y"), ordinal)
    best = asof.nearest(points, under, [*scope, "element", "x_col", "y_col"], [*scope, ep, "wanted"], ordinal)
    bad = best.filter(F.col("far") | (F.col("dy") > PERCENT_TOLERANCE))
    return flags(bad, scope, "text_endpoint_cross_check", RED, F.col("wanted"), F.col(ep), F.when(F.col("far"), "truncated curve").otherwise(F.concat(F.lit("off by "), F.col("dy").cast("string"))))


def rank_aligned(known: DataFrame, seen: DataFrame, scope: tuple[str, ...], n: str = "n") -> DataFrame:
    """scope, rank, known, seen: the i-th largest counts side by side, 0 where there are none left."""
    def ranked(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy(*scope).orderBy(F.desc(n))
        return df.select(*scope, F.row_number().over(w).alias("rank"), F.col(n).alias(name))

    return ranked(known, "known").join(ranked(seen, "seen"), [*scope, "rank"], "left").withColumn("seen", F.coalesce("seen", F.lit(0)))


def curve_counts(df: DataFrame, known: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """known: scope, n (markers of a series). Flags scopes that fall short of a known count."""
    seen = df.groupBy(*scope, label().alias("label")).agg(F.count("*").alias("n"))
    short = rank_aligned(known, seen, scope).filter(F.col("seen") < SHORT_OF * F.col("known")).groupBy(*scope).agg(F.count("*").alias("n"), F.min_by(F.struct("known", "seen"), "rank").alias("e"))
    named = seen.groupBy(*scope).agg(F.array_join(F.transform(F.slice(F.sort_array(F.collect_list("n"), asc=False), 1, NAMED), lambda x: x.cast("string")), ", ").alias("counts"))
    told = short.join(named, list(scope), "left")
    return flags(told, scope, "deterministic_curve_count", AMBER, F.lit(None), F.col("n"), F.concat_ws(" ", F.lit("expected"), "e.known", F.lit("got"), "e.seen", F.lit("of"), F.coalesce("counts", F.lit("none"))))


def run_rules(df: DataFrame, runs: DataFrame, endpoints: DataFrame | None = None, known: DataFrame | None = None, scope: tuple[str, ...] = ("custom_id",), figure_is_curve: bool = True) -> DataFrame:
    """All flags. runs: scope, n_rows, coercion_failures. Runs without rows get their first flag only, as they
    have nothing that another rule could look at."""
    found = [schema_conformance(runs, scope)]
    if figure_is_curve:
        found.append(row_count_sanity(df, scope))
    found += [axis_bounds(df, scope), monotonicity(df, scope), duplicate_rows(df, scope), vocabulary(df, scope)]
    if endpoints is not None:
        found.append(text_endpoints(df, endpoints, scope))
    if known is not None:
        found.append(curve_counts(df, known.join(df.select(*scope).distinct(), list(scope), "left_semi"), scope))
    return reduce(DataFrame.unionByName, found)


def severity_rank(c: Column) -> Column:
    return F.when(c == RED, 2).when(c == AMBER, 1).otherwise(0)


def verdicts(runs: DataFrame, flags_: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """scope, verdict, passed, report (JSON of the flags) for every run."""
    each = F.struct("rule", "severity", "subject", "n", "detail")
    told = flags_.groupBy(*scope).agg(F.max(severity_rank(F.col("severity"))).alias("r"), F.to_json(F.array_sort(F.collect_list(each))).alias("report"))
    rank = F.coalesce("r", F.lit(0))
    verdict = F.element_at(F.array(F.lit(GREEN), F.lit(AMBER), F.lit(RED)), rank + 1)
    return runs.select(*scope).distinct().join(told, list(scope), "left").select(*scope, verdict.alias("verdict"), (rank < 2).alias("passed"), F.coalesce("report", F.lit("[]")).alias("report"))


REPORT = "array<struct<rule: string, severity: string, subject: string, n: bigint, detail: string>>"


def read_report(report: Column) -> Column:
    """The flags of a report that verdicts() wrote; none if it is NULL or no report."""
    return F.coalesce(F.from_json(report, REPORT), F.array().cast(REPORT))
