"""One query for each operator over the driver's tables, with its SQL.

The tables stand in for the measurement tables: orders are extraction runs (customer: paper, priority:
version, status F/P/O: approved, pending, rejected), line items are their rows, documents are papers by
content hash, events are curve points (user and type: series) and hold JSON payloads.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from solvlake.functions import chem, text
from solvlake.operators import asof, curves, figures, qa, ranges, versions
from solvlake.plans import guard
from solvlake.schema import CONTRACT, NAMES, conform, failed, number
from solvlake.sources import files
from solvlake.sources.responses import outcomes, parse, results_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, if its scan has fewer, for work on each row that costs more than
    sending it; a table of many files is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def runs(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "pending").otherwise("rejected")
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("prompt_run_id"), F.col("o_custkey").alias("paper_id"), F.col("o_orderpriority").alias("prompt_version"), F.col("o_orderdate").alias("reviewed_at"), status.alias("status"), F.col("o_totalprice").alias("cost"))


def rows(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "prompt_run_id")


def points(spark: SparkSession, sf: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return t(spark, sf, "events").select("event_id", "user_id", "event_type", micros.alias("x"), F.col("value").alias("y"))


BEST = "best AS (SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC NULLS LAST, o_orderdate DESC NULLS LAST, o_orderkey DESC NULLS LAST) AS rn FROM orders WHERE o_orderstatus = 'F') WHERE rn = 1)"
E_POINTS = "p AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS x, value AS y FROM events)"


# --- versions, scans, joins ---


@query(f"WITH {BEST} SELECT o_custkey AS paper_id, count(*) AS n_rows, min(l_extendedprice) AS price_min, median(l_extendedprice) AS price_median, max(l_extendedprice) AS price_max FROM lineitem JOIN best ON l_orderkey = o_orderkey GROUP BY 1")
def w1_current_best_ranges(spark: SparkSession, sf: str) -> DataFrame:
    best = versions.best_runs(runs(spark, sf)).select("prompt_run_id", "paper_id")
    found = rows(spark, sf).select("prompt_run_id", "l_extendedprice").join(best, "prompt_run_id")
    return found.groupBy("paper_id").agg(F.count("*").alias("n_rows"), *[f("l_extendedprice").alias(f"price_{k}") for k, f in (("min", F.min), ("median", F.median), ("max", F.max))])


@query(f"WITH {BEST} SELECT l_orderkey AS prompt_run_id, l_partkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM best)")
def j1_current_best_rows(spark: SparkSession, sf: str) -> DataFrame:
    return versions.current_best(rows(spark, sf), runs(spark, sf)).select("prompt_run_id", "l_partkey", "l_linenumber", "l_extendedprice")


@query("SELECT o_orderkey AS prompt_run_id, c_custkey AS paper_id, c_name, o_orderpriority AS prompt_version FROM orders JOIN customer ON o_custkey = c_custkey")
def j2_run_history(spark: SparkSession, sf: str) -> DataFrame:
    papers = t(spark, sf, "customer").select(F.col("c_custkey").alias("paper_id"), "c_name")
    return versions.history(runs(spark, sf), papers, "prompt_run_id").select("prompt_run_id", "paper_id", "c_name", "prompt_version")


@query(f"WITH {BEST} SELECT c_custkey AS paper_id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS approved_runs, (SELECT count(*) FROM lineitem JOIN best ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) AS current_best_rows FROM customer")
def j3_paper_list(spark: SparkSession, sf: str) -> DataFrame:
    papers = t(spark, sf, "customer").select(F.col("c_custkey").alias("paper_id"))
    all_runs = runs(spark, sf)
    best = rows(spark, sf).select("prompt_run_id").join(versions.best_runs(all_runs).select("prompt_run_id", "paper_id"), "prompt_run_id")
    return versions.paper_list(papers, all_runs.filter("status = 'approved'"), best)


@query("WITH n AS (SELECT e.event_id, e.user_id, e.event_type, p.event_id AS o, abs(epoch_us(e.ts) - epoch_us(p.ts)) AS dx, abs(e.value * 1.05 - p.value) AS dy, p.value AS y FROM events e JOIN events p USING (user_id, event_type) WHERE e.event_id % 20 = 0), m AS (SELECT *, min(dx) OVER (PARTITION BY event_id) AS min_dx FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY dy, o) AS r FROM m WHERE dx <= 21600000000) SELECT event_id, min_dx::DOUBLE AS min_dx, y, dy FROM k WHERE r = 1")
def j4_nearest_point(spark: SparkSession, sf: str) -> DataFrame:
    all_points = points(spark, sf).withColumnRenamed("event_id", "ordinal")
    stated = points(spark, sf).filter("event_id % 20 = 0").select("event_id", "user_id", "event_type", F.col("x").alias("x0"), (F.col("y") * 1.05).alias("y0"), F.lit(21_600_000_000).alias("tolerance"))
    found = asof.nearest(all_points, stated, ["user_id", "event_type"], ["event_id"], "ordinal").filter("NOT far")
    return found.select("event_id", F.col("min_dx").cast("double").alias("min_dx"), "y", "dy")


@query("WITH k AS (SELECT doc_id, sha256(text) AS sha, source || ':' || lang AS doi FROM documents), h AS (SELECT sha, min(doc_id) AS i FROM k GROUP BY 1), o AS (SELECT lower(trim(doi)) AS doi, min(doc_id) AS i FROM k WHERE doi IS NOT NULL GROUP BY 1) SELECT d.doc_id, coalesce(h.i, o.i)::DOUBLE AS match_id, CASE WHEN h.i IS NOT NULL THEN 'content_hash' WHEN o.i IS NOT NULL THEN 'doi' END AS reason FROM documents d LEFT JOIN h ON h.sha = sha256(lower(d.text)) LEFT JOIN o ON o.doi = lower(trim(d.source || ':' || d.lang))")
def j5_find_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Every document, in lower case, is looked up among all documents."""
    docs = t(spark, sf, "documents")
    doi = F.when(F.col("source").isNotNull() & F.col("lang").isNotNull(), F.concat_ws(":", "source", "lang")).alias("doi")
    known = docs.select(F.col("doc_id").alias("paper_id"), F.sha2("text", 256).alias("content_sha256"), doi)
    incoming = docs.select("doc_id", F.sha2(F.lower("text"), 256).alias("content_sha256"), doi)
    return versions.find_duplicates(incoming, known).select("doc_id", F.col("match_id").cast("double").alias("match_id"), "reason")


@query("WITH g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), k AS (SELECT user_id, n + 2 AS n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS rank FROM g WHERE event_type <> 'click'), s AS (SELECT user_id, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS rank FROM g WHERE event_type <> 'view') SELECT k.user_id, k.rank::INT AS rank, k.n AS known, coalesce(s.n, 0) AS seen FROM k LEFT JOIN s USING (user_id, rank)")
def j6_rank_aligned_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = t(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return qa.rank_aligned(counts.filter("event_type <> 'click'").withColumn("n", F.col("n") + 2), counts.filter("event_type <> 'view'"), ("user_id",))


MASS_SQL = "m(k, element, mass) AS (VALUES " + ", ".join(f"({i}, '{e}', {m}::DOUBLE)" for i, (e, m) in enumerate(chem.ATOMIC_MASS.items())) + ")"


def elements(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*map(F.lit, chem.ATOMIC_MASS))
    return t(spark, sf, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % 25).cast("int")).alias("element"), F.col("p_retailprice").alias("feed"), F.col("p_size").cast("double").alias("size"))


@query(f"WITH {MASS_SQL} SELECT p_partkey, m.element, mass FROM part LEFT JOIN m ON p_partkey % 25 = m.k")
def j7_atomic_mass(spark: SparkSession, sf: str) -> DataFrame:
    found = elements(spark, sf)
    return found.join(F.broadcast(chem.masses(spark)), "element", "left").select("p_partkey", "element", "mass")  # 23 rows


@query("SELECT p_brand AS value, min(p_partkey) AS first FROM part WHERE lower(trim(p_brand)) NOT IN ('brand#11', 'brand#12', 'brand#13') AND trim(p_brand) <> '' GROUP BY 1")
def j8_novel_values(spark: SparkSession, sf: str) -> DataFrame:
    return qa.novel_values(t(spark, sf, "part"), (), "p_brand", ["brand#11", "brand#12", "brand#13"], "p_partkey")


@query("SELECT o_orderkey AS prompt_run_id, coalesce(n, 0) AS n_rows, CASE WHEN n IS NULL THEN 'no result returned' END AS error FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def j10_results_of_requests(spark: SparkSession, sf: str) -> DataFrame:
    results = rows(spark, sf).groupBy("prompt_run_id").agg(F.count("*").alias("n_rows"))
    return results_of(runs(spark, sf), results, "prompt_run_id").na.fill(0, ["n_rows"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j11_staged_without_commit(spark: SparkSession, sf: str) -> DataFrame:
    from solvlake.streaming.ingest import pending

    committed = runs(spark, sf).filter("status = 'approved'").select(F.col("paper_id").alias("c_custkey"))
    return pending(t(spark, sf, "customer").select("c_custkey"), committed, "c_custkey")


# --- projections and coercion ---

MESSY = "CASE event_id % 8 WHEN 0 THEN value::VARCHAR WHEN 1 THEN ' ' || event_id || ' ' WHEN 2 THEN event_id || 'd' WHEN 3 THEN event_id || '%' WHEN 4 THEN '' WHEN 5 THEN 'abc' WHEN 6 THEN NULL ELSE '1e3' END"


def messy(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    cell = F.when(e % 8 == 0, F.col("value").cast("string")).when(e % 8 == 1, F.concat(F.lit(" "), e.cast("string"), F.lit(" "))).when(e % 8 == 2, F.concat(e.cast("string"), F.lit("d"))).when(e % 8 == 3, F.concat(e.cast("string"), F.lit("%"))).when(e % 8 == 4, "").when(e % 8 == 5, "abc").when(e % 8 == 7, "1e3")
    return t(spark, sf, "events").select("event_id", "event_type", cell.alias("cell"))


@query(f"SELECT event_id, try_cast(nullif(trim(c), '') AS DOUBLE) AS v FROM (SELECT event_id, {MESSY} AS c FROM events)")
def p2_numeric_coercion(spark: SparkSession, sf: str) -> DataFrame:
    return messy(spark, sf).select("event_id", number(F.col("cell")).alias("v"))


@query(f"SELECT event_type, sum(CASE WHEN c IS NOT NULL AND c <> '' AND try_cast(trim(c) AS DOUBLE) IS NULL THEN 1 ELSE 0 END)::BIGINT AS failures FROM (SELECT event_type, {MESSY} AS c FROM events) GROUP BY 1")
def a9_coercion_failures(spark: SparkSession, sf: str) -> DataFrame:
    return messy(spark, sf).groupBy("event_type").agg(F.sum(failed(F.col("cell"))).alias("failures"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders")
def s12_nan_to_null(spark: SparkSession, sf: str) -> DataFrame:
    from solvlake.schema import nan_to_null

    v = F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return t(spark, sf, "orders").select("o_orderkey", nan_to_null(v).alias("v"))


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#11', 'Brand#22')")
def p8_chosen(spark: SparkSession, sf: str) -> DataFrame:
    return versions.included_rows(t(spark, sf, "part"), "p_brand", ["Brand#11", "Brand#22"]).select("p_partkey", "p_brand")


@query("WITH m AS (SELECT user_id, event_type, event_id, event_type ILIKE '%SIGN%' AS hit, bool_or(event_type ILIKE '%SIGN%') OVER (PARTITION BY user_id) AS any_hit FROM events) SELECT user_id, event_id FROM m WHERE hit OR NOT any_hit")
def p10_pattern_or_all(spark: SparkSession, sf: str) -> DataFrame:
    return qa.matching_or_all(t(spark, sf, "events"), ["user_id"], qa.contains_pattern(F.col("event_type"), F.lit("SIGN"))).select("user_id", "event_id")


@query("SELECT json_extract_string(props, '$.k')::DOUBLE AS k, count(*) AS n FROM events GROUP BY 1")
def f6_json_field(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").groupBy(F.try_variant_get(F.try_parse_json("props"), "$.k", "double").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT event_id::VARCHAR AS custom_id, CASE WHEN event_id % 7 = 0 THEN 'no JSON object' END AS error, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 2 END::BIGINT AS n_rows, CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END::BIGINT AS coercion_failures FROM events")
def f5_parse_responses(spark: SparkSession, sf: str) -> DataFrame:
    body = F.concat(F.lit('shown work {"a": 1} ```json\n{"rows": [{"pH": '), F.col("value").cast("string"), F.lit(', "Extract%": "garbled"}, {"Extractant": "D2EHPA", "pH": "2.5"}], "text_endpoints": []}\n``` end'))
    said = t(spark, sf, "events").select(F.col("event_id").cast("string").alias("custom_id"), F.when(F.col("event_id") % 7 == 0, "nothing here").otherwise(body).alias("raw_text"))
    said = spread(said)
    return parse(said)[2]


@query("SELECT event_id::VARCHAR AS custom_id, unnest([0, 1])::INT AS row_ord, unnest([value, 2.5]) AS ph, unnest([NULL, 'D2EHPA']) AS extractant FROM events WHERE event_id % 7 <> 0")
def f7_parsed_rows(spark: SparkSession, sf: str) -> DataFrame:
    body = F.concat(F.lit('{"rows": [{"pH": '), F.col("value").cast("string"), F.lit(', "Extract%": "garbled"}, {"Extractant": "D2EHPA", "pH": "2.5"}]}'))
    said = t(spark, sf, "events").select(F.col("event_id").cast("string").alias("custom_id"), F.when(F.col("event_id") % 7 == 0, "nothing here").otherwise(body).alias("raw_text"))
    said = spread(said)
    return parse(said)[0].select("custom_id", "row_ord", "ph", "extractant")


SHAPES = ["\"rows\": null", "\"rows\": {}", "\"rows\": []", "\"other\": 1", "\"rows\": \"x\"", "\"rows\": 5", "\"rows\": [{\"pH\": 1}, 7]", "\"rows\": [{\"pH\": 1}], \"text_endpoints\": 5", "\"rows\": [{\"pH\": 1}], \"text_endpoints\": [7, {\"element\": \"La\", \"x_value\": \"3\"}, null]"]


@query("SELECT event_id::VARCHAR AS custom_id, CASE WHEN k IN (4, 5) THEN 'rows is not a list' WHEN k = 6 THEN 'row is not an object' END AS error, (k >= 7)::BIGINT AS n_rows, (k = 8)::BIGINT AS n_endpoints FROM (SELECT event_id, event_id % 9 AS k FROM events)")
def f6b_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Responses whose rows are missing, null, empty or no list, or hold what is no object, and such endpoints."""
    body = F.concat(F.lit("{"), F.get(F.array(*map(F.lit, SHAPES)), (F.col("event_id") % len(SHAPES)).cast("int")), F.lit("}"))
    said = spread(t(spark, sf, "events").select(F.col("event_id").cast("string").alias("custom_id"), body.alias("raw_text")))
    _, endpoints, summary = parse(said)
    counted = endpoints.groupBy("custom_id").agg(F.count("*").alias("n_endpoints"))
    return summary.join(counted, "custom_id", "left").select("custom_id", "error", "n_rows", F.coalesce("n_endpoints", F.lit(0)).cast("long").alias("n_endpoints"))


@query("WITH k AS (SELECT doc_id, sha256(text) AS sha, '10.' || (1000 + doc_id // 3) || '/x' AS doi FROM documents), latest AS (SELECT max(doc_id) AS i FROM documents) SELECT how, min(doc_id) AS paper_id FROM (SELECT 'id' AS how, doc_id FROM k WHERE doc_id = (SELECT i FROM latest) UNION ALL SELECT 'hash', doc_id FROM k WHERE sha = (SELECT sha FROM k WHERE doc_id = (SELECT i FROM latest)) UNION ALL SELECT 'doi', doc_id FROM k WHERE doi = (SELECT doi FROM k WHERE doc_id = (SELECT i FROM latest))) GROUP BY 1")
def s5_lookups(spark: SparkSession, sf: str) -> DataFrame:
    """The last document, looked up by its id, by its content, and by its DOI in another case."""
    papers = t(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.sha2("text", 256).alias("content_sha256"), F.concat(F.lit("10."), (F.floor(F.col("doc_id") / 3) + 1000).cast("string"), F.lit("/x")).alias("doi"))
    one = papers.orderBy(F.desc("paper_id")).first()
    found = {"id": versions.lookup(papers, paper_id=one.paper_id), "hash": versions.lookup(papers, content_sha256=one.content_sha256), "doi": versions.lookup(papers, doi=f" {one.doi.upper()} "), "none": versions.lookup(papers, doi=" ")}
    return reduce(DataFrame.unionByName, [df.select(F.lit(how).alias("how"), "paper_id") for how, df in found.items()])


@query("SELECT user_id, event_type AS series, round(event_id, (3 - floor(log10(event_id)))::INT) AS x, round(value, (3 - floor(log10(value)))::INT) AS y FROM events WHERE event_id > 0 AND value > 0")
def p22_points_json(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's points as the JSON that a reader gets, read back."""
    marks = t(spark, sf, "events").filter("event_id > 0 AND value > 0").select("user_id", F.col("event_type").alias("group_key"), F.lit("filled").alias("marker_type"), F.col("event_id").cast("double").alias("data_x"), F.col("value").alias("data_y"))
    told = curves.points_json(marks, ["user_id"]).select("user_id", F.explode(F.from_json("points", "map<string, array<array<double>>>")).alias("series", "points"))
    return told.select("user_id", "series", F.explode("points").alias("p")).select("user_id", "series", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND NOT (l_quantity + 0.5 BETWEEN 20 AND 30 AND l_linenumber + 0.5 BETWEEN 2 AND 5)")
def p15_legend_box(spark: SparkSession, sf: str) -> DataFrame:
    """Filled curves outside the legend's box."""
    box = F.struct(F.lit(20.0).alias("x0"), F.lit(2.0).alias("top"), F.lit(30.0).alias("x1"), F.lit(5.0).alias("bottom"))
    q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")
    objects = t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.lit("curve").alias("kind"), (q > 10).alias("fill"), q.alias("x0"), (q + 1).alias("x1"), n.alias("top"), (n + 1).alias("bottom"), box.alias("legend"))
    return curves.filled_markers(objects).select("l_orderkey", "l_partkey", "l_linenumber")


# --- aggregates ---


@query("SELECT (SELECT count(*) FROM customer) AS papers, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS approved, (SELECT count(*) FROM lineitem) AS n_rows")
def a1_counts(spark: SparkSession, sf: str) -> DataFrame:
    return versions.totals(t(spark, sf, "customer"), runs(spark, sf), rows(spark, sf))


@query("SELECT l_orderkey AS prompt_run_id, coalesce(nullif(l_returnflag, 'N'), '(unspecified)') AS label, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) < 8")
def a2_sparse_groups(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.coalesce(F.nullif("l_returnflag", F.lit("N")), F.lit(qa.UNSPECIFIED)).alias("label")
    return qa.sparse_groups(rows(spark, sf), ["prompt_run_id", flag])


@query("SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber::DOUBLE END AS k, l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def a3_null_groups(spark: SparkSession, sf: str) -> DataFrame:
    return qa.curve_sizes(rows(spark, sf), [F.when(F.col("l_linenumber") != 7, F.col("l_linenumber").cast("double")).alias("k"), "l_returnflag", "l_linestatus"])


@query(f"WITH {E_POINTS}, d AS (SELECT *, y - lag(y) OVER (PARTITION BY user_id, event_type ORDER BY x, event_id) AS dy FROM p) SELECT user_id, event_type, count(*) AS n, count(*) FILTER (dy > 5) AS ups, count(*) FILTER (dy < -5) AS downs FROM d GROUP BY 1, 2 HAVING count(*) >= 4 AND count(*) FILTER (dy > 5) >= 2 AND count(*) FILTER (dy < -5) >= 2")
def w2_monotonicity(spark: SparkSession, sf: str) -> DataFrame:
    return qa.reversals(points(spark, sf), ["user_id", "event_type"], "x", "y", "event_id").filter("n >= 4 AND ups >= 2 AND downs >= 2")


@query("SELECT user_id, 'value' AS \"column\", count(*) AS n, arg_min(value, event_id) AS example FROM events WHERE value < 0 OR value > 100 GROUP BY 1")
def a5_out_of_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return qa.out_of_bounds(t(spark, sf, "events"), ("user_id",), {"value": (0.0, 100.0)}, "event_id")


@query("SELECT p_brand, count(DISTINCT l_suppkey) AS n_papers, count(*) AS n_rows, min(l_quantity) AS q_min, median(l_quantity) AS q_median, max(l_quantity) AS q_max FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type ILIKE '%o%' GROUP BY 1")
def a6_ranges_by_brand(spark: SparkSession, sf: str) -> DataFrame:
    parts = t(spark, sf, "part").filter(F.ilike("p_type", F.lit("%o%"))).select("p_partkey", "p_brand")
    found = rows(spark, sf).select("l_partkey", "l_suppkey", "l_quantity").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return ranges.summary(found, "l_suppkey", {"q": "l_quantity"}, ("p_brand",))


@query("SELECT count(DISTINCT l_suppkey) AS n_papers, count(*) AS n_rows, min(l_tax) AS ph_min, median(l_tax) AS ph_median, max(l_tax) AS ph_max, min(l_quantity) AS conc_min, median(l_quantity) AS conc_median, max(l_quantity) AS conc_max, min(l_discount) AS extract_pct_min, median(l_discount) AS extract_pct_median, max(l_discount) AS extract_pct_max FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#12' AND p_type ILIKE '%e%' HAVING count(*) > 0")
def p6_typical_ranges(spark: SparkSession, sf: str) -> DataFrame:
    parts = t(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("extractant"), F.col("p_type").alias("element"))
    best = rows(spark, sf).join(parts, F.col("l_partkey") == F.col("p_partkey")).select("extractant", "element", F.col("l_suppkey").alias("paper_id"), F.col("l_tax").alias("ph"), F.col("l_quantity").alias("extractant_mm"), F.col("l_discount").alias("extract_pct"))
    return ranges.typical_ranges(best, "Brand#12", "E")


@query("WITH r AS (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part WHERE p_size <= 25 GROUP BY 1) SELECT p_partkey, coalesce(p_retailprice < lo OR p_retailprice > hi, false) AS warn FROM part LEFT JOIN r USING (p_brand)")
def p23_target_outside(spark: SparkSession, sf: str) -> DataFrame:
    parts = t(spark, sf, "part")
    known = parts.filter("p_size <= 25").groupBy("p_brand").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return parts.join(known, "p_brand", "left").select("p_partkey", ranges.outside(F.col("p_retailprice"), F.col("lo"), F.col("hi")).alias("warn"))


@query("SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL")
def a7_distinct_extractants(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.extractants(t(spark, sf, "part"), "p_brand")


@query("WITH g AS (SELECT user_id % 30 AS pdf, count(event_id) AS n_pages, count(*) FILTER (event_type IN ('click', 'view')) AS n_images, count(*) FILTER (value > 50) AS n_texts FROM events GROUP BY 1) SELECT *, CASE WHEN n_images > 0 AND n_images >= n_texts THEN 1 ELSE 0 END::INT AS is_raster_figure FROM g")
def a10_raster_verdict(spark: SparkSession, sf: str) -> DataFrame:
    pages = t(spark, sf, "events").select((F.col("user_id") % 30).alias("pdf"), F.col("event_type").isin("click", "view").alias("has_image"), (F.col("value") > 50).alias("has_text"))
    return files.inspect(pages)


SERIES = "s AS (SELECT user_id AS page_index, event_type, count(*) AS n FROM events GROUP BY 1, 2)"


def series(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("pdf"), F.col("user_id").alias("page_index"), "event_type").agg(F.count("*").alias("n"))


@query(f"WITH {SERIES}, g AS (SELECT page_index % 10 AS pdf, page_index, list_sort(list(n), 'DESC') AS c, sum(n) AS total FROM s GROUP BY 1, 2) SELECT pdf, page_index, array_to_string(c, ',') AS series_counts, CASE WHEN c[1] - c[len(c)] <= 0.15 * list_sort(c)[len(c) // 2 + 1] THEN 'confident' ELSE 'unverified' END AS status FROM g WHERE len(c) >= 2 AND total >= 24")
def e13_prepass(spark: SparkSession, sf: str) -> DataFrame:
    return curves.prepass(series(spark, sf)).withColumn("series_counts", F.array_join(F.transform("series_counts", lambda x: x.cast("string")), ","))


@query(f"WITH {SERIES}, m AS (SELECT *, median(n) OVER (PARTITION BY page_index) AS median, count(*) OVER (PARTITION BY page_index) AS k FROM s) SELECT page_index, event_type, n, median FROM m WHERE k >= 3 AND n < 0.6 * median")
def a13_low_outliers(spark: SparkSession, sf: str) -> DataFrame:
    return curves.low_outliers(series(spark, sf).drop("pdf"), ["page_index"])


@query("SELECT l_partkey, round(0.1 * median(sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber)), 9) AS eps FROM lineitem GROUP BY 1")
def a15_epsilon(spark: SparkSession, sf: str) -> DataFrame:
    glyphs = rows(spark, sf).select("l_partkey", F.col("l_quantity").alias("width"), F.col("l_linenumber").alias("height"))
    return curves.epsilons(glyphs, ["l_partkey"]).withColumn("eps", F.round("eps", 9))

FIT = """WITH t AS (SELECT user_id, event_type AS axis, event_id::DOUBLE AS x, value AS v FROM events),
f AS (SELECT user_id, axis, count(*) AS n, min(v) AS lo, max(v) AS hi, coalesce(regr_slope(v, x), 0) AS s1, coalesce(regr_intercept(v, x), avg(v)) AS i1, coalesce(regr_slope(log10(v), x), 0) AS s2, coalesce(regr_intercept(log10(v), x), avg(log10(v))) AS i2 FROM t GROUP BY 1, 2 HAVING count(*) >= 2),
e AS (SELECT user_id, axis, n, lo, hi, s1, i1, s2, i2, sqrt(avg((v - (s1 * x + i1)) ** 2)) AS r1, sqrt(avg((v - 10 ** (s2 * x + i2)) ** 2)) AS r2 FROM t JOIN f USING (user_id, axis) GROUP BY ALL)
SELECT user_id, axis, CASE WHEN lo > 0 AND r2 < r1 THEN 'log10' ELSE 'linear' END AS model, round(CASE WHEN lo > 0 AND r2 < r1 THEN s2 ELSE s1 END, 6) AS slope, round(CASE WHEN lo > 0 AND r2 < r1 THEN r2 ELSE r1 END, 6) AS rms, n AS n_ticks, (CASE WHEN lo > 0 AND r2 < r1 THEN r2 ELSE r1 END) <= 0.02 * (CASE WHEN hi > lo THEN hi - lo ELSE 1 END) AS ok FROM e"""


@query(FIT)
def a16_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Every user and type of event is an axis."""
    ticks = t(spark, sf, "events").select("user_id", F.col("event_type").alias("axis"), F.col("event_id").cast("double").alias("pixel"), "value")
    return curves.calibrate(ticks, ["user_id", "axis"]).select("user_id", "axis", "model", F.round("slope", 6).alias("slope"), F.round("rms", 6).alias("rms"), "n_ticks", "ok")


@query("SELECT o_custkey AS page, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS x0 FROM orders WHERE o_totalprice > 2500 GROUP BY 1")
def a17_largest_rectangle(spark: SparkSession, sf: str) -> DataFrame:
    side = F.sqrt("o_totalprice")
    rects = t(spark, sf, "orders").select(F.col("o_custkey").alias("page"), F.lit("rect").alias("kind"), F.lit(False).alias("fill"), F.col("o_orderkey").alias("x0"), F.lit(0).alias("top"), F.lit(0).alias("x1"), F.lit(0).alias("bottom"), side.alias("width"), side.alias("height"))
    return curves.plot_frames(rects, ["page"]).select("page", "frame.x0")


@query("SELECT conv_id, sum(length(text))::BIGINT AS total, sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END)::BIGINT AS cached, (round_even(100.0 * sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) / nullif(sum(length(text)), 0), 0))::BIGINT || '%' AS share FROM conversations GROUP BY 1")
def a20_cached_share(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text")
    sums = t(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(n).alias("total"), F.sum(F.when(F.col("role") == "user", n).otherwise(0)).alias("cached"))
    return sums.withColumn("share", text.share_text(F.col("cached"), F.col("total")))


@query("WITH f AS (SELECT l_orderkey AS run, max(CASE WHEN l_quantity > 49 THEN 2 WHEN l_quantity > 45 THEN 1 ELSE 0 END) AS r FROM lineitem WHERE l_quantity > 45 GROUP BY 1) SELECT o_orderkey AS run, CASE coalesce(r, 0) WHEN 2 THEN 'RED' WHEN 1 THEN 'AMBER' ELSE 'GREEN' END AS verdict, coalesce(r, 0) < 2 AS passed FROM orders LEFT JOIN f ON o_orderkey = run")
def a21_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    base = rows(spark, sf).select(F.col("prompt_run_id").alias("run"), "l_quantity", "l_linenumber")
    found = qa.flags(base.filter("l_quantity > 49"), ("run",), "bounds", qa.RED, F.lit("q"), F.col("l_linenumber"), F.lit("")).unionByName(qa.flags(base.filter("l_quantity > 45"), ("run",), "warn", qa.AMBER, F.lit("q"), F.col("l_linenumber"), F.lit("")))
    return qa.verdicts(runs(spark, sf).select(F.col("prompt_run_id").alias("run")), found, ("run",)).select("run", "verdict", "passed")


@query("SELECT user_id, arg_min(value, event_id) FILTER (value > 20) AS first_value FROM events GROUP BY 1")
def a22_first_known(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("value") > 20, F.col("value"))
    return versions.first_known(t(spark, sf, "events"), ["user_id"], v, "event_id", "first_value")


@query(f"WITH {SERIES}, g AS (SELECT page_index % 10 AS pdf, list_sort(list(n), 'DESC') AS c, sum(n) AS total FROM s GROUP BY page_index), k AS (SELECT pdf, unnest(c) AS n FROM g WHERE len(c) >= 2 AND total >= 24 AND c[1] - c[len(c)] <= 0.15 * list_sort(c)[len(c) // 2 + 1]) SELECT pdf, string_agg(n, ',' ORDER BY n DESC) AS counts FROM k GROUP BY 1")
def a24_authoritative_counts(spark: SparkSession, sf: str) -> DataFrame:
    return curves.authoritative(curves.prepass(series(spark, sf))).select("pdf", F.array_join(F.transform("counts", lambda x: x.cast("string")), ",").alias("counts"))


# --- windows, sorts ---


@query("SELECT l_orderkey, l_partkey, l_quantity, l_linenumber FROM (SELECT *, count(*) OVER (PARTITION BY l_returnflag, l_quantity, l_discount, l_shipdate) AS k FROM lineitem) WHERE k > 1")
def w3_duplicate_rows(spark: SparkSession, sf: str) -> DataFrame:
    return qa.repeated(t(spark, sf, "lineitem"), ["l_returnflag", "l_quantity", "l_discount", "l_shipdate"]).select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber")


BANDS = "b AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY y, event_id) AS band FROM (SELECT event_id, user_id, value AS y, event_id / 100.0 AS x, CASE WHEN value - lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) > 8 THEN 1 ELSE 0 END AS brk FROM events))"


@query(f"WITH {BANDS} SELECT user_id, band::BIGINT AS band, count(*) AS n FROM b GROUP BY 1, 2")
def w5_bands(spark: SparkSession, sf: str) -> DataFrame:
    return curves.bands(t(spark, sf, "events"), ["user_id"], "value", "event_id").groupBy("user_id", "band").agg(F.count("*").alias("n"))


@query(f"WITH {BANDS}, g AS (SELECT *, x - lag(x) OVER (PARTITION BY user_id, band ORDER BY x, event_id) AS d FROM b), m AS (SELECT user_id, band, count(*) AS n, median(d) AS gap FROM g GROUP BY 1, 2) SELECT b.user_id, b.event_id FROM b LEFT JOIN m ON b.user_id = m.user_id AND b.band = m.band AND n >= 8 AND gap < 36 WHERE m.n IS NULL")
def w6_without_text_rows(spark: SparkSession, sf: str) -> DataFrame:
    blobs = t(spark, sf, "events").withColumn("x", F.col("event_id") / 100.0)
    return curves.without_text_rows(blobs, ["user_id"], "event_id", "x", "value").select("user_id", "event_id")


@query("SELECT DISTINCT user_id, axis, pixel FROM (SELECT user_id, event_type AS axis, value AS pixel, count(DISTINCT value) OVER (PARTITION BY user_id, event_type) AS k FROM (SELECT DISTINCT user_id, event_type, value FROM events)) WHERE k >= 3")
def l5_ticks(spark: SparkSession, sf: str) -> DataFrame:
    ticks = t(spark, sf, "events").select("user_id", F.col("event_type").alias("axis"), F.col("value").alias("pixel"))
    return curves.enough_ticks(ticks, ["user_id", "axis"]).orderBy("user_id", "axis", "pixel")


# --- scalar functions ---


@query("SELECT doc_id, sha256(text) AS content_sha256 FROM documents")
def f4_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_sha256"))


@query("SELECT page_id, '10.' || (1000 + page_id) || '/abc.' || page_id || '-x' AS doi FROM pages")
def f1_doi(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.lit("see "), F.col("url"), F.lit(" DOI 10."), (F.col("page_id") + 1000).cast("string"), F.lit("/ABC."), F.col("page_id").cast("string"), F.lit("-X). and on"))
    return t(spark, sf, "pages").select("page_id", text.find_doi(said).alias("doi"))


@query(f"WITH {MASS_SQL} SELECT p_partkey, p_retailprice / mass AS mm, p_retailprice * mass AS ppm, p_retailprice / mass * p_size AS conc, (p_retailprice / mass) * (p_size / 1000.0) * mass AS mg, CASE WHEN p_size > 0 THEN p_retailprice / p_size END AS litres FROM part LEFT JOIN m ON p_partkey % 25 = m.k")
def f9_conversions(spark: SparkSession, sf: str) -> DataFrame:
    feed, size, mass = F.col("feed"), F.col("size"), chem.mass_of(F.col("element"))
    mm = chem.ppm_to_mm(feed, mass)
    return elements(spark, sf).select("p_partkey", mm.alias("mm"), chem.mm_to_ppm(feed, mass).alias("ppm"), chem.conc_from_ratio(mm, size).alias("conc"), chem.mg_in(mm, size, mass).alias("mg"), chem.litres_for(feed, size).alias("litres"))


SOLVE = f"""WITH {MASS_SQL}, i AS (SELECT p_partkey, m.element, mass, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_retailprice END AS feed, CASE WHEN p_partkey % 2 = 0 THEN 'ppm' ELSE 'mM' END AS unit, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size::DOUBLE END AS ratio, CASE WHEN p_partkey % 7 < 4 THEN NULL ELSE p_retailprice * 2 END AS conc, p_size::DOUBLE AS ml FROM part LEFT JOIN m ON p_partkey % 25 = m.k),
s AS (SELECT *, CASE WHEN mass IS NULL THEN NULL WHEN unit = 'ppm' THEN feed / mass ELSE feed END AS mm FROM i)
SELECT p_partkey, mm AS "ree_mM", CASE WHEN mass IS NOT NULL THEN CASE WHEN mm IS NOT NULL OR (ratio IS NOT NULL AND conc IS NOT NULL) THEN coalesce(conc, mm * ratio) END END AS "extractant_conc_mM",
CASE WHEN mass IS NOT NULL THEN CASE WHEN mm IS NOT NULL OR (ratio IS NOT NULL AND conc IS NOT NULL) THEN coalesce(ratio, CASE WHEN mm <> 0 THEN conc / mm END) END END AS molar_ratio,
mm * (ml / 1000.0) AS ree_mmol_total,
CASE WHEN mass IS NULL THEN 0 WHEN ratio IS NOT NULL AND conc IS NOT NULL THEN CASE WHEN mm * ratio <> 0 AND abs((mm * ratio - conc) / (mm * ratio)) > 0.05 THEN 1 ELSE 0 END WHEN (ratio IS NOT NULL OR conc IS NOT NULL) AND mm IS NULL THEN 1 ELSE 0 END::INT AS n_warnings FROM s"""


@query(SOLVE)
def f16_solve(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    given = elements(spark, sf).select(
        "p_partkey", "element", F.when(k % 5 != 0, F.col("feed")).alias("feed_value"), F.when(k % 2 == 0, "ppm").otherwise("mM").alias("feed_unit"),
        F.when(k % 3 != 0, F.col("size")).alias("target_molar_ratio"), F.when(k % 7 >= 4, F.col("feed") * 2).alias("target_extractant_conc_mM"), F.col("size").alias("volume_mL"),
    )
    return chem.solve(given).select("p_partkey", "ree_mM", "extractant_conc_mM", "molar_ratio", "ree_mmol_total", F.size("warnings").alias("n_warnings"))


@query(f"WITH {MASS_SQL} SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_retailprice / mass WHEN 1 THEN CASE WHEN p_size <> 10 THEN p_retailprice / (p_size - 10) END END AS result, CASE WHEN p_partkey % 3 = 2 THEN 'unknown operation nope' WHEN mass IS NULL AND p_partkey % 3 = 0 THEN 'missing: mass' WHEN p_partkey % 3 = 1 AND p_size = 10 THEN 'division by zero' END AS error FROM part LEFT JOIN m ON p_partkey % 25 = m.k")
def d5_calculator(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    ops = F.when(k % 3 == 0, "ppm_to_mM").when(k % 3 == 1, "volume_for_target_moles").otherwise("nope")
    asked = elements(spark, sf).select("p_partkey", ops.alias("operation"), F.col("element"), F.col("feed").alias("ppm"), F.col("feed").alias("target_mmol"), (F.col("size") - 10).alias("conc_mM"))
    return chem.calculate(asked).select("p_partkey", "result", "error")


@query("SELECT p_partkey, '#' || lpad(lower(to_hex(round_even((p_partkey % 11) / 10.0 * 255, 0)::BIGINT)), 2, '0') || lpad(lower(to_hex(round_even((p_partkey % 7) / 6.0 * 255, 0)::BIGINT)), 2, '0') || '00' AS colour FROM part")
def f18_colours(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return t(spark, sf, "part").select("p_partkey", text.colour(k % 11 / 10.0, k % 7 / 6.0, F.lit(0.0)).alias("colour"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 0.01 * value - 1 ELSE 10 ** (0.01 * value - 1) END AS v FROM events")
def f20_pixel_to_data(spark: SparkSession, sf: str) -> DataFrame:
    model = F.when(F.col("event_id") % 2 == 0, "linear").otherwise("log10")
    return t(spark, sf, "events").select("event_id", curves.to_data(F.col("value"), model, F.lit(0.01), F.lit(-1.0)).alias("v"))


@query("SELECT o_orderkey, round(o_totalprice, (3 - floor(log10(o_totalprice)))::INT) AS v FROM orders WHERE o_totalprice > 0")
def f21_significant(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "orders").filter("o_totalprice > 0").select("o_orderkey", text.significant(F.col("o_totalprice")).alias("v"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_discount * 10 >= 0.6 THEN 'filled_blob' WHEN l_discount * 10 <= 0.45 AND l_quantity / l_linenumber BETWEEN 0.6 AND 1.7 THEN 'stroked_glyph' ELSE 'ambiguous' END AS shape FROM lineitem")
def f23_blob_shapes(spark: SparkSession, sf: str) -> DataFrame:
    shape = curves.blob_shape(F.col("l_discount") * 10, F.col("l_quantity"), F.col("l_linenumber"))["shape"]
    return t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", shape.alias("shape"))


@query("SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity * l_linenumber) BETWEEN 12 AND 600 AND l_quantity BETWEEN 6 AND 26 AND l_linenumber + 5 BETWEEN 6 AND 26 AND l_quantity / (l_linenumber + 5) BETWEEN 0.55 AND 1.8")
def p18_marker_shapes(spark: SparkSession, sf: str) -> DataFrame:
    blobs = t(spark, sf, "lineitem").withColumns({"area": F.col("l_quantity") * F.col("l_linenumber"), "bbox_w": F.col("l_quantity"), "bbox_h": F.col("l_linenumber") + 5})
    return curves.marker_blobs(blobs).select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")


@query("SELECT event_id, ts + INTERVAL 10 MINUTE <= TIMESTAMP '2024-01-15 00:00:00' AS stale FROM events")
def f26_stale_locks(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "events").select("event_id", text.stale(F.col("ts"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).alias("stale"))


@query("SELECT p_partkey, round(100 * 10 ** (p_size / 25.0 - 1) / (1 + 10 ** (p_size / 25.0 - 1)), 9) AS pct FROM part")
def f28_percent_from_log_d(spark: SparkSession, sf: str) -> DataFrame:
    return t(spark, sf, "part").select("p_partkey", F.round(chem.percent_from_log_d(F.col("p_size") / 25.0 - 1), 9).alias("pct"))



MARKS = "m AS (SELECT c_custkey AS page, unnest(range(0, 3 + c_custkey % 5)) AS k FROM customer), b AS (SELECT page, k, (20 + 40 * (k % 4) + page % 9)::DOUBLE AS x, (16 + 44 * (k // 4) + page % 7)::DOUBLE AS y, 8 + (page + k) % 6 AS side FROM m)"


def drawn_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A grey page of 200 by 120 pixels for each customer, with squares of ink, some specks, and a line."""
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (some.iloc[k : k + 500] for some in parts for k in range(0, len(some), 500)):  # 12 MB of pages
            pages = []
            for page in part["page"]:
                ink = np.full((120, 200), 255, np.uint8)
                for k in range(3 + page % 5):
                    x, y, side = 20 + 40 * (k % 4) + page % 9, 16 + 44 * (k // 4) + page % 7, 8 + (page + k) % 6
                    ink[y : y + side, x : x + side] = 0
                ink[110, 5:195] = 0
                ink[5, 7::11] = 100
                pages.append(ink.tobytes())
            yield pd.DataFrame({"page": part["page"], "height": 120, "width": 200, "pixels": pages})

    return spread(t(spark, sf, "customer").select(F.col("c_custkey").alias("page"))).mapInPandas(draw, "page long, height int, width int, pixels binary")


@query(f"WITH {MARKS} SELECT page, x + (side - 1) / 2.0 AS cx, y + (side - 1) / 2.0 AS cy, (side * side - 4)::INT AS area, 'filled_blob' AS shape FROM b")
def e11_raster_markers(spark: SparkSession, sf: str) -> DataFrame:
    """From pixels to markers, in tiles that the squares cross."""
    blobs = curves.detect_blobs(drawn_pages(spark, sf), ["page"], tile=64)
    return curves.raster_markers(blobs, ["page"]).select("page", "cx", "cy", "area", "shape")


# --- clusters, ad-hoc SQL, ingestion ---

LIFE = "TIMESTAMP '2024-01-01 00:00:00'"


@query(f"SELECT n_name AS batch_id, c_custkey::VARCHAR AS custom_id, CASE c_custkey % 5 WHEN 0 THEN 'ended' WHEN 1 THEN 'errored' WHEN 2 THEN 'ended_late' ELSE 'timed_out' END AS status, strftime({LIFE} + CASE c_custkey % 5 WHEN 0 THEN INTERVAL 3 HOUR WHEN 1 THEN INTERVAL 4 HOUR WHEN 2 THEN INTERVAL 61 HOUR ELSE INTERVAL (1440 + c_custkey % 7) MINUTE END, '%Y-%m-%d %H:%M') AS at, CASE WHEN c_custkey % 5 IN (0, 2) THEN c_name END AS text, CASE WHEN c_custkey % 5 = 1 THEN 'overloaded' WHEN c_custkey % 5 >= 3 THEN 'no result returned' END AS error FROM customer JOIN nation ON c_nationkey = n_nationkey")
def t1_request_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as requests, a batch a nation, followed by a stream that is restarted three times: requests, then
    results, errors and polls, then late and repeated results, and at last the time that lets the rest run out."""
    from solvlake.streaming import lifecycle

    base = files.workspace(spark, "lifecycle")
    some = t(spark, sf, "customer").join(F.broadcast(t(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    some = some.select(F.col("n_name").alias("batch_id"), F.col("c_custkey").cast("string").alias("custom_id"), (F.col("c_custkey") % 5).alias("kind_of"), (F.col("c_custkey") % 7).alias("later"), "c_name")
    after = lambda minutes: F.timestamp_micros(F.lit(1_704_067_200_000_000).cast("long") + minutes.cast("long") * 60_000_000)

    def told(which, kind: str, hours: int, text=None) -> DataFrame:
        return some.filter(which).withColumns({"kind": F.lit(kind), "at": after(F.lit(hours * 60)), "text": F.lit(None).cast("string") if text is None else text})

    k, name = F.col("kind_of"), F.col("c_name")
    clock = lambda hours: spark.range(1).select(F.lit("clock").alias("batch_id"), F.lit("clock").alias("custom_id"), F.lit("in_progress").alias("kind"), after(F.lit(hours * 60)).alias("at"), F.lit(None).cast("string").alias("text"))
    rounds = [
        [],
        [told(k == 0, "result", 3, name), told(k == 1, "error", 4, F.lit("overloaded")), told(k == 2, "in_progress", 4), clock(60)],
        [told(k == 2, "result", 61, name), told(k == 0, "result", 62, F.lit("again")), clock(100)],
        [clock(101)],
    ]
    lifecycle.submit(some.withColumn("at", after(F.col("later"))), f"{base}/events")
    for events in rounds:
        for part in events:
            lifecycle.record(part, f"{base}/events")
        lifecycle.follow(spark, f"{base}/events", f"{base}/transitions", f"{base}/checkpoint")
    standing = lifecycle.standing(spark.read.schema(lifecycle.TRANSITION).parquet(f"{base}/transitions"))
    return standing.select("batch_id", "custom_id", "status", F.date_format("at", "yyyy-MM-dd HH:mm").alias("at"), "text", "error")


CLUSTERS = """WITH RECURSIVE p AS (SELECT label, vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
e AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b USING (label) WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.02),
r(label, a, b) AS (SELECT label, a, b FROM e UNION SELECT r.label, r.a, e.b FROM r JOIN e ON r.label = e.label AND r.b = e.a)
SELECT label, a AS vec_id, min(b) AS cluster FROM r GROUP BY 1, 2"""


@query(CLUSTERS)
def e8_single_linkage(spark: SparkSession, sf: str) -> DataFrame:
    found = t(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.lit(0.02).alias("eps"))
    return curves.single_linkage(found, ["label"], "x", "y", "eps", "vec_id")


@query("""WITH RECURSIVE p AS (SELECT event_id AS i, epoch_us(ts) / 3.6e9 AS x, value AS y FROM events), c AS (SELECT *, floor(x) AS cx, floor(y) AS cy FROM p),
n AS (SELECT *, unnest([-1, 0, 1]) AS dx FROM c), o AS (SELECT *, unnest([-1, 0, 1]) AS dy FROM n),
e AS (SELECT a.i AS a, b.i AS b FROM o a JOIN c b ON b.cx = a.cx + a.dx AND b.cy = a.cy + a.dy WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.75),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS event_id, min(b) AS cluster FROM r GROUP BY 1""")
def e8_one_large_group(spark: SparkSession, sf: str) -> DataFrame:
    """All events as the points of one group, which is clustered over the cluster."""
    found = points(spark, sf).select("event_id", (F.col("x") / 3.6e9).alias("x"), "y", F.lit(0.75).alias("eps"))
    return curves.single_linkage(found, [], "x", "y", "eps", "event_id")


@query("WITH c AS (SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1) SELECT * FROM c ORDER BY n DESC")
def d1_guarded_sql(spark: SparkSession, sf: str) -> DataFrame:
    return guard.guarded(spark, "WITH c AS (SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM papers GROUP BY 1) SELECT * FROM c ORDER BY n DESC -- any order", {"papers": t(spark, sf, "orders")})


@query("SELECT p_partkey, p_size // 7 AS sevenths, CASE WHEN p_size % 5 <> 0 THEN 100 // (p_size % 5) END AS share, p_retailprice / (p_size - 10) AS price FROM part WHERE p_type ILIKE '%brass%' OR p_brand NOT ILIKE 'BRAND#1_' AND p_size // 7 // 2 = 1")
def d1_sqlite_meaning(spark: SparkSession, sf: str) -> DataFrame:
    """LIKE in any case, whole division, and NULL for a division by zero."""
    asked = "SELECT p_partkey, p_size/7 AS sevenths, 100/(p_size % 5) AS share, p_retailprice/(p_size - 10) AS price FROM papers WHERE p_type LIKE '%bRaSs%' OR p_brand NOT LIKE 'brand#1_' AND p_size/7/2 = 1 LIMIT 1000000"
    return guard.guarded(spark, asked, {"papers": t(spark, sf, "part")}, sqlite=True)


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, min(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')) AS first FROM orders GROUP BY 1")
def d1_sqlite_dates(spark: SparkSession, sf: str) -> DataFrame:
    return guard.guarded(spark, "SELECT strftime('%Y-%m', o_orderdate) AS month, count(*) AS n, min(datetime(o_orderdate)) AS first FROM papers GROUP BY strftime('%Y-%m', o_orderdate)", {"papers": t(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("string"))})


@query(f"WITH {MASS_SQL}, e AS (SELECT p_partkey, p_retailprice AS feed, p_size::DOUBLE AS ml, mass FROM part LEFT JOIN m ON p_partkey % 25 = m.k) SELECT p_partkey, round(feed / mass, 9) AS mm, round(feed / mass * (ml / 1000.0) * mass, 9) AS mg, CASE WHEN ml <> 10 THEN round(feed / (ml - 10), 9) END AS ratio FROM e")
def d1_calculator_functions(spark: SparkSession, sf: str) -> DataFrame:
    """The conversions, called from a query."""
    asked = "SELECT p_partkey, round(ppm_to_mM(feed, atomic_mass(element)), 9) AS mm, round(mass_mg_in_volume(ppm_to_mM(feed, atomic_mass(element)), size, atomic_mass(element)), 9) AS mg, round(molar_ratio_from_conc(feed, size - 10), 9) AS ratio FROM papers LIMIT 1000000"
    return guard.guarded(spark, asked, {"papers": elements(spark, sf)})


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 500")
def l2_injected_limit(spark: SparkSession, sf: str) -> DataFrame:
    return guard.guarded(spark, "SELECT o_orderkey FROM papers ORDER BY o_orderkey", {"papers": t(spark, sf, "orders")})


@query("SELECT '[' || string_agg('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}', ', ' ORDER BY r_regionkey) || ']' AS rows FROM region")
def s21_json_rows(spark: SparkSession, sf: str) -> DataFrame:
    return files.json_rows(t(spark, sf, "region"), ["r_regionkey"])


@query("SELECT l_orderkey AS run, 'duplicate_rows' AS rule, sum(k)::BIGINT AS n FROM (SELECT l_orderkey, l_linenumber, count(*) AS k FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1")
def c_duplicate_rule(spark: SparkSession, sf: str) -> DataFrame:
    base = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").cast("string").alias("element"), F.lit(1.0).alias("ph"), F.lit(2.0).alias("extract_pct"))
    return qa.duplicate_rows(base, ("run",)).select("run", "rule", "n")


@query("SELECT user_id AS run, event_type AS subject, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) < 8")
def c_row_count_rule(spark: SparkSession, sf: str) -> DataFrame:
    return qa.row_count_sanity(t(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_type").alias("element")), ("run",)).select("run", "subject", "n")


@query("SELECT o_orderpriority AS v FROM (SELECT o_orderpriority FROM orders EXCEPT SELECT '1-URGENT') UNION ALL SELECT '(edited)'")
def x4_edited_rows(spark: SparkSession, sf: str) -> DataFrame:
    before = t(spark, sf, "orders").select(F.col("o_orderpriority").alias("v")).distinct()
    after = before.filter("v <> '1-URGENT'")
    return after if versions.same_rows(before, after) else after.unionByName(spark.range(1).select(F.lit("(edited)").alias("v")))


@query("SELECT doc_id, text IS NOT NULL AS found FROM documents WHERE sha256(text) = (SELECT sha256(text) FROM documents ORDER BY doc_id LIMIT 1)")
def s5_lookup_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    docs = t(spark, sf, "documents").select("doc_id", "text", F.sha2("text", 256).alias("content_sha256"))
    wanted = docs.orderBy("doc_id").limit(1).select("content_sha256")
    return docs.join(wanted, "content_sha256", "left_semi").select("doc_id", F.col("text").isNotNull().alias("found"))


@query("SELECT user_id, arg_max(event_type, event_id) AS status, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def s16_latest_status(spark: SparkSession, sf: str) -> DataFrame:
    changes = t(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("status"), "value")
    return versions.latest_status(changes, "user_id").select("user_id", "status", "value")


@query("SELECT n_name AS element, n_nationkey::DOUBLE AS ph FROM nation WHERE n_regionkey <= 2")
def s18_commit_and_view(spark: SparkSession, sf: str) -> DataFrame:
    """Two approved versions of one paper, committed to a new store; the later one is current."""
    from solvlake.plans.store import Store
    from solvlake.schema import SCHEMA

    cells = {"element": F.col("n_name"), "ph": F.col("n_nationkey").cast("double")}
    measured = t(spark, sf, "nation").select("n_regionkey", F.col("n_nationkey").alias("row_ord"), *[cells.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in SCHEMA])
    store = Store(spark, files.workspace(spark, "store"))
    store.commit_extraction(measured, content_sha256="one", pdf_path="one.pdf", prompt_version="extraction_v5")
    store.commit_extraction(measured.filter("n_regionkey <= 2"), content_sha256="one", pdf_path="one.pdf", prompt_version="extraction_v6")
    return store.current_best().select("element", "ph")


def parts_measured(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as the rows of one extraction."""
    from solvlake.schema import SCHEMA

    cells = {"element": F.col("p_brand"), "ph": F.col("p_size").cast("double")}
    return t(spark, sf, "part").select(F.col("p_partkey").alias("row_ord"), *[cells.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in SCHEMA])


@query("""WITH a AS (SELECT * FROM part WHERE p_size <= 25), r AS (
  SELECT 'as of 1' AS seen, p_brand AS element FROM a UNION ALL SELECT 'as of 2', p_brand FROM a UNION ALL SELECT 'as of 2', p_brand FROM part
  UNION ALL SELECT 'compacted', p_brand FROM a UNION ALL SELECT 'compacted', p_brand FROM part UNION ALL SELECT 'current', p_brand FROM part)
SELECT seen, element, count(*) AS n, 'refused, nothing was committed: one approved run for each paper and version' AS refused FROM r GROUP BY 1, 2""")
def s18_log_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Two commits, a third that is refused, a compaction; the rows as of each commit, and what is current."""
    from solvlake.plans.store import CommitError, Store

    store, given = Store(spark, files.workspace(spark, "store")), parts_measured(spark, sf)
    for version, rows_ in (("extraction_v5", given.filter("ph <= 25")), ("extraction_v6", given)):
        store.commit_extraction(rows_, content_sha256="one", pdf_path="one.pdf", prompt_version=version)
    refused = None
    try:
        store.commit_extraction(given, content_sha256="one", pdf_path="one.pdf", prompt_version="extraction_v6")
    except CommitError as e:
        refused = str(e)
    store.compact()
    seen = {"as of 1": store.table("extractions", as_of=1), "as of 2": store.table("extractions", as_of=2), "compacted": store.table("extractions"), "current": store.current_best()}
    every = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("seen"), "element") for k, df in seen.items()])
    return every.groupBy("seen", "element").agg(F.count("*").alias("n")).withColumn("refused", F.lit(refused))


@query("SELECT 'extraction_v5' AS prompt_version, count(*) FILTER (p_size <= 25)::INT AS n_rows_returned, NULL::DOUBLE AS input_tokens, NULL::DOUBLE AS cache_read_input_tokens FROM part UNION ALL SELECT 'extraction_v6', count(*)::INT, sum(p_size)::DOUBLE, NULL FROM part")
def s3_schema_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A store whose first commit is of a schema without the four usage columns, and whose second one has them."""
    from solvlake.plans.store import Store

    path, given = files.workspace(spark, "store"), parts_measured(spark, sf)
    Store(spark, path, version=1).commit_extraction(given.filter("ph <= 25"), content_sha256="one", pdf_path="one.pdf", prompt_version="extraction_v5")
    tokens = int(given.agg(F.sum("ph")).first()[0])
    store = Store(spark, path)
    store.commit_extraction(given, content_sha256="one", pdf_path="one.pdf", prompt_version="extraction_v6", input_tokens=tokens)
    return store.table("prompt_runs").select("prompt_version", "n_rows_returned", *[F.col(c).cast("double").alias(c) for c in ("input_tokens", "cache_read_input_tokens")])


@query("SELECT o_orderkey AS prompt_run_id, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'pending' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'rejected' ELSE 'pending' END END AS status FROM orders")
def s15_bulk_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as papers and orders as their runs, committed at once, and reviews of them as a second commit."""
    from solvlake.plans.store import Store

    store = Store(spark, files.workspace(spark, "store"))
    orders = t(spark, sf, "orders").select(F.col("o_orderkey").alias("prompt_run_id"), F.col("o_custkey").alias("paper_id"), F.concat_ws(" ", "o_orderpriority", "o_orderkey").alias("prompt_version"), "o_orderstatus")
    papers = t(spark, sf, "customer").select(F.col("c_custkey").alias("paper_id"), F.sha2("c_name", 256).alias("content_sha256"))
    status = lambda rows_, value, shift: rows_.select((F.col("prompt_run_id") * 2 + shift).alias("event_id"), "prompt_run_id", value.alias("status"))
    store.publish({"papers": papers, "prompt_runs": orders, "run_status": status(orders, F.lit("pending"), 0)})
    reviewed = orders.filter("o_orderstatus = 'F' OR o_orderstatus <> 'P' AND prompt_run_id % 2 = 0")
    store.publish({"run_status": status(reviewed, F.when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected"), 1)})
    return store.runs().select("prompt_run_id", "status")


@query("SELECT r_name AS custom_id, r_regionkey::DOUBLE AS ph FROM region")
def t1_incremental_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """A response file for each region, read by a stream that stops when it has them all."""
    from solvlake.streaming.ingest import ingest

    base = files.workspace(spark, "ingest")
    for r in t(spark, sf, "region").collect():  # five rows
        files.write_text(spark, f"{base}/in/{r.r_name}.txt", f'{{"rows": [{{"pH": {r.r_regionkey}}}]}}')
    ingest(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", per_batch=2)
    return spark.read.parquet(f"{base}/out/rows").select("custom_id", "ph")


@query("SELECT conv_id, count(*) AS calls, sum(length(text))::BIGINT AS input_tokens, sum(CASE WHEN role = 'user' THEN 0 ELSE length(text) END)::BIGINT AS output_tokens FROM conversations GROUP BY 1")
def a19_usage_sums(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text")
    return versions.usage_sums(t(spark, sf, "conversations"), ["conv_id"], {"input_tokens": n, "output_tokens": F.when(F.col("role") == "user", 0).otherwise(n)})


@query("SELECT l_orderkey AS page, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS ambiguous FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'N') > 0.3 * count(*)")
def a23_ambiguous_pages(spark: SparkSession, sf: str) -> DataFrame:
    shapes = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.when(F.col("l_returnflag") == "N", "ambiguous").otherwise("filled_blob").alias("shape"))
    return curves.ambiguous_pages(shapes, ["page"])


@query(CLUSTERS.replace("SELECT label, a AS vec_id, min(b) AS cluster FROM r GROUP BY 1, 2", ", c AS (SELECT label, a AS vec_id, min(b) AS cluster FROM r GROUP BY 1, 2) SELECT label, cluster, round(avg(x), 9) AS pixel_x, round(avg(y), 9) AS pixel_y, count(*) AS n_paths FROM c JOIN p USING (label, vec_id) GROUP BY 1, 2"))
def a14_centroids(spark: SparkSession, sf: str) -> DataFrame:
    found = t(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.lit(0.02).alias("eps"))
    made = curves.centroids(found, curves.single_linkage(found, ["label"], "x", "y", "eps", "vec_id"), ["label"], "x", "y", "vec_id")
    return made.select("label", "cluster", F.round("pixel_x", 9).alias("pixel_x"), F.round("pixel_y", 9).alias("pixel_y"), "n_paths")


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE sqrt((l_linenumber * 2.0) ** 2 + (l_quantity / 3) ** 2) <= 12")
def p16_short_segments(spark: SparkSession, sf: str) -> DataFrame:
    lines = t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", F.lit("line").alias("kind"), F.lit(0.0).alias("x0"), (F.col("l_linenumber") * 2.0).alias("x1"), F.lit(0.0).alias("top"), (F.col("l_quantity") / 3).alias("bottom"))
    return curves.short_segments(lines).select("l_orderkey", "l_partkey", "l_linenumber")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' THEN '[RED-flag override] ' || coalesce(nullif(o_orderpriority, '5-LOW'), 'no reason given') ELSE nullif(o_orderpriority, '5-LOW') END AS note FROM orders")
def x3_approval_notes(spark: SparkSession, sf: str) -> DataFrame:
    note = F.nullif("o_orderpriority", F.lit("5-LOW"))
    return t(spark, sf, "orders").select("o_orderkey", versions.approval_note(note, F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT").alias("note"))


@query("WITH k AS (SELECT e.event_id, e.value AS p, floor(e.value / 100) * 100 AS lo FROM events e) SELECT event_id, round(v, 9) AS value FROM (SELECT event_id, CASE WHEN p >= 500 THEN 25.0 ELSE (lo / 100) ** 2 + (((lo + 100) / 100) ** 2 - (lo / 100) ** 2) * (p - lo) / 100 END AS v FROM k)")
def f29_between_ticks(spark: SparkSession, sf: str) -> DataFrame:
    ticks = spark.range(6).select(F.lit(1).alias("axis"), (F.col("id") * 100.0).alias("tick"), F.pow(F.col("id").cast("double"), F.lit(2.0)).alias("value"))
    pixels = t(spark, sf, "events").select("event_id", F.lit(1).alias("axis"), F.col("value").alias("pixel"))
    return chem.between_ticks(pixels, ticks, ["axis"]).select("event_id", F.round("value", 9).alias("value"))


# --- quality rules over measurements: runs are users, elements are event types ---

MEASURED = "m AS (SELECT user_id AS run, event_id AS row_ord, event_type AS element, (event_id % 140) / 10.0 AS ph, value AS extract_pct, (event_id % 3) * 100.0 AS extractant_mm, CASE event_id % 5 WHEN 0 THEN 'acidic' WHEN 1 THEN ' Neutral ' WHEN 2 THEN 'ionic liquid' WHEN 3 THEN 'Carrier-' || event_type END AS extractant_type FROM events)"


def measured(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    kind = F.when(k % 5 == 0, "acidic").when(k % 5 == 1, " Neutral ").when(k % 5 == 2, "ionic liquid").when(k % 5 == 3, F.concat(F.lit("Carrier-"), "event_type"))
    cells = {"element": F.col("event_type"), "ph": (k % 140) / 10.0, "extract_pct": F.col("value"), "extractant_mm": (k % 3) * 100.0, "extractant_type": kind}
    return conform(t(spark, sf, "events").select("*", F.col("user_id").alias("run"), k.alias("row_ord"), *[c.alias(n) for n, c in cells.items()]), keep=("run", "row_ord"))


@query("SELECT user_id AS run, 'schema_conformance' AS rule, CASE WHEN count(*) FILTER (value > 30) = 0 THEN 0 ELSE count(*) FILTER (value > 60) END AS n, CASE WHEN count(*) FILTER (value > 30) = 0 THEN 'no rows' ELSE 'cells that are no numbers' END AS detail FROM events GROUP BY 1 HAVING count(*) FILTER (value > 30) = 0 OR count(*) FILTER (value > 60) > 0")
def c_schema_rule(spark: SparkSession, sf: str) -> DataFrame:
    counted = t(spark, sf, "events").groupBy(F.col("user_id").alias("run")).agg(F.count_if(F.col("value") > 30).alias("n_rows"), F.count_if(F.col("value") > 60).alias("coercion_failures"))
    return qa.schema_conformance(counted, ("run",)).select("run", "rule", "n", "detail")


@query(f"WITH {MEASURED} SELECT run, 'axis_bounds' AS rule, c AS subject, count(*) AS n FROM (SELECT run, 'extract_pct' AS c, extract_pct AS v, 0 AS lo, 100 AS hi FROM m UNION ALL SELECT run, 'ph', ph, -1, 14 FROM m) WHERE v < lo OR v > hi GROUP BY 1, 3")
def c_axis_rule(spark: SparkSession, sf: str) -> DataFrame:
    return qa.axis_bounds(measured(spark, sf), ("run",)).select("run", "rule", "subject", "n")


@query(f"WITH {MEASURED}, d AS (SELECT *, extract_pct - lag(extract_pct) OVER (PARTITION BY run, element, extractant_mm ORDER BY ph, row_ord) AS dy FROM m) SELECT run, 'monotonicity' AS rule, element AS subject, count(*) FILTER (abs(dy) > 5) AS n FROM d GROUP BY run, element, extractant_mm HAVING count(*) >= 4 AND count(*) FILTER (dy > 5) >= 2 AND count(*) FILTER (dy < -5) >= 2")
def c_monotonicity_rule(spark: SparkSession, sf: str) -> DataFrame:
    return qa.monotonicity(measured(spark, sf), ("run",)).select("run", "rule", "subject", "n")


@query(f"WITH {MEASURED}, v AS (SELECT run, extractant_type AS value, min(row_ord) AS first FROM m WHERE trim(extractant_type) <> '' AND lower(trim(extractant_type)) NOT IN ('acidic', 'basic', 'neutral', 'solvating', 'chelating', 'cation exchanger', 'anion exchanger') GROUP BY 1, 2) SELECT run, 'vocabulary' AS rule, 'extractant_type' AS subject, count(*) AS n, string_agg(value, ', ' ORDER BY first) AS detail FROM v GROUP BY 1")
def c_vocabulary_rule(spark: SparkSession, sf: str) -> DataFrame:
    return qa.vocabulary(measured(spark, sf), ("run",)).select("run", "rule", "subject", "n", "detail")


@query(f"""WITH {MEASURED}, e AS (SELECT event_id AS ep, user_id AS run, CASE event_id % 3 WHEN 0 THEN upper(event_type) WHEN 1 THEN 'v.ew' ELSE 'none' END AS wanted, (event_id % 140) / 10.0 + 0.25 AS x0, value * 0.9 AS y0 FROM events WHERE event_id % 20 = 0),
p AS (SELECT e.*, abs(ph - x0) AS dx, abs(extract_pct - y0) AS dy, regexp_matches(element, wanted, 'i') AS fits FROM e JOIN m USING (run)), q AS (SELECT *, bool_or(fits) OVER (PARTITION BY ep) AS any_fits FROM p),
w AS (SELECT *, min(dx) OVER (PARTITION BY ep) AS least FROM q WHERE fits OR NOT any_fits),
b AS (SELECT run, ep, least > 0.3 AS far, min(dy) AS dy FROM w WHERE least > 0.3 OR dx <= 0.3 GROUP BY ALL)
SELECT run, 'text_endpoint_cross_check' AS rule, ep AS n, CASE WHEN far THEN 'truncated curve' ELSE 'off' END AS detail FROM b WHERE far OR dy > 10""")
def c_endpoint_rule(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    wanted = F.when(k % 3 == 0, F.upper("event_type")).when(k % 3 == 1, "v.ew").otherwise("none")
    stated = t(spark, sf, "events").filter(k % 20 == 0).select(F.col("user_id").alias("run"), k.alias("endpoint_ord"), wanted.alias("element"), ((k % 140) / 10.0 + 0.25).alias("x_value"), F.lit("pH").alias("x_basis"), (F.col("value") * 0.9).alias("y_value"), F.lit("Extract%").alias("y_metric"))
    return qa.text_endpoints(measured(spark, sf), stated, ("run",)).select("run", "rule", "n", F.when(F.col("detail") == "truncated curve", F.col("detail")).otherwise("off").alias("detail"))


@query("WITH g AS (SELECT user_id AS run, event_type, count(*) AS n FROM events GROUP BY 1, 2), k AS (SELECT run, n + 4 AS n, row_number() OVER (PARTITION BY run ORDER BY n DESC) AS rank FROM g), s AS (SELECT run, n, row_number() OVER (PARTITION BY run ORDER BY n DESC) AS rank FROM g WHERE event_type <> 'view') SELECT k.run, 'deterministic_curve_count' AS rule, count(*) AS n, 'expected ' || arg_min(k.n, rank) || ' got ' || arg_min(coalesce(s.n, 0), rank) || ' of ' || coalesce((SELECT string_agg(x.n, ', ' ORDER BY x.n DESC) FROM s x WHERE x.run = k.run AND x.rank <= 10), 'none') AS detail FROM k LEFT JOIN s USING (run, rank) WHERE coalesce(s.n, 0) < 0.8 * k.n GROUP BY 1")
def c_curve_count_rule(spark: SparkSession, sf: str) -> DataFrame:
    known = t(spark, sf, "events").groupBy(F.col("user_id").alias("run"), "event_type").agg((F.count("*") + 4).alias("n")).select("run", "n")
    return qa.curve_counts(measured(spark, sf).filter("element <> 'view'"), known, ("run",)).select("run", "rule", "n", "detail")


@query(f"WITH {MEASURED}, f AS (SELECT run, element, count(*) AS n FROM m GROUP BY 1, 2 HAVING count(*) < 8) SELECT run, element AS subject, n FROM f")
def f8_report_read_back(spark: SparkSession, sf: str) -> DataFrame:
    """The flags of a run's stored report, read again."""
    rows_ = measured(spark, sf)
    told = qa.verdicts(rows_.select("run").distinct(), qa.row_count_sanity(rows_, ("run",)), ("run",))
    return told.select("run", F.explode(qa.read_report(F.col("report"))).alias("f")).select("run", "f.subject", "f.n")


# --- the contract, responses, files ---


@query("SELECT p_partkey, p_brand AS element, CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE END AS ph, p_retailprice AS extractant_mm, 0 AS rest FROM part")
def p1_conform(spark: SparkSession, sf: str) -> DataFrame:
    """Columns by display name, internal name, and not of the contract, to the 26 columns in order."""
    cells = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("n/a")
    given = t(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("Rare Earth Elements (REY:La, Ce, Nd)"), cells.alias("pH"), F.col("p_retailprice").alias("extractant_mm"), "p_name")
    told = conform(given, keep=("p_partkey",))
    others = [F.col(n).isNotNull().cast("int") for n in NAMES if n not in ("element", "ph", "extractant_mm")]
    return told.select("p_partkey", "element", "ph", "extractant_mm", reduce(add, others).alias("rest"))


@query("SELECT event_id::VARCHAR AS custom_id, CASE event_id % 4 WHEN 1 THEN 'positional rows without columns' WHEN 2 THEN 'row length differs from columns' WHEN 3 THEN 'columns differ from the contract' END AS error, CASE WHEN event_id % 4 = 0 THEN value END AS ph, CASE WHEN event_id % 4 = 0 THEN 'D2EHPA' END AS extractant FROM events")
def f7_positional_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as arrays in the order of a column list that is the contract reversed, and three faults of that form."""
    names = [d for _, d, _ in CONTRACT][::-1]
    listed = json.dumps(names)
    cells = F.concat_ws(",", *[F.col("value").cast("string") if n == "pH" else F.lit('"D2EHPA"' if n == "Extractant" else "null") for n in names])
    k = F.col("event_id")
    columns = F.when(k % 4 == 1, "5").when(k % 4 == 3, listed.replace('"pH"', '"PH"')).otherwise(listed)
    body = F.concat(F.lit('{"columns": '), columns, F.lit(', "rows": [['), cells, F.when(k % 4 == 2, ', "more"').otherwise(""), F.lit("]]}"))
    said = t(spark, sf, "events").select(k.cast("string").alias("custom_id"), body.alias("raw_text"))
    return outcomes(spread(said)).select("custom_id", "error", "ph", "extractant")


@query("SELECT r_name AS prompt_version, sha256('Use {rows} of ' || r_name) AS prompt_sha256 FROM region")
def s9_prompts(spark: SparkSession, sf: str) -> DataFrame:
    base = files.workspace(spark, "prompts")
    for r in t(spark, sf, "region").collect():  # five rows
        files.write_text(spark, f"{base}/{r.r_name}.md", f"Use {{rows}} of {r.r_name}")
    return files.prompts(spark, base, "{rows}").select("prompt_version", F.sha2("text", 256).alias("prompt_sha256"))


@query("SELECT sha256('%PDF ' || (r_regionkey // 2)) AS content_sha256, count(*) AS copies, length('%PDF ' || (r_regionkey // 2)) AS length FROM region GROUP BY r_regionkey // 2")
def s6_pdfs(spark: SparkSession, sf: str) -> DataFrame:
    """Five files of three contents, in two folders."""
    base = files.workspace(spark, "pdfs")
    regions = t(spark, sf, "region").collect()  # five rows
    for r in regions:
        files.write_text(spark, f"{base}/{r.r_regionkey % 2}/{r.r_name}.pdf", f"%PDF {r.r_regionkey // 2}")
    files.write_text(spark, f"{base}/0/notes.txt", "not a PDF")
    copies = spark.createDataFrame([(f"%PDF {r.r_regionkey // 2}",) for r in regions], "text string").groupBy(F.sha2("text", 256).alias("content_sha256")).agg(F.count("*").alias("copies"))
    return files.pdfs(spark, base).join(copies, "content_sha256").select("content_sha256", "copies", F.col("length").cast("int").alias("length"))


@query("SELECT n_name AS Extractant, n_nationkey::DOUBLE AS \"pH\" FROM nation")
def s19_exports(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as a CSV file and as JSON lines under display names, read again and joined."""
    base = files.workspace(spark, "exports")
    given = t(spark, sf, "nation").select(F.col("n_name").alias("extractant"), F.col("n_nationkey").cast("double").alias("ph"))
    files.export_csv(given, f"{base}/csv")
    files.export_json(given, f"{base}/json")
    return spark.read.option("header", "true").csv(f"{base}/csv").select("Extractant").join(spark.read.json(f"{base}/json"), "Extractant")


@query("SELECT r_name AS item_id, r_regionkey::DOUBLE AS note FROM region WHERE r_regionkey <> 3")
def s10_restored_items(spark: SparkSession, sf: str) -> DataFrame:
    """Staged items after a restart: one whose rows are gone is dropped, a corrupt sidecar is skipped."""
    from solvlake.plans.review import Staging

    staging = Staging(spark, files.workspace(spark, "staging"))
    for r in t(spark, sf, "region").collect():  # five rows
        staging.stage(r.r_name.replace(" ", "_"), spark.range(2), {"note": float(r.r_regionkey), "name": r.r_name})
        if r.r_regionkey == 3:
            files.delete(spark, f"{staging.path}/rows/{r.r_name.replace(' ', '_')}")
    files.write_text(spark, f"{staging.path}/meta/bad.json", '{"note": ')
    return staging.restore("name string, note double").select(F.col("name").alias("item_id"), "note")


@query("SELECT * FROM (VALUES (1, 'approved'), (2, 'pending'), (3, 'rejected')) v(prompt_run_id, status)")
def s15_run_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """One committed extraction, and two runs that were recorded as pending, one of which was rejected."""
    from solvlake.plans.store import Store

    store = Store(spark, files.workspace(spark, "store"))
    rows_ = conform(t(spark, sf, "region").select(F.col("r_name").alias("element"), F.col("r_regionkey").alias("row_ord")), keep=("row_ord",))
    paper = store.commit_extraction(rows_, content_sha256="one", pdf_path="one.pdf", prompt_version="extraction_v5")["paper_id"]
    store.insert_run(paper, prompt_version="extraction_v6")
    store.set_status(store.insert_run(paper, prompt_version="extraction_v7"), "rejected")
    return store.runs().select(F.col("prompt_run_id").cast("int").alias("prompt_run_id"), "status")


@query("WITH d AS (SELECT doc_id, sha256(text) AS sha, '10.' || (1000 + doc_id // 2) || '/x' AS doi, n_chars FROM documents), k AS (SELECT doc_id AS paper_id, sha, doi FROM d WHERE n_chars > 2000), u AS (SELECT sha, min(doi) AS doi, count(*) AS n_pages FROM d GROUP BY 1), h AS (SELECT sha, min(paper_id) AS i FROM k GROUP BY 1), o AS (SELECT doi, min(paper_id) AS i FROM k GROUP BY 1) SELECT u.sha AS content_sha256, u.doi, u.n_pages, 1::INT AS is_raster_figure, CASE WHEN coalesce(h.i, o.i) IS NULL THEN 'new' ELSE 'existing (paper_id=' || coalesce(h.i, o.i) || ')' END AS status FROM u LEFT JOIN h USING (sha) LEFT JOIN o ON o.doi = u.doi")
def x1_previews(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as uploads; each row of one content is one of its pages, and names a DOI in its metadata."""
    from solvlake.plans.review import preview

    doi = F.concat(F.lit("10."), (F.floor(F.col("doc_id") / 2) + 1000).cast("string"), F.lit("/x"))
    docs = t(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", "n_chars", F.sha2("text", 256).alias("content_sha256"), doi.alias("own"))
    # a content's pages are in the order of their DOIs as text, so that the first page's is the least
    page = F.row_number().over(Window.partitionBy("content_sha256").orderBy("own")) - 1
    pages = docs.select("content_sha256", page.alias("page_index"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("doi:"), "own").alias("meta"), F.lit(None).cast("string").alias("title"), F.lit(True).alias("has_image"), F.lit(False).alias("has_text"))
    known = docs.filter("n_chars > 2000").select(F.col("doc_id").alias("paper_id"), "content_sha256", F.col("own").alias("doi"))
    uploads = docs.groupBy("content_sha256").agg(F.min("doc_id").cast("string").alias("path"))
    return preview(uploads, pages, known).select("content_sha256", "doi", "n_pages", "is_raster_figure", "status")


# --- ad-hoc SQL ---


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9990")
def d1_set_operations(spark: SparkSession, sf: str) -> DataFrame:
    return guard.guarded(spark, "SELECT c_custkey FROM papers WHERE c_mktsegment = 'BUILDING' EXCEPT SELECT o_custkey FROM prompt_runs WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM papers WHERE c_acctbal > 9990", {"papers": t(spark, sf, "customer"), "prompt_runs": t(spark, sf, "orders")}, limit=1_000_000)


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place, sum(o_totalprice) OVER (PARTITION BY o_custkey) > 400000 AS large FROM orders")
def d1_windows(spark: SparkSession, sf: str) -> DataFrame:
    return guard.guarded(spark, "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place, sum(o_totalprice) OVER (PARTITION BY o_custkey) > 400000 AS large FROM prompt_runs", {"prompt_runs": t(spark, sf, "orders")}, limit=100_000_000)


@query("SELECT o_custkey AS paper_id, o_orderkey AS prompt_run_id, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey = 7")
def p5_history_of_one(spark: SparkSession, sf: str) -> DataFrame:
    papers = t(spark, sf, "customer").select(F.col("c_custkey").alias("paper_id"), "c_name")
    return versions.history(runs(spark, sf), papers, "prompt_run_id", only=7).select("paper_id", "prompt_run_id", "c_name")


# --- figures: users are pages, event types are colours; x is the event's number, y its value ---

_RED = "CASE event_type WHEN 'click' THEN '#ff0000' WHEN 'view' THEN '#00ff00' WHEN 'purchase' THEN '#0000ff' ELSE '#000000' END"
FIGURES = f"p AS (SELECT user_id, event_id, {_RED} AS colour, event_id / 100.0 AS data_x, 50 - value / 20 AS data_y FROM events), n AS (SELECT user_id, colour, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) >= 3)"


def page_objects(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Objects and words of vector pages, and no images: markers of 5 x 6 points, a frame, and three numbers on
    each axis."""
    events = t(spark, sf, "events")
    x, y = F.col("event_id").cast("double"), F.col("value")
    channel = lambda kind: F.when(F.col("event_type") == kind, 1.0).otherwise(0.0)
    box = lambda a, b, w, h: [(a - w / 2).alias("x0"), (a + w / 2).alias("x1"), (b - h / 2).alias("top"), (b + h / 2).alias("bottom"), F.lit(float(w)).alias("width"), F.lit(float(h)).alias("height")]
    marks = events.select("user_id", F.col("event_id").alias("object_id"), F.lit("curve").alias("kind"), F.lit(True).alias("fill"), channel("click").alias("r"), channel("view").alias("g"), channel("purchase").alias("b"), *box(x, y, 5, 6))
    pages = events.select("user_id").distinct()
    frame = pages.select("user_id", F.lit(-1).cast("long").alias("object_id"), F.lit("rect").alias("kind"), F.lit(False).alias("fill"), *[F.lit(None).cast("double").alias(c) for c in "rgb"], F.lit(0.0).alias("x0"), F.lit(1e6).alias("x1"), F.lit(0.0).alias("top"), F.lit(1000.0).alias("bottom"), F.lit(1e6).alias("width"), F.lit(1000.0).alias("height"))
    word = lambda text, a, b: F.struct(F.lit(text).alias("text"), *[c for c in box(F.lit(float(a)), F.lit(float(b)), 4, 4)[:4]])
    numbers = [word(str(k), 100 * k, 1010) for k in (1, 4, 9)] + [word(str(v), -20, 1000 - 20 * v) for v in (5, 20, 45)]
    return marks.unionByName(frame), pages.select("user_id", F.explode(F.array(*numbers)).alias("w")).select("user_id", "w.*"), pages.select("user_id", F.lit(0).alias("height"), F.lit(0).alias("width"), F.lit(b"").alias("pixels")).limit(0)


@query(f"WITH {FIGURES} SELECT user_id, colour AS group_key, round(data_x, 6) AS data_x, round(data_y, 6) AS data_y, true AS calibrated FROM p JOIN n USING (user_id, colour)")
def e3_vector_figures(spark: SparkSession, sf: str) -> DataFrame:
    found = figures.extract(*page_objects(spark, sf), ["user_id"])
    return found.markers.select("user_id", "group_key", F.round("data_x", 6).alias("data_x"), F.round("data_y", 6).alias("data_y"), "calibrated")


@query(f"WITH {FIGURES}, m AS (SELECT *, median(n) OVER (PARTITION BY user_id) AS median, count(*) OVER (PARTITION BY user_id) AS k FROM n) SELECT user_id, 'series ' || colour || ' has ' || n || ' markers where the median is ' || floor(median)::BIGINT AS warning FROM m WHERE k >= 3 AND n < 0.6 * median")
def e3_warnings(spark: SparkSession, sf: str) -> DataFrame:
    return figures.extract(*page_objects(spark, sf), ["user_id"]).warnings


@query(f"WITH {FIGURES}, g AS (SELECT user_id, list_sort(list(n), 'DESC') AS c FROM n GROUP BY 1), ok AS (SELECT user_id FROM g WHERE len(c) >= 2 AND list_sum(c) >= 24 AND c[1] - c[len(c)] <= 0.15 * list_sort(c)[len(c) // 2 + 1]) SELECT user_id AS page_index, colour AS group_key, count(*) AS n, round(sum(data_x), 4) AS x_sum FROM p JOIN n USING (user_id, colour) WHERE user_id IN (SELECT user_id FROM ok) GROUP BY 1, 2")
def e14_confident_points(spark: SparkSession, sf: str) -> DataFrame:
    keyed = [df.withColumn("pdf", F.lit(1)).withColumnRenamed("user_id", "page_index") for df in page_objects(spark, sf)]
    _, found = figures.document_prepass(figures.extract(*keyed, ["pdf", "page_index"]))
    return found.groupBy("page_index", "group_key").agg(F.count("*").alias("n"), F.round(F.sum("data_x"), 4).alias("x_sum"))


@query("SELECT user_id, count(*) FILTER (value > 50) > 0 AS is_vector FROM events GROUP BY 1")
def p14_vector_pages(spark: SparkSession, sf: str) -> DataFrame:
    return curves.vector_pages(t(spark, sf, "events").select("user_id", F.lit("curve").alias("kind"), (F.col("value") > 50).alias("fill")), ["user_id"])


@query("SELECT user_id, string_agg(k::VARCHAR, ',' ORDER BY k) AS counts, 'page ' || user_id AS said FROM (SELECT user_id, event_type, count(*) AS k FROM events GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 2 AND sum(k) >= 24")
def f22_prompt_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The line that a reader gets for each figure page."""
    pages = curves.prepass(t(spark, sf, "events").groupBy(F.col("user_id").alias("pdf"), F.col("user_id").alias("page_index"), "event_type").agg(F.count("*").alias("n")))
    told = pages.select("pdf", "series_counts").join(curves.prompt_block(pages), "pdf")
    return told.select(F.col("pdf").alias("user_id"), F.array_join(F.transform(F.sort_array("series_counts"), lambda x: x.cast("string")), ",").alias("counts"), F.regexp_extract("block", r"^page \d+", 0).alias("said"))


@query("WITH p AS (SELECT page_id // 3 AS pdf, page_id % 3 AS k, CASE WHEN page_id % 2 = 1 THEN '10.' || (1000 + page_id) || '/t' END AS t, CASE WHEN page_id % 12 = 0 THEN '10.' || (5000 + page_id) || '/m' END AS m FROM pages) SELECT pdf::BIGINT AS pdf, coalesce(arg_min(m, k) FILTER (m IS NOT NULL), arg_min(t, k) FILTER (t IS NOT NULL AND k < 2)) AS doi FROM p GROUP BY 1")
def s7_pdf_doi(spark: SparkSession, sf: str) -> DataFrame:
    """Three pages a file; a DOI in the metadata wins over one in the text of the first two pages."""
    k = F.col("page_id")
    doi = lambda base, tail: F.concat(F.lit("doi 10."), (k + base).cast("string"), F.lit(f"/{tail}."))
    given = t(spark, sf, "pages").select(F.floor(k / 3).alias("pdf"), (k % 3).alias("page_index"), F.when(k % 2 == 1, doi(1000, "T")).alias("text"), F.when(k % 12 == 0, doi(5000, "M")).alias("meta"))
    return files.pdf_doi(given)


@query("SELECT r_name AS element, r_regionkey + 0.5 AS y_value FROM region WHERE r_regionkey > 0")
def s13_stated_values(spark: SparkSession, sf: str) -> DataFrame:
    """Stated values committed with an extraction; one without an element is left out."""
    from solvlake.plans.store import Store

    regions = t(spark, sf, "region")
    store = Store(spark, files.workspace(spark, "store"))
    rows_ = conform(regions.select(F.col("r_name").alias("element"), F.col("r_regionkey").alias("row_ord")), keep=("row_ord",))
    stated = regions.select(F.col("r_regionkey").alias("endpoint_ord"), F.when(F.col("r_regionkey") > 0, F.col("r_name")).alias("element"), F.lit(3.0).alias("x_value"), F.lit("pH").alias("x_basis"), (F.col("r_regionkey") + 0.5).alias("y_value"), F.lit("Extract%").alias("y_metric"), F.lit("q").alias("source_quote"))
    store.commit_extraction(rows_, stated, content_sha256="one", pdf_path="one.pdf", prompt_version="extraction_v5")
    return store.views()["text_endpoints"].select("element", "y_value")


@query("SELECT o_custkey AS page, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS x0 FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1")
def a18_largest_image(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("o_orderkey") % 3 > 0, "image").otherwise("rect")
    objects = t(spark, sf, "orders").select(F.col("o_custkey").alias("page"), kind.alias("kind"), F.col("o_orderkey").alias("x0"), F.lit(0).alias("top"), F.lit(0).alias("x1"), F.lit(0).alias("bottom"), F.col("o_totalprice").alias("width"), F.lit(1.0).alias("height"))
    return curves.largest_image(objects, ["page"]).select("page", "image.x0")


@query("SELECT r_regionkey AS page, 2 * r_regionkey + 9.5 AS cx, 14.5 AS cy, 96 AS area, 10 AS bbox_w, 0.96 AS fill_ratio FROM region")
def f25_blobs(spark: SparkSession, sf: str) -> DataFrame:
    """A square of ten pixels, a line that opening takes away, and a speck, on a white page for each region."""
    def page(k: int) -> bytearray:
        grey = [bytearray([255] * 60) for _ in range(40)]
        for y in range(10, 20):
            grey[y][2 * k + 5 : 2 * k + 15] = bytes(10)
        grey[30][:] = bytes(60)
        grey[5][50] = 0
        return bytearray(b"".join(grey))

    regions = t(spark, sf, "region").collect()  # five rows
    images = spark.createDataFrame([(r.r_regionkey, 40, 60, page(r.r_regionkey)) for r in regions], "page int, height int, width int, pixels binary")
    return curves.detect_blobs(images, ["page"]).select("page", "cx", "cy", "area", "bbox_w", F.round("fill_ratio", 6).alias("fill_ratio"))
