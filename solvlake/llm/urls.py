"""URL filters by hashed host-suffix and path-prefix expressions.

A rule is an expression host + path. Each different (host, path) of the urls is expanded into the
expressions that could be rules: host suffixes of whole labels, joined to path prefixes, of the
shapes (labels, path length) that rules have. Expressions and rules meet by an equi-join on a short
prefix of their digest; the full digest then confirms, and the longest expression wins.

Rows and values, case by case:
- null url, or one without `://`: host and path are empty and no rule fits. Very long urls: whole.
- ties: two fitting rules of one length differ in host; the longer host wins, then block before allow.
- repeated rows: each gives a row. Repeated or null rules: counted once, or ignored.
- empty tables: no pages, no rows; no rules, every url gets the default verdict.
- further columns: ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES: tuple[tuple[str, str, str], ...] = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DEFAULT = "allow"
#: Hex digits of the digest that are joined on.
SHORT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def digested(rules: DataFrame) -> DataFrame:
    """Different rules with expression, digest and short digest."""
    expression = F.concat("host", "path")
    lower = F.translate("host", UPPER, LOWER)
    one = rules.dropna(subset=["verdict", "host", "path"]).withColumn("host", lower).groupBy("host", "path").agg(F.max("verdict").alias("rule_verdict"))
    return one.select(expression.alias("rule"), "rule_verdict", F.col("host").alias("rule_host"), F.sha2(expression, 256).alias("rule_digest"), F.substring(F.sha2(expression, 256), 1, SHORT).alias("short"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length"))


def fits(places: DataFrame, rules: DataFrame) -> DataFrame:
    """For each different (host, path) that a rule fits: the winning rule and its verdict."""
    told = digested(rules)
    # as many shapes as rules have labels times path lengths, whatever the number of rules
    shapes = [(r.labels, r.length) for r in told.select("labels", "length").distinct().collect()]
    if not shapes:
        return places.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("rule_verdict")).limit(0)
    parts = F.split("host", r"\.")
    tail = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), ".")
    expressions = F.array(*[F.when((F.size(parts) >= n) & (F.length("path") >= k), F.concat(tail(n), F.substring("path", 1, k))) for n, k in sorted(shapes)])
    each = places.select("host", "path", F.explode(F.array_compact(expressions)).alias("expression")).withColumn("digest", F.sha2("expression", 256))
    met = each.withColumn("short", F.substring("digest", 1, SHORT)).join(told, "short").filter("digest = rule_digest")
    order = F.struct(F.length("rule"), F.length("rule_host"), "rule_verdict", "rule")
    return met.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), order).alias("won")).select("host", "path", "won.rule", "won.rule_verdict")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """A row for each page: id, host, path, the rule that won (or null), verdict."""
    host, path = host_and_path(pages[url_col])
    rows = pages.select(pages[id_col].alias("id_"), host.alias("host"), path.alias("path"))
    won = fits(rows.select("host", "path").distinct(), rules)
    return rows.join(won, ["host", "path"], "left").select(F.col("id_").alias(id_col), "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))


ORACLE_SQL = f"""
WITH r(verdict, host, path) AS (VALUES {", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)}),
u AS (SELECT row_number() OVER () AS row, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT row, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
fit AS (
  SELECT p.row, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.row ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.verdict DESC) AS k
  FROM p JOIN r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict FROM p LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (row)
"""
