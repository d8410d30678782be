"""Guarded ad-hoc SQL: one read-only statement over allowed relations, limited and timed.

The text is checked for what it must not be; the parsed plan, never run, for the relations it reads. The
query then runs in a session that knows the allowed relations only.
"""

from __future__ import annotations

import json
import re
import threading
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from solvlake.plans import dialect
from solvlake.sources.files import json_rows

ALLOWED = ("v_current_best", "papers", "text_endpoints", "prompt_runs")
LIMIT = 500
#: Rows of an answer, which is one string. A query with more of them gets an error, not a part of them.
MOST_ROWS = 10_000
TIMEOUT_S = 5.0
#: Groups of functions that a query may call, and others that it may.
GROUPS = ("agg_funcs", "array_funcs", "bitwise_funcs", "collection_funcs", "conditional_funcs", "conversion_funcs", "date_funcs", "datetime_funcs", "generator_funcs", "hash_funcs", "json_funcs", "lambda_funcs", "map_funcs", "math_funcs", "predicate_funcs", "string_funcs", "struct_funcs", "variant_funcs", "window_funcs")
ALSO = ("typeof", *(f.lower() for f in dialect.FUNCTIONS))
#: Plan nodes of statements that do something; a query has none.
STATEMENTS = ("plans.logical.Command", "plans.logical.ParsedStatement")


class GuardError(ValueError):
    """A query that the guard does not let through."""


def without_comments(sql: str) -> str:
    """The text without comments; literals and quoted names stay as they are."""
    token = r"""('(?:[^'\\]|\\.|'')*'|"(?:[^"]|"")*"|`(?:[^`]|``)*`)|(--[^\n]*|/\*.*?\*/)"""
    return re.sub(token, lambda m: m[1] if m[1] is not None else " ", sql, flags=re.DOTALL).strip()


def _bare(sql: str) -> str:
    """The text with literals and quoted names blanked, for looking at keywords."""
    return re.sub(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"]|"")*"|`(?:[^`]|``)*`""", "''", sql, flags=re.DOTALL)


def relations(spark: SparkSession, sql: str) -> tuple[list[str], set[str], str]:
    """Relations that the parsed query reads, names its CTEs define, and the root node's name."""
    from py4j.java_gateway import is_instance_of
    from pyspark.errors import ParseException

    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise GuardError(f"query failed: {str(e).splitlines()[0]}") from None
    read: list[str] = []
    defined: set[str] = set()
    for node in dialect.nodes(plan):
        kind = node.nodeName()
        if any(is_instance_of(spark.sparkContext._gateway, node, f"org.apache.spark.sql.catalyst.{c}") for c in STATEMENTS):
            raise GuardError(f"a query may only read; this has {kind}")
        if kind == "UnresolvedRelation":
            read.append(node.name().replace("`", ""))
        elif kind == "UnresolvedTableValuedFunction":
            raise GuardError("table functions are not on the allow-list")
        elif kind == "UnresolvedWith":
            pairs = node.cteRelations()
            defined |= {pairs.apply(i)._1().lower() for i in range(pairs.size())}
    for e in dialect.expressions(plan):
        if e.getClass().getSimpleName() == "UnresolvedFunction":
            parts = e.nameParts()
            name = ".".join(parts.apply(i) for i in range(parts.size())).lower()
            if not callable_(spark, name):
                raise GuardError(f"the function {name} is not on the allow-list")
    return read, defined, plan.nodeName()


def callable_(spark: SparkSession, name: str) -> bool:
    """Whether a query may call a function: built in and of an allowed group, or named. What there is not may pass, as
    the engine says so itself."""
    if name in ALSO:
        return True
    registry = spark._jsparkSession.sessionState().functionRegistry()
    found = registry.lookupFunction(spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier(name))
    return not found.isDefined() or found.get().getGroup() in GROUPS


def check(spark: SparkSession, sql: str, allowed: tuple[str, ...] = ALLOWED) -> tuple[str, bool]:
    """The query to run, and whether it limits its own result; GuardError if it is not let through."""
    clean = without_comments(sql)
    if not clean:
        raise GuardError("there is no query")
    body = clean[:-1].rstrip() if clean.endswith(";") else clean
    bare = _bare(body)
    if ";" in bare:
        raise GuardError("one statement at a time")
    if not re.match(r"(SELECT|WITH)\b", bare, re.IGNORECASE):
        raise GuardError("a query starts with SELECT or WITH")
    read, defined, root = relations(spark, body)
    if clash := defined & set(allowed):
        raise GuardError(f"a CTE may not take a name of the allow-list: {sorted(clash)}")
    if other := {r for r in read if r.lower() not in allowed and r.lower() not in defined}:
        raise GuardError(f"not on the allow-list: {sorted(other)}; allowed: {sorted(allowed)}")
    return body, root == "GlobalLimit" or root == "UnresolvedWith" and bool(re.search(r"\bLIMIT\s+\d+\s*$", bare, re.IGNORECASE))


def guarded(spark: SparkSession, sql: str, views: Mapping[str, DataFrame], limit: int = LIMIT, sqlite: bool = False) -> DataFrame:
    """The guarded query over the given relations; at most limit rows unless it sets its own limit. sqlite: in
    SQLite's meaning (see `dialect`)."""
    own = spark.newSession()
    for key, value in {"spark.sql.ansi.doubleQuotedIdentifiers": "true", "spark.sql.runSQLOnFiles": "false", "spark.sql.session.timeZone": "UTC"}.items():
        own.conf.set(key, value)
    body, limited = check(own, sql, tuple(v.lower() for v in views))
    for name, df in views.items():
        # a view belongs to the session of its frame, so the frame is taken over by its plan
        DataFrame(own._jvm.org.apache.spark.sql.classic.Dataset.ofRows(own._jsparkSession, df._jdf.queryExecution().logical()), own).createOrReplaceTempView(name)
    dialect.register(own)
    found = own.sql(dialect.sqlite(own, body) if sqlite else body)
    return found if limited else found.limit(limit)


def query_database(spark: SparkSession, sql: str, views: Mapping[str, DataFrame], timeout: float = TIMEOUT_S, limit: int = LIMIT, sqlite: bool = True) -> str:
    """JSON rows, or {"error": ...}; never raises for a bad query."""
    tag, late = f"guarded-{uuid.uuid4().hex}", threading.Event()
    context = spark.sparkContext

    def stop() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout, stop)
    try:
        found = guarded(spark, sql, views, limit, sqlite)
        context.addJobTag(tag)
        timer.start()
        n, rows = json_rows(found.limit(MOST_ROWS + 1), counted=True).first()
        return rows if n <= MOST_ROWS else json.dumps({"error": f"more than {MOST_ROWS} rows; ask for fewer with LIMIT, or for totals"})
    except GuardError as e:
        return json.dumps({"error": str(e)})
    except Exception as e:  # whatever the engine says about a query is an answer too
        return json.dumps({"error": f"query failed: {'timeout' if late.is_set() else str(e).splitlines()[0]}"})
    finally:
        timer.cancel()
        context.removeJobTag(tag)
