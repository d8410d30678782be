"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by pattern in every whole text. Each candidate value is hashed, and for each hash
the distinct repositories and owners that hold it are counted over the corpus. A value that several
owners and repositories share is a widely copied example; one that few share looks live. Patterned
candidates (assign, access, hex) are always spans; opaque tokens, which only look random, become spans
when they are owner-specific.

Positions are code points, from 0, end exclusive. They come from the pieces between matches, so no
Python runs: splitting a text at a pattern and extracting all its matches walk the same leftmost,
non-overlapping occurrences.

Rows and values, case by case:
- null text: treated as empty. Empty text: no spans; the hash is that of the empty string.
- null repository or owner: counts as one repository or owner of its own.
- repeated rows: each gives a row; the repetition does not add a repository or owner.
- ties: spans with one start are ordered by kind. Empty table: no rows. Very long texts: scanned whole.
- further columns: ignored by scan(), carried along unchanged by redact().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solvlake.llm.shared import cut

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
OPAQUE = "[A-Za-z0-9+/_-]+"
#: Cheap tests that a text must pass to hold a valid match; they decide nothing else.
HINTS = {"assign": r"""(?i)(?:word|passwd|secret|token|key)["']?\x20*[:=]""", "access": "AKIA[A-Z0-9]{12}", "hex": "[0-9a-f]{32}", "opaque": "[A-Za-z0-9+/_-]{20}"}
KINDS = ("assign", "access", "hex", "opaque")
#: A value held by so many owners and repositories is a widely copied example.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOS = 5
#: Elements of a block of a scan; code points of a part of a text.
BLOCK = 64
CHARS = 4096


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, though f names it often."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _smaller(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _scan(values: Column, f: Callable[[Column, Column], Column], levels: int = 3) -> Column:
    """Of an array without NULLs: f over the elements up to each. Blocks of 64 are scanned on their own, and then
    what their ends come to, so that the work grows with the array and not with its square."""
    return _let(values, lambda v: _scanned(v, f, levels))


def _scanned(values: Column, f: Callable[[Column, Column], Column], levels: int) -> Column:
    def whole(block: Column) -> Column:
        return F.transform(block, lambda x, i: F.aggregate(F.slice(block, F.lit(1), i), x, f))

    if not levels:
        return whole(values)

    def carried(inner: Column, ends: Column) -> Column:
        return F.flatten(F.transform(inner, lambda block, k: F.when(k == 0, block).otherwise(_let(F.get(ends, k - 1), lambda ahead: F.transform(block, lambda x: f(ahead, x))))))

    number = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), number), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))
    scanned = _let(F.transform(blocks, whole), lambda inner: _let(_scan(F.transform(inner, lambda b: F.element_at(b, -1)), f, levels - 1), lambda ends: carried(inner, ends)))
    return F.when(F.size(values) == 0, values).when(F.size(values) <= BLOCK, whole(values)).otherwise(scanned)


def _found(text: Column, kind: str, pattern: str, value_group: int) -> Column:
    """Matches of a pattern as array<struct<start, rank, end, value>>."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    # each gap is followed by a match, but for the last
    steps = F.transform(F.arrays_zip(gaps.alias("g"), whole.alias("m")), lambda p: p["g"] + F.coalesce(F.length(p["m"]), F.lit(0)))
    ends = _scan(steps, lambda a, x: a + x)
    return F.transform(
        F.filter(F.arrays_zip(whole.alias("m"), value.alias("v"), ends.alias("e")), lambda p: p["m"].isNotNull()),
        lambda p: F.struct((p["e"] - F.length(p["m"])).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), p["e"].alias("end"), p["v"].alias("value")),
    )


def _kind(text: Column, kind: str) -> Column:
    """Valid spans of one kind; texts without a hint are not searched."""
    pattern, group, valid = {
        "assign": (ASSIGN, 2, lambda s: F.length(s["value"]) >= 8),
        "access": (ACCESS, 0, lambda s: F.length(s["value"]) >= 16),
        "hex": (HEX, 0, lambda s: F.length(s["value"]) >= 32),
        "opaque": (OPAQUE, 0, lambda s: (F.length(s["value"]) >= 20) & s["value"].rlike("[0-9].*[0-9].*[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")),
    }[kind]
    # long runs only: a shorter run is never valid, and leaving it out moves no other match
    long_run = {"access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}", "opaque": "[A-Za-z0-9+/_-]{20,}"}.get(kind, pattern)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")
    return F.when(text.rlike(HINTS[kind]), F.filter(_found(text, kind, long_run, group), valid)).otherwise(none)


def _clear(spans: Column) -> Column:
    """Of spans by start, the opaque ones that no other kind overlaps: the others before them have ended, and the
    next one begins behind them."""
    opaque = lambda s: s["rank"] == KINDS.index("opaque")
    ended = _scan(F.transform(spans, lambda s: F.when(opaque(s), 0).otherwise(s["end"])), _larger)
    begins = F.reverse(_scan(F.reverse(F.transform(spans, lambda s: F.when(opaque(s), 2**31 - 1).otherwise(s["start"]))), _smaller))
    told = F.arrays_zip(spans.alias("s"), ended.alias("ended"), begins.alias("begins"))
    return F.transform(F.filter(told, lambda p: opaque(p["s"]) & (p["ended"] <= p["s"]["start"]) & (p["begins"] >= p["s"]["end"])), lambda p: p["s"])


def candidates(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str) -> DataFrame:
    """doc, repo, owner, text_hash, base and opaque spans of every row; no text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(
        docs[id_col].alias("doc"), docs[repo_col].cast("string").alias("repo"), docs[owner_col].cast("string").alias("owner"), F.xxhash64(docs[text_col]).alias("text_hash"), *[_kind(text, k).alias(k) for k in KINDS]
    )
    clear = F.when((F.size("opaque") == 0) | (F.size("base") == 0), F.col("opaque")).otherwise(_let(F.sort_array(F.concat("base", "opaque")), _clear))
    return found.withColumn("base", F.sort_array(F.concat("assign", "access", "hex"))).select("doc", "repo", "owner", "text_hash", "base", clear.alias("opaque"))


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, n_repos, n_owners of every candidate value over the corpus."""
    each = found.select("repo", "owner", F.explode(F.concat("base", "opaque")).alias("s"))
    seen = each.select(F.sha2("s.value", 256).alias("value_hash"), *[F.coalesce(F.concat(F.lit("="), c), F.lit("")).alias(c) for c in ("repo", "owner")])  # NULL is none of the named
    return seen.groupBy("value_hash").agg(F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"))


def _judged(found: DataFrame, example_owners: int, example_repos: int) -> DataFrame:
    """For each different (doc, text): its spans with their class, as array<struct<start, rank, end, live>>."""
    each = found.select("doc", "text_hash", F.explode(F.concat("base", "opaque")).alias("s")).select("doc", "text_hash", "s.*").withColumn("value_hash", F.sha2("value", 256)).drop("value")
    live = ~((F.col("n_owners") >= example_owners) & (F.col("n_repos") >= example_repos))
    told = each.join(ownership(found), "value_hash").select("doc", "text_hash", F.struct("start", "rank", "end", live.alias("live")).alias("span"))
    return told.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_set("span")).alias("judged"))


def classified(docs: DataFrame, id_col: str, text_col: str, repo_col: str, owner_col: str, example_owners: int, example_repos: int) -> DataFrame:
    """doc, text_hash, judged spans (base ones, and opaque ones that look live) of every row."""
    found = cut(candidates(docs, id_col, text_col, repo_col, owner_col))
    has = F.size(F.concat("base", "opaque")) > 0
    told = _judged(found.filter(has), example_owners, example_repos).withColumnsRenamed({"doc": "doc_", "text_hash": "hash_"})
    rows = found.select("doc", "text_hash", has.alias("has"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,live:boolean>>")
    some = rows.filter("has").join(told, F.col("doc").eqNullSafe(F.col("doc_")) & F.col("text_hash").eqNullSafe(F.col("hash_")), "left")
    spans = F.filter("judged", lambda s: (s["rank"] < KINDS.index("opaque")) | s["live"])
    return some.select("doc", "text_hash", spans.alias("spans")).unionByName(rows.filter("NOT has").select("doc", "text_hash", none.alias("spans")))


def _text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """A row for each document: counts of each kind, all spans, and how many look live or are examples."""
    rows = classified(docs, id_col, text_col, repo_col, owner_col, example_owners, example_repos)
    of = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == KINDS.index(k))).cast("long")
    return rows.select(
        F.col("doc").alias(id_col), *[of(k).alias(f"n_{k}") for k in KINDS], F.sha2(_text(F.filter("spans", lambda s: s["rank"] < KINDS.index("opaque"))), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"), F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )


def _masked(spans: Column, ended: Column, parts: Column, mask: str) -> Column:
    """The text, given in parts of CHARS code points, with a mask in place of spans; those that overlap are one."""
    def between(a: Column, b: Column) -> Column:
        first, last = F.floor(a / CHARS).cast("int"), F.floor(b / CHARS).cast("int")
        part = lambda k: F.coalesce(F.get(parts, k), F.lit(""))
        inside = F.substring(part(first), a - first * CHARS + 1, b - a)
        across = F.concat(F.substring(part(first), a - first * CHARS + 1, F.lit(CHARS)), F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(part(last), F.lit(1), b - last * CHARS))
        return F.when(first == last, inside).otherwise(across)

    before = lambda i: F.when(i == 0, 0).otherwise(F.get(ended, i - 1))
    pieces = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(between(before(i), s["start"]), F.lit(mask))).otherwise(""))
    return F.concat(F.array_join(pieces, ""), between(F.element_at(ended, -1), F.size(parts) * CHARS))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", mask: str = "[secret]", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """All documents and columns; live-looking spans are replaced by the mask, widely copied examples stay."""
    rows = classified(docs, id_col, text_col, repo_col, owner_col, example_owners, example_repos)
    live = rows.select("doc", "text_hash", F.filter("spans", lambda s: s["live"]).alias("_live")).filter(F.size("_live") > 0).distinct()
    text = docs[text_col]
    masked = _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHARS}}}"), F.lit(0)), lambda parts: _let(_scan(F.transform(live["_live"], lambda s: s["end"]), _larger), lambda ended: _masked(live["_live"], ended, parts, mask)))
    joined = docs.join(live, docs[id_col].eqNullSafe(live["doc"]) & F.xxhash64(docs[text_col]).eqNullSafe(live["text_hash"]), "left")
    return joined.select(*[F.when(live["_live"].isNull(), text).otherwise(masked).alias(c) if c == text_col else docs[f"`{c}`"] for c in docs.columns])


_P = "[Pp][Aa][Ss][Ss][Ww]"
_SQL_ASSIGN = f"({_P}[Oo][Rr][Dd]|{_P}[Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"


def _sql_kind(kind: str, pattern: str, group: int, valid: str) -> str:
    return f"""SELECT row, doc_id, source, {KINDS.index(kind)} AS rank, start, start + length(m) AS stop, v AS value FROM (
      SELECT row, doc_id, source, m[k] AS m, v[k] AS v, (list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0))::INT AS start
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM (
        SELECT row, doc_id, source, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {group}) AS v, regexp_split_to_array(text, '{pattern}') AS g FROM d))
    ) WHERE {valid}"""


ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
base AS (
  {_sql_kind("assign", _SQL_ASSIGN, 2, "length(v) >= 8")}
  UNION ALL {_sql_kind("access", ACCESS, 0, "length(v) >= 16")}
  UNION ALL {_sql_kind("hex", "[0-9a-f]{32,}", 0, "true")}
), opaque AS (
  SELECT * FROM ({_sql_kind("opaque", "[A-Za-z0-9+/_-]{20,}", 0, "regexp_matches(v, '[0-9].*[0-9].*[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')")}) o
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row = o.row AND b.start < o.stop AND o.start < b.stop)
), found AS (SELECT * FROM base UNION ALL SELECT * FROM opaque),
freq AS (SELECT value, NOT (count(DISTINCT coalesce('=' || source, '')) >= {EXAMPLE_OWNERS} AND count(DISTINCT coalesce('=' || doc_id, '')) >= {EXAMPLE_REPOS}) AS live FROM found GROUP BY value),
told AS (SELECT f.row, f.rank, f.start, f.stop, q.live, ['assign', 'access', 'hex', 'opaque'][f.rank + 1] || ':' || f.start || ':' || f.stop AS span FROM found f JOIN freq q USING (value) WHERE f.rank < 3 OR q.live),
by_row AS (
  SELECT row, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS b, count(*) FILTER (rank = 2) AS c, count(*) FILTER (rank = 3) AS o,
    count(*) FILTER (live) AS l, count(*) FILTER (NOT live) AS e,
    string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM told GROUP BY row)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex, coalesce(o, 0)::BIGINT AS n_opaque,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(l, 0)::BIGINT AS n_live, coalesce(e, 0)::BIGINT AS n_example
FROM d LEFT JOIN by_row USING (row)
"""
