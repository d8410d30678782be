"""Audit of how five filters interact, from a histogram of failure masks.

Native expressions judge each text once and give a mask of five bits, the last from the least id of each
text, which a grouping by the text's digest supplies. The rows of a part (a source) then count in the 32
cells of its histogram, and everything that any order of the filters would do follows from the cells:
all 120 orders are enumerated for each part, with no further look at the documents.

A text is never shuffled: rows of a digest, an id and four bits are. The least id meets the rows by
digest and id, so that a text with many copies is no crowded key.

Rows and values, case by case:
- null text: like an empty one (fails A only, and E if a smaller id has such a text). Null source: the
  part of the empty string. Null id: is no smaller than any id, and has no smaller one; it has no labels.
- repeated rows: each counts; rows with one id are not copies of each other. A document with several
  labels is good or toxic if one of them says so. Ties and very long texts: nothing special.
- empty table: no rows, as there are no parts. Further columns: ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
WORD = r"[^\x20\x09-\x0D]+"
#: Bounds of the contract: least words, least percentage of different words, most percentage of capitals.
LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 2


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: the text fails A, B, C or D."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [n < LEAST_WORDS, F.lit(100).cast("long") * different < F.lit(LEAST_DISTINCT).cast("long") * n, F.lit(100).cast("long") * capitals > F.lit(MOST_CAPITALS).cast("long") * F.length(text), text.rlike(r"[#$%&*|]")]
    mask = F.lit(0)
    for bit, fail in enumerate(fails):
        mask = mask + F.when(fail, 1 << bit).otherwise(0)
    return mask


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, good, toxic of every document."""
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    rows = docs.select(docs[f"`{id_col}`"].alias("id"), F.coalesce(docs[f"`{part_col}`"].cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("bits"))
    first = rows.groupBy("digest").agg(F.min("id").alias("least")).filter("least IS NOT NULL").withColumnRenamed("digest", "first_digest")
    told = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    named = rows.filter("id IS NOT NULL")
    named = named.join(first, (F.col("digest") == F.col("first_digest")) & (F.col("id") == F.col("least")), "left").join(told, F.col("id") == F.col("label_id"), "left")
    no = F.lit(False)
    copy = F.when(F.col("least").isNull(), 16).otherwise(0)
    known = named.select("part", (F.col("bits") + copy).alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    return known.unionByName(rows.filter("id IS NULL").select("part", F.col("bits").alias("mask"), no.alias("good"), no.alias("toxic")))


def histogram(masked: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: at most 32 cells a part."""
    return masked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def _steps() -> Column:
    """Every step of every order: the order, the step, the filter's bit and the bits of the filters before it."""
    rows = []
    for order in ORDERS:
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            rows.append(f"named_struct('filter_order', '{order}', 'step', {step}, 'bit', {bit}, 'before', {before})")
            before |= bit
    return F.expr(f"array({', '.join(rows)})")


def interactions(cells: DataFrame) -> DataFrame:
    """One row for each part, order and step, from the part's cells."""
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 cells at most
    each = parts.select("part", "cells", F.inline(_steps()))
    bit, before = F.col("bit"), F.col("before")

    def total(count: str, fits) -> Column:
        return F.aggregate(F.filter("cells", fits), F.lit(0).cast("long"), lambda s, c: s + c[count])

    has = lambda c, bits: c["mask"].bitwiseAND(bits) != 0
    gone = lambda c: has(c, bit) & ~has(c, before)
    ways = F.array(*[F.lit(len(ORDERS) // k).cast("long") for k in range(1, len(FILTERS) + 1)])
    # of the orders, one in as many as a document fails filters has this filter first among them
    shares = F.aggregate(F.filter("cells", lambda c: has(c, bit)), F.lit(0).cast("long"), lambda s, c: s + (c["n"] * F.get(ways, F.bit_count(c["mask"]) - 1)))
    return each.select(
        "part", "filter_order", "step", total("n", lambda c: ~has(c, bit) & ~has(c, before)).alias("kept"), total("n", gone).alias("removed"), total("n", lambda c: has(c, bit) & has(c, before)).alias("redundant"),
        total("n", lambda c: c["mask"] == bit).alias("unique_fails"), total("good", gone).alias("good_lost"), total("toxic", gone).alias("toxic_lost"), shares.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """What each filter does at each step of each order, within each part."""
    return interactions(histogram(masks(docs, labels, id_col, text_col, part_col)))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
least AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
told AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]+', '', 'g'))) > 2 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask
  FROM w JOIN least USING (text) LEFT JOIN told USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a JOIN f b ON b.bit <> a.bit JOIN f c ON c.bit NOT IN (a.bit, b.bit) JOIN f d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN f e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
steps AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM (SELECT *, unnest(range(1, 6)) AS step FROM orders)),
done AS (SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (bit | before) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM done
"""
