"""Fill-in-the-middle documents, cut at borders of units by relational steps.

A unit is a word with the white space before it, or white space at the end of the text. Each text's units
are matched and posexploded, and a window's running sum over their lengths gives each unit's end. The two
cut requests of a document join by unit ordinal, the ends that they meet are aggregated to two offsets a
document, and the text is put together again from substrings around markers.

Texts are dealt once, by a row number, and every later step (window, join, aggregate, join) reuses that
partitioning; units are never shuffled. Documents whose form is plain need no cut and are not dealt.

The form and the cuts follow from a digest of the seed and the document's id alone, so that a rerun or
another cluster makes the same documents.

Rows and values, case by case:
- null text: like an empty one; plain. Null id: like an id without digits.
- text that holds a marker: plain, since its parts could not be told from the output.
- repeated rows: each gives the same row. Ties (two equal cuts): an empty middle.
- very long texts: whole; their units are rows. Empty table: no rows.
- further columns: ignored by rearrange().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEED = 42
#: Of 100 documents, those that are rearranged; of 100 of these, those with the suffix first.
RATE = 50
SUFFIX_FIRST = 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"


def draw(seed: int, id_col: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits of the id's digest, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def chosen_form(seed: int, id_col: Column, text: Column, rate: int, suffix_first: int) -> Column:
    unfit = (text == "") | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    return F.when(unfit | (draw(seed, id_col, 3) % 100 >= rate), "plain").when(draw(seed, id_col, 4) % 100 < suffix_first, "spm").otherwise("psm")


def _cuts(n: Column, seed: int) -> list[Column]:
    """The two cut requests of a document of n units, as numbers of units before the cut."""
    first, second = (draw(seed, F.col("id"), k) % (n + 1) for k in (1, 2))
    return [F.least(first, second), F.greatest(first, second)]


def offsets(dealt: DataFrame, seed: int) -> DataFrame:
    """row, n, first and second cut in code points, of texts (row, id, text) dealt by row."""
    parts = dealt.select("row", "id", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)).alias("units"))
    # no cut lies behind the second one
    ahead = parts.select("row", F.posexplode(F.slice("units", F.lit(1), _cuts(F.size("units"), seed)[1].cast("int"))).alias("ordinal", "unit"))
    so_far = Window.partitionBy("row").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ahead.select("row", "ordinal", F.length("unit").cast("long").alias("length")).select("row", (F.col("ordinal") + 1).alias("ordinal"), F.sum("length").over(so_far).alias("end"))
    n = F.regexp_count("text", F.lit(UNIT)).cast("long")
    requests = dealt.select("row", "id", n.alias("n")).select(F.col("row").alias("request"), "n", *[c.alias(x) for c, x in zip(_cuts(F.col("n"), seed), ("u", "v"), strict=True)])
    met = requests.join(ends, (F.col("request") == F.col("row")) & F.col("ordinal").isin(F.col("u"), F.col("v")), "left")
    at = lambda cut: F.coalesce(F.max(F.when(F.col("ordinal") == F.col(cut), F.col("end"))), F.lit(0))
    return met.groupBy("request").agg(F.max("n").alias("n"), at("u").alias("first"), at("v").alias("second"))


def restored(form: Column, output: Column) -> Column:
    """The text that an output of a form was made from."""
    after = lambda marker: F.instr(output, marker) + len(marker)
    between = lambda a, b: F.substring(output, after(a), F.instr(output, b) - after(a))
    middle = F.substring(output, after(MIDDLE), F.length(output))
    return F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))).when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))).otherwise(output)


def rearrange(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row for each document: id, n units, form, prefix_chars, middle_chars, output."""
    id_, text = docs[f"`{id_col}`"], F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    formed = docs.select(id_.alias("id"), text.alias("text"), chosen_form(seed, id_, text, rate, suffix_first).alias("form"))
    none = F.lit(None).cast("long")
    plain = formed.filter("form = 'plain'").select("id", F.regexp_count("text", F.lit(UNIT)).cast("long").alias("n"), "form", none.alias("prefix_chars"), none.alias("middle_chars"), F.col("text").alias("output"))
    # every branch below reads all three columns, so that one exchange serves them all
    dealt = formed.filter("form <> 'plain'").select(F.monotonically_increasing_id().alias("row"), "id", "text").repartition("row")
    cuts = offsets(dealt, seed)
    whole = dealt.join(cuts, F.col("row") == F.col("request"))
    prefix, middle = F.substring(F.col("text"), F.lit(1), F.col("first").cast("int")), F.substring(F.col("text"), F.col("first").cast("int") + 1, (F.col("second") - F.col("first")).cast("int"))
    suffix = F.substring(F.col("text"), F.col("second").cast("int") + 1, F.length("text"))
    form = chosen_form(seed, F.col("id"), F.col("text"), rate, suffix_first)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    moved = whole.withColumn("form", form).select("id", "n", "form", F.col("first").alias("prefix_chars"), (F.col("second") - F.col("first")).alias("middle_chars"), F.when(F.col("form") == "psm", psm).otherwise(spm).alias("output"))
    return plain.unionByName(moved).withColumnRenamed("id", id_col)


def digests(made: DataFrame) -> DataFrame:
    """The rows of rearrange() with digests of the output, and of the text rebuilt from it, in the output's place."""
    return made.withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("form"), F.col("output")), 256)}).drop("output")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, list_transform(regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'), lambda x: length(x)) AS lens,
  list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(h, k, 8))::BIGINT) AS draws FROM d),
c AS (SELECT *, len(lens) AS n, least(draws[1] % (len(lens) + 1), draws[2] % (len(lens) + 1)) AS a, greatest(draws[1] % (len(lens) + 1), draws[2] % (len(lens) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR draws[3] % 100 >= 50 THEN 'plain' WHEN draws[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
o AS (SELECT *, coalesce(list_sum(lens[1:a]), 0)::BIGINT AS p, coalesce(list_sum(lens[1:b]), 0)::BIGINT AS q FROM c),
s AS (SELECT *, left(text, p) AS pre, substr(text, p + 1, q - p) AS mid, substr(text, q + 1) AS suf FROM o)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE pre || mid || suf END) AS restored_sha256
FROM s
"""
