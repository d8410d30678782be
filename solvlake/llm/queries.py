"""The queries of this subpackage for the entry module, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvlake.llm import audit, decontam, infill, langid, ngram_join, packing, quality, secrets, shared, substrings, tokens, toxicity, urls, vectors

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches, each of which is sent twice and counts once: every document is inserted,
    those without a language are revised to `und`, and those without text are deleted."""
    docs = _table(spark, sf_dir, "documents")
    rollup = tokens.Rollup(spark, shared.place(spark, "token-rollup"))
    unnamed = docs.filter("lang IS NULL")
    batches = {"load": tokens.inserts(docs), "name": tokens.revisions(unnamed, unnamed.withColumn("lang", F.lit("und"))), "clear": tokens.deletes(docs.filter("text IS NULL OR text = ''").withColumn("lang", F.coalesce("lang", F.lit("und"))))}
    for batch, changes in batches.items():
        rollup.commit(batch, changes)
        rollup.commit(batch, changes)
    return rollup.totals()


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.match(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("longest_at", F.col("longest_at").cast("double"))  # may be NULL


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(_table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measure(_table(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.rearrange(_table(spark, sf_dir, "documents")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.links(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_token_rollup, op2_decontaminate, op3_toxicity, op4_secrets, op5_packing, op6_substrings, op7_ngram_join, op8_quality, op9_urls, op10_language, op11_infill, op12_filter_audit, op13_vectors)}
ORACLE_SQL: dict[str, str] = {f"op{n}": sql for n, sql in {"2_decontaminate": decontam.ORACLE_SQL, "4_secrets": secrets.ORACLE_SQL, "6_substrings": substrings.ORACLE_SQL, "7_ngram_join": ngram_join.ORACLE_SQL, "9_urls": urls.ORACLE_SQL, "11_infill": infill.ORACLE_SQL, "12_filter_audit": audit.ORACLE_SQL, "13_vectors": vectors.ORACLE_SQL}.items()}
