"""Incremental ingestion of response files: new files only, parsed, checked and kept for review.

The checkpoint remembers which files were read, and a batch's output folder bears its number, so that a
batch that runs again writes the same rows to the same place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvlake.operators.qa import run_rules, verdicts
from solvlake.sources.files import file_stem
from solvlake.sources.responses import parse


def responses_in(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """A stream of (custom_id, raw_text): a file is one response, named by its id."""
    files = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", str(per_batch)).load(path)
    return files.select(file_stem().alias("custom_id"), F.col("value").alias("raw_text"))


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, per_batch: int = 1000) -> None:
    """Reads all files that are new, and stops. target/rows, target/endpoints and target/review get a folder a batch;
    a response that cannot be parsed is a row of review with its error."""
    def batch(df: DataFrame, number: int) -> None:
        parsed = [part.persist() for part in parse(df)]  # read by every rule
        rows, endpoints, summary = parsed
        ok = summary.filter("error IS NULL")
        found = verdicts(ok, run_rules(rows, ok, endpoints), ("custom_id",))
        for name, part in {"rows": rows, "endpoints": endpoints, "review": summary.join(found, "custom_id", "left")}.items():
            part.write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")
        for part in parsed:
            part.unpersist()

    query = responses_in(spark, source, per_batch).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def pending(review: DataFrame, committed: DataFrame, key: str = "custom_id") -> DataFrame:
    """What is staged and not committed yet; survives restarts, as both sides are tables."""
    return review.join(committed.select(key), key, "left_anti")
