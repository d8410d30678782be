"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC for text timestamps; double quotes name columns, as the display names need them; AQE splits skewed
#: joins and merges small partitions, so that partition counts need no tuning by hand. Checkpoints go when
#: nothing refers to them any more.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()
