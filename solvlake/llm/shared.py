"""The folder that all executors share, for checkpoints and written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from solvlake.sources.files import delete, shared_folder, workspace

#: Paths of the tables that operators have written on their way, by application.
_made: dict[str, list[str]] = {}


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder; its lineage ends there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return workspace(spark, name)


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again."""
    path = place(df.sparkSession, name)
    _made.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return stored(df, path)


def mark(spark: SparkSession) -> int:
    """How many tables operators have written on their way so far, for tidy()."""
    return len(_made.get(spark.sparkContext.applicationId, []))


def tidy(spark: SparkSession, since: int = 0) -> int:
    """Deletes the tables that operators have written on their way since the mark, and says how many. For when
    the results that read them have been stored elsewhere, as they cannot be read any more."""
    paths = _made.get(spark.sparkContext.applicationId, [])
    spent, paths[since:] = paths[since:], []
    for path in spent:
        delete(spark, path)
    return len(spent)
