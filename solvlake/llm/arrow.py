"""Running a function of Arrow batches over a DataFrame: adding columns, or keeping rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a batch between the JVM and Python. Texts are long: Spark's 10,000 of them take tens of megabytes
#: several times over, in both processes.
BATCH_ROWS = 2048

#: Makes the per-batch function once a task.
Factory = Callable[[], Callable[[pa.RecordBatch], dict[str, object]]]


def pieces(batch: pa.RecordBatch, text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about most bytes of text."""
    if text not in batch.schema.names or batch.nbytes <= most or batch.num_rows < 2:
        yield batch
        return
    step = max(1, batch.num_rows * most // batch.nbytes)
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def small_batches(df: DataFrame) -> None:
    """Holds the session's batches to BATCH_ROWS rows, if they are larger; results do not depend on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, BATCH_ROWS)


def plain(df: DataFrame) -> DataFrame:
    """df with names that mapInArrow can refer to: those with a dot or backtick are replaced."""
    return df.toDF(*[f"__column_{i}" if set(c) & set(".`") else c for i, c in enumerate(df.columns)])


def add_columns(df: DataFrame, keep: list[str], text: str, make: Factory, added: T.StructType) -> DataFrame:
    """Columns keep of df and the added ones that the function returns, a row for each row of df."""
    small_batches(df)
    names = list(dict.fromkeys([*keep, text]))
    source = plain(df.select(*[df[f"`{c}`"] for c in names]))
    inner = dict(zip(names, source.columns, strict=True))
    keep, text, outer = [inner[c] for c in keep], inner[text], [*keep, *added.names]
    schema = T.StructType([source.schema[c] for c in keep] + added.fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for batch in pieces(whole, text):
                made = work(batch)
                arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep] + [made[f.name] for f in added.fields]
                yield pa.RecordBatch.from_arrays([(a if isinstance(a, pa.Array) else pa.array(a)).cast(f.type) for a, f in zip(arrays, arrow, strict=True)], schema=arrow)
        pa.default_memory_pool().release_unused()  # the process stays for other tasks

    return source.mapInArrow(run, schema).toDF(*outer)


def keep_rows(df: DataFrame, text: str, make: Callable[[], Callable[[pa.RecordBatch], np.ndarray]]) -> DataFrame:
    """The rows of df for which the function's mask is true, with every column as it was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for batch in pieces(whole, text):
                yield batch.filter(pa.array(work(batch)))
        pa.default_memory_pool().release_unused()

    small_batches(df)
    source = plain(df)
    return source.mapInArrow(run, source.schema).toDF(*df.columns)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
