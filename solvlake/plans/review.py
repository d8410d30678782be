"""From an uploaded paper to a decision: previews, the staging folder, and what a reviewer can do.

A staged item is a folder of rows and a JSON sidecar, which is put in place last and removed first, so an
item is there whole or not at all. Rejecting one removes it and writes nothing to the store.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvlake.operators.versions import find_duplicates
from solvlake.sources import files


def preview(uploads: DataFrame, pages: DataFrame, known: DataFrame) -> DataFrame:
    """uploads: content_sha256, path (one row a file, as pdfs() gives them); pages: content_sha256, page_index,
    text, meta, title, has_image, has_text; known: the papers that are there. For each upload its DOI, title,
    page count, raster verdict, the paper it is already (match_id, reason), and its status."""
    key = "content_sha256"
    told = uploads.select(key, "path").join(files.pdf_doi(pages, key), key, "left").join(files.inspect(pages, key, title="title"), key, "left")
    matched = find_duplicates(told.withColumn("n_pages", F.coalesce("n_pages", F.lit(0))), known)
    status = F.when(F.col("match_id").isNull(), "new").otherwise(F.concat(F.lit("existing (paper_id="), F.col("match_id").cast("string"), F.lit(")")))
    return matched.withColumn("status", status)


def included(previews: DataFrame, wanted: DataFrame, key: str = "content_sha256") -> tuple[DataFrame, DataFrame]:
    """(to extract, already present) among the previews that the reviewer has ticked (wanted: key)."""
    ticked = previews.join(wanted.select(key).distinct(), key, "left_semi")
    return ticked.filter("match_id IS NULL"), ticked.filter("match_id IS NOT NULL")


class Staging:
    """Extractions that wait for a review."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self, item: str) -> tuple[str, str]:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", item):
            raise ValueError("an item id has letters, digits, _ . - only")
        return f"{self.path}/rows/{item}", f"{self.path}/meta/{item}.json"

    def stage(self, item: str, rows: DataFrame, meta: dict) -> bool:
        """False if the item is staged already."""
        folder, sidecar = self._names(item)
        if item in self._listed("meta"):
            return False
        rows.write.mode("overwrite").parquet(folder)
        return files.publish_text(self.spark, sidecar, json.dumps(meta | {"item_id": item}))

    def _listed(self, part: str) -> set[str]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return set()
        names = (x.getPath().getName() for x in fs.listStatus(at))
        return {n.removesuffix(".json") if part == "meta" else n for n in names if not n.startswith(".")}

    def restore(self, schema: str) -> DataFrame:
        """The sidecars of all staged items; a sidecar without rows is deleted, a corrupt one skipped."""
        held = self._listed("meta")
        for item in held - self._listed("rows"):
            files.delete(self.spark, self._names(item)[1])
        if not held & self._listed("rows"):
            return self.spark.createDataFrame([], schema)
        return files.sidecars(self.spark, f"{self.path}/meta", schema)

    def rows(self, item: str) -> DataFrame:
        return self.spark.read.parquet(self._names(item)[0])

    def reject(self, item: str) -> None:
        """Discards an item; the store is left alone."""
        folder, sidecar = self._names(item)
        files.delete(self.spark, sidecar)
        files.delete(self.spark, folder)
