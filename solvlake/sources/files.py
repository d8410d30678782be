"""File sources and sinks: PDFs, prompts, sidecars, exports."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from solvlake.functions.text import find_doi
from solvlake.schema import to_display

STAGED = "batch_id string, item_id string, file string, status string, started_at timestamp, note string"


def file_stem() -> Column:
    """Name of a row's file without its extension; Spark gives names with escapes."""
    name = F.try_url_decode(F.regexp_replace(F.col("_metadata.file_name"), r"\+", "%2B"))
    return F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1)


def pdfs(spark: SparkSession, path: str) -> DataFrame:
    """content_sha256, path, length, content of every PDF below path; equal files once."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    named = files.withColumn("content_sha256", F.sha2("content", 256))
    return named.groupBy("content_sha256").agg(F.min_by(F.struct("path", "length", "content"), "path").alias("f")).select("content_sha256", "f.*")


def prompts(spark: SparkSession, path: str, placeholder: str | None = None) -> DataFrame:
    """prompt_version, text, prompt_sha256 of prompt files. A file without the placeholder is an error when it is read."""
    texts = spark.read.text(path, wholetext=True).select(file_stem().alias("prompt_version"), F.col("value").alias("text"))
    told = texts.withColumn("prompt_sha256", F.sha2("text", 256))
    lacks = F.raise_error(F.concat(F.lit(f"no {placeholder} in prompt "), F.col("prompt_version"))).cast("string")
    return told.withColumn("text", F.when(F.contains("text", F.lit(placeholder)), F.col("text")).otherwise(lacks)) if placeholder else told


def sidecars(spark: SparkSession, path: str, schema: str = STAGED) -> DataFrame:
    """JSON sidecars of a fixed schema; corrupt ones are skipped."""
    read = spark.read.schema(schema + ", _corrupt_record string").option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    return read.withColumn("_bad", F.col("_corrupt_record")).filter("_bad IS NULL").drop("_bad", "_corrupt_record")


def pdf_doi(pages: DataFrame, pdf: str = "pdf", page: str = "page_index", text: str = "text", meta: str = "meta") -> DataFrame:
    """pdf, doi: from the metadata, or else the first of two pages that has one."""
    own = F.coalesce(F.min_by(find_doi(F.col(meta)), F.when(find_doi(F.col(meta)).isNotNull(), F.col(page))), F.min_by(find_doi(F.col(text)), F.when((F.col(page) < 2) & find_doi(F.col(text)).isNotNull(), F.col(page))))
    return pages.groupBy(pdf).agg(own.alias("doi"))


def raster_verdict(readable: Column, images: Column, texts: Column) -> Column:
    """1 where pages with images are no fewer than pages with text, 0 otherwise, NULL if unreadable."""
    return F.when(readable, F.when((images > 0) & (images >= texts), 1).otherwise(0))


def inspect(pages: DataFrame, pdf: str = "pdf", images: str = "has_image", text: str = "has_text", title: str | None = None, page: str = "page_index") -> DataFrame:
    """pdf, n_pages, pages with images and with text, the raster verdict, and, if asked, the title: that of the first page
    whose title is not blank, trimmed. A PDF that cannot be read is a row with NULL flags."""
    said = F.nullif(F.trim(title), F.lit("")) if title else None
    own = [F.min_by(said, F.when(said.isNotNull(), F.col(page))).alias("title")] if title else []
    told = pages.groupBy(pdf).agg(F.count(images).alias("n_pages"), F.count_if(F.col(images)).alias("n_images"), F.count_if(F.col(text)).alias("n_texts"), *own)
    return told.withColumn("is_raster_figure", raster_verdict(F.col("n_pages") > 0, F.col("n_images"), F.col("n_texts")))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only where it is unset and driver and executors are one process, a local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/solvlake-{spark.sparkContext.applicationId}"


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder path where all executors can write."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that all uses see the same rows; its lineage ends there."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def publish_text(spark: SparkSession, path: str, text: str) -> bool:
    """Puts a small file in place whole, by renaming it, unless there is one already: False, and that one
    stays. An empty file is what a writer that died has left, and counts as none."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    if fs.exists(at) and fs.getFileStatus(at).getLen() == 0:
        fs.delete(at, False)
    folder, _, name = path.rpartition("/")
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    write_text(spark, part, text)
    rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(jvm.org.apache.hadoop.fs.Path(part), at, how)
    except Exception as e:
        delete(spark, part)
        if fs.exists(at):
            return False
        raise e
    return True


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, by the file system of its path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def curve_json(results: DataFrame, keys: list[str]) -> DataFrame:
    """keys and a JSON object of all other columns, nulls kept."""
    return results.select(*keys, F.to_json(F.struct(*[c for c in results.columns if c not in keys]), {"ignoreNullFields": "false"}).alias("result"))


def export_csv(df: DataFrame, path: str) -> None:
    to_display(df).write.mode("overwrite").option("header", "true").csv(path)


def export_json(df: DataFrame, path: str) -> None:
    to_display(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_sidecars(df: DataFrame, path: str, name: str) -> None:
    """One JSON file for each row, named by a column, nulls kept; rows reach the driver one partition at a time."""
    each = df.select(F.col(name).cast("string").alias("name"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
    for r in each.toLocalIterator():
        write_text(df.sparkSession, f"{path.rstrip('/')}/{r.name}.json", r.json)


def json_rows(df: DataFrame, order: list[str] | None = None, counted: bool = False) -> DataFrame:
    """One row: a JSON array of all row objects, nulls kept, and, if asked, their number before it. For results of a
    bounded size."""
    each = (df.orderBy(*order) if order else df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j"))
    return each.agg(*[F.count("*").alias("n")] * counted, F.concat(F.lit("["), F.array_join(F.collect_list("j"), ", "), F.lit("]")).alias("rows"))
