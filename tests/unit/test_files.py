import json

import pytest
from pyspark.sql import functions as F

from solvlake.operators import curves
from solvlake.sources import files


def test_pdfs_are_known_by_content(spark, tmp_path):
    for name, content in {"a.pdf": b"one", "sub/b.pdf": b"one", "c.pdf": b"two", "d.txt": b"three"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = files.pdfs(spark, str(tmp_path)).collect()
    assert sorted(bytes(r.content) for r in got) == [b"one", b"two"] and all(len(r.content_sha256) == 64 for r in got)


def test_prompts_and_names_with_escapes(spark, tmp_path):
    (tmp_path / "extraction v5+1.md").write_text("use {DATA} here")
    (tmp_path / "extraction_v6.md").write_text("nothing")
    assert {r.prompt_version for r in files.prompts(spark, str(tmp_path)).collect()} == {"extraction v5+1", "extraction_v6"}
    checked = files.prompts(spark, str(tmp_path), "{DATA}")
    assert [r.text for r in checked.filter("prompt_version = 'extraction v5+1'").collect()] == ["use {DATA} here"]
    with pytest.raises(Exception, match="extraction_v6"):
        checked.collect()


def test_corrupt_sidecars_are_skipped(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"batch_id": "b1", "item_id": "i", "status": "ended"}))
    (tmp_path / "b.json").write_text("{broken")
    assert [r.batch_id for r in files.sidecars(spark, str(tmp_path)).collect()] == ["b1"]


def test_doi_from_metadata_or_the_first_two_pages(spark):
    pages = spark.createDataFrame([("a", 0, "x 10.1234/text", "10.9999/META."), ("b", 0, "none", None), ("b", 1, "10.1234/second", None), ("c", 2, "10.1234/late", None)], "pdf string, page_index int, text string, meta string")
    assert {r.pdf: r.doi for r in files.pdf_doi(pages).collect()} == {"a": "10.9999/meta", "b": "10.1234/second", "c": None}


def test_inspection(spark):
    pages = [("scan", True, False), ("mixed", True, True), ("mixed", False, True), ("text", False, True), ("bad", None, None)]
    got = {r.pdf: (r.n_pages, r.is_raster_figure) for r in files.inspect(spark.createDataFrame(pages, "pdf string, has_image boolean, has_text boolean")).collect()}
    assert got == {"scan": (1, 1), "mixed": (2, 0), "text": (1, 0), "bad": (0, None)}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("La", 2.5, None)], "element string, ph double, doi string")
    files.export_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).columns == ["Rare Earth Elements (REY:La, Ce, Nd)", "pH", "DOI"]
    files.export_json(df, str(tmp_path / "json"))
    assert json.loads(spark.read.text(str(tmp_path / "json")).first().value)["DOI"] is None
    assert json.loads(files.json_rows(df).first()[0]) == [{"element": "La", "ph": 2.5, "doi": None}]
    assert json.loads(files.curve_json(df, ["element"]).first().result) == {"ph": 2.5, "doi": None}


def test_block_of_text(spark):
    pages = spark.createDataFrame([("p", 2, [19, 19], "confident"), ("p", 0, [27, 12], "unverified")], "pdf string, page_index int, series_counts array<long>, status string")
    assert curves.prompt_block(pages).first().block == "page 0 (estimate): about 2 series with markers 27, 12\npage 2 (authoritative): 2 series with markers 19, 19"
    assert spark.range(1).select(files.raster_verdict(F.lit(False), F.lit(1), F.lit(0)).alias("v")).first().v is None
