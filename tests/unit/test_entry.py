import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from solvlake import queries

ROOT = Path(__file__).parents[2]


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).columns == ["paper_id", "n_rows", "price_min", "price_median", "price_max"]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_runs_without_the_language_data_subpackage(tmp_path, pipeline):
    """A copy of the repository without those folders, with or without the pipeline's module."""
    shutil.copytree(ROOT / "solvlake", tmp_path / "solvlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *["corpus_pipeline.py"] * pipeline):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e; print(e.__file__, len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, check=True).stdout.split()
    assert said == [str(tmp_path / "__spark_entry__.py"), str(len(queries.QUERIES)), str(len(queries.ORACLE_SQL)), "False"]


@pytest.mark.parametrize("name", ["w1_current_best_ranges", "j3_paper_list", "w2_monotonicity", "a16_calibration", "f16_solve", "e13_prepass", "d5_calculator"])
def test_queries_agree_with_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    small = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    found = queries.QUERIES[name](spark, small)
    columns = sorted(found.columns)
    got = sorted(str([round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in columns)]) for r in found.collect())
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert got == sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in want)
