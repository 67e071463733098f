"""The driver's contract."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and df.columns[0] == "ticker"


def test_oracles_are_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", ["bars_hourly", "quality_report", "label_o2c", "hourly_strategy"])
def test_against_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("lineitem", "events", "orders"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = db.sql(contract.oracle_sql()[name])
    columns = sorted(want.columns)
    text = lambda row: tuple("" if v is None else f"{v:.7f}" if isinstance(v, float) else str(v) for v in row)
    got = contract.queries()[name](spark, sf).select(*columns).collect()
    assert sorted(map(text, got)) == sorted(map(text, want.select(", ".join(columns)).fetchall()))


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_the_rest_lives_without_the_training_data_operators(tmp_path, with_pipeline):
    """A copy without the subpackage: everything imports, queries and SQL agree, and the other tests are collected."""
    root = Path(contract.__file__).parent
    skipped = shutil.ignore_patterns(".git", "__pycache__", "llm", *([] if with_pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(root, tmp_path / "copy", ignore=skipped)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) > 80 and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q)"
    for command in ([sys.executable, "-c", code], [sys.executable, "-m", "pytest", "tests", "-q", "--collect-only"]):
        done = subprocess.run(command, cwd=tmp_path / "copy", capture_output=True, text=True)
        assert done.returncode == 0, done.stdout + done.stderr
