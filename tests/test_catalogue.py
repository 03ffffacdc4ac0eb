"""Every query that has SQL gives what DuckDB gives on the plain tables; what can be taken away can be taken away."""

import glob
import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as driver

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return str(value)[:26] if hasattr(value, "isoformat") else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_against_duckdb(spark, small, duck, name):
    df = driver.queries()[name](spark, small)
    found = duck.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    mine = sorted(str([plain(r[c]) for c in sorted(columns)]) for r in df.collect())
    theirs = sorted(str([plain(r[columns.index(c)]) for c in sorted(columns)]) for r in found.fetchall())
    assert mine == theirs


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("gone", [("corpus_pipeline.py", "llm"), ("llm",), ("corpus_pipeline.py",), ("public_tokenizers",)])
def test_stands_alone(tmp_path, gone):
    """Without the corpus operators, or what they need, the rest imports and lists its queries."""
    for name in os.listdir(REPO):
        if name not in (*gone, "loam", ".git"):
            os.symlink(f"{REPO}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "loam")
    for name in os.listdir(f"{REPO}/loam"):
        if name not in gone:
            os.symlink(f"{REPO}/loam/{name}", tmp_path / "loam" / name)
    hide = "import sys; sys.modules['public_tokenizers'] = None; " if "public_tokenizers" in gone else ""
    code = hide + "import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') and n[2].isdigit() for n in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
