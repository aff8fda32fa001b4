"""Every query with SQL gives the rows of its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from compare import rows

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in Path(DATA).iterdir():
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_broken_subpackage_is_an_error_and_a_missing_one_is_not(tmp_path):
    import shutil
    import subprocess
    import sys

    root = Path(entry.__file__).parent
    copy = tmp_path / "repo"
    shutil.copytree(root / "wardline", copy / "wardline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", copy)
    load = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=copy, env={"PATH": ""}, capture_output=True, text=True)
    assert load().returncode == 0
    (copy / "wardline/llm").mkdir()
    (copy / "wardline/llm/__init__.py").write_text("")
    (copy / "wardline/llm/queries.py").write_text("import wardline.llm.gone\n")
    assert load().returncode != 0
