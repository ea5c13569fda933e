"""Every registered query of the library against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from corpusgraph import registry

DATA = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in sorted(Path(DATA).glob("*.parquet")):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    rows = [tuple(map(plain, r)) for r in got.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got.columns
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == sorted(got.columns)
    at = [got.columns.index(c) for c in want.columns]
    assert sorted(repr(tuple(r[i] for i in at)) for r in rows) == sorted(repr(tuple(map(plain, r))) for r in want.fetchall())


def test_entry_imports_without_the_optional_parts():
    """The entry module and all queries of the library load when the subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    import tempfile

    root = Path(__file__).resolve().parents[1]
    with tempfile.TemporaryDirectory() as d:
        shutil.copytree(root / "corpusgraph", f"{d}/corpusgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(root / "__spark_entry__.py", d)
        said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'bm25_top8' in e.queries())"], cwd=d, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": d}, check=False)
    assert said.stdout.split() == [str(len(NAMES)), "True"], said.stderr
