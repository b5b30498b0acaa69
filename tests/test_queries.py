"""Every registered query against its SQL on the smallest tables."""

import math

import pytest

from folioflow.queries import FLAGSHIP, ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}") + 0.0
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    assert sorted(map(repr, got)) == sorted(repr(tuple(norm(row[i]) for i in at)) for row in found.fetchall())


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES and FLAGSHIP in ORACLES


def test_entry_gives_the_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())


def test_entry_works_without_the_llm_part(tmp_path):
    """A copy without the subpackage, its tests and the pipeline has the library's queries and no others; a broken subpackage is an error."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "folioflow", tmp_path / "folioflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    ask = [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"]
    run = lambda: subprocess.run(ask, cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert run().stdout.split() == [str(len(QUERIES)), str(len(ORACLES))]
    (tmp_path / "folioflow/llm").mkdir()
    (tmp_path / "folioflow/llm/__init__.py").write_text("")
    (tmp_path / "folioflow/llm/queries.py").write_text("import no_such_module")
    assert "no_such_module" in run().stderr
