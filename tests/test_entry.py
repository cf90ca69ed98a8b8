import os
import subprocess
import sys

import __spark_entry__
import pytest

from helixgrid.plans import catalog, files  # noqa: F401

TABLES = ("documents", "benchmark", "part", "events")


def test_entry(spark):
    assert len(__spark_entry__.entry(spark).collect()) == 20


def test_registry():
    names = set(__spark_entry__.queries())
    assert set(catalog.QUERIES) <= names and set(__spark_entry__.oracle_sql()) <= names


def test_the_rest_stands_alone():
    """Without the corpus subpackage everything else still imports."""
    code = "import sys; sys.modules['helixgrid.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'count_kmers' in e.queries() and not [q for q in e.queries() if q.startswith('op')]"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), con.execute(catalog.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (d[columns].astype(str).sort_values(columns, ignore_index=True) for d in (got, want))
    assert got.equals(want)


def test_stored_queries_push_down(spark, sf):
    """A prefix reaches the scan of the stored table, in the registered queries."""
    for name, prefix in (("stored_prefix", "ACGC"), ("stored_hybrid", "AC")):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert f"StringStartsWith(kmer,{prefix})" in plan.split("PushedFilters")[1]


def test_folders_deleted(tmp_path):
    """The rest imports and answers after the corpus folders and the pipeline are deleted."""
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json"))
    shutil.rmtree(copy / "helixgrid" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 70 and set(e.oracle_sql()) <= set(e.queries()) and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "tests/test_sequence.py"], cwd=copy, check=True, timeout=600)
