"""A selection of queries against their SQL on the smallest tables.

``tools/verify.py`` runs all of them at any scale.
"""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leakscan import queries
from leakscan.queries import QUERIES
from tools.verify import TABLES, rows

SF_DIR = "/root/testdata/sf0.001"
CHOSEN = [
    "coverage_summary", "scan_provider", "scan_custom", "scan_generic", "scan_entropy", "scan_k8s_secret", "scan_file_content",
    "xref_dotenv_large", "parse_raw_log", "scan_whole_history", "audit_history", "caveats", "parse_rule_pack", "decode_blob",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def test_every_query_has_sql():
    """Of the library's own queries; some of the training-text ones have none."""
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("left", [("corpus_pipeline.py",), (), ("corpus_pipeline.py", "leakscan/llm/__pycache__/x.pyc")])
def test_the_library_works_without_the_training_text_package(tmp_path, left):
    top = os.path.dirname(os.path.abspath(entry.__file__))
    copy = str(tmp_path / "copy")
    shutil.copytree(top, copy, ignore=lambda folder, names: [n for n in names if n in (".git", "llm", "__pycache__", "corpus_pipeline.py")])
    for name in left:
        os.makedirs(os.path.dirname(f"{copy}/{name}"), exist_ok=True)
        with open(f"{copy}/{name}", "w") as file:
            file.write("from leakscan.llm import queries\n\nQUERIES = SQL = queries.QUERIES\n")
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.QUERIES), set(e.oracle_sql()) <= set(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["True", "True"], done.stderr


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, SF_DIR)
    result = sql.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, result.fetchall())


def test_entry_lists_every_source(spark):
    assert entry.entry(spark).count() == 20


def test_finding_queries_scan_blobs_of_any_size(spark, monkeypatch):
    blobs = queries._blobs
    expected = queries.scan_whole_history(spark, SF_DIR).count()
    monkeypatch.setattr(queries, "_blobs", lambda spark, sf_dir: blobs(spark, sf_dir).withColumn("size", F.lit(64 << 20).cast("bigint")))
    assert queries.scan_whole_history(spark, SF_DIR).count() == expected > 0
    assert queries.caveats(spark, SF_DIR).where("caveat = 'oversized'").count() > 0
