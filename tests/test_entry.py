from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from loamlake.plans.registry import QUERIES, SQL
from loamlake.plans.source_queries import SQL as SOURCE_SQL

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return None if v is None else v.item() if hasattr(v, "item") else v


@pytest.mark.parametrize("name", ["ask", "bm25_topk", "vector_topk", "evidence_classify", "doc_chunks", "quality_gate", "canonical_hash", "line_dedup", "upsert_merge", "identity_collisions", "source_divergence", "confusion_metrics", "page_links", "safe_truncate", *sorted(SOURCE_SQL)])
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rel = duck.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    at = [rel.columns.index(c) for c in cols]
    assert ours == sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())


def test_names():
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and {"ask", *QUERIES} <= set(found)


def test_stands_without_the_pipeline_operators(tmp_path):
    """The entry imports and lists its queries when the subpackage and the pipeline are gone."""
    for name in ("loamlake", "__spark_entry__.py"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ask' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_the_rest_of_the_tests_stands_alone(tmp_path):
    """Without both folders and the pipeline, the other tests are still found and import."""
    for name in ("loamlake", "tests", "__spark_entry__.py", "bench.py"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path / name)
    done = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0 and "test_entry.py" in done.stdout, done.stdout[-2000:]
