"""The driver's contract on the smallest data: names and columns fit, and the SQL of a sample of queries agrees."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = ("chk_row_sum", "chk_column_sum", "chk_weighted_average", "prj_column_text", "num_parse", "join_nearest", "agg_median_mad", "dml_upsert", "glossary_exact", "src_xlsx")


def test_importable_without_a_session():
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and len(q) > 90"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def test_core_does_not_use_the_text_subpackage():
    root = os.path.join(os.path.dirname(os.path.abspath(entry.__file__)), "gridloom")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "gridloom.llm" not in open(os.path.join(folder, f), encoding="utf-8").read(), f


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", SAMPLE)
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    want = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in rel.fetchall())
    got = sorted(repr([plain(r[c]) for c in sorted(names)]) for r in df.collect())
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
