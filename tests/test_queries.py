"""Every query of the library against its SQL, and the driver's entry points without the optional subpackage."""

import os
import subprocess
import sys

import duckdb
import pytest

from millrace.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def rows_of(frame):
    columns = sorted(frame.columns)
    return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist())), columns


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    connection = duckdb.connect()
    for file in os.listdir(SF):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    assert rows_of(QUERIES[name](spark, SF).toPandas()) == rows_of(connection.execute(ORACLE_SQL[name]).df())


def test_filters_and_columns_reach_the_scan(spark, capsys):
    QUERIES["op_even_orders"](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan and "Exchange" not in plan
    QUERIES["op_less_than_orders"](spark, SF).explain("formatted")
    assert "ReadSchema: struct<o_custkey:bigint>" in capsys.readouterr().out


def test_top_is_a_top_n_plan(spark, capsys):
    QUERIES["count_by_word_top"](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan and "Python" not in plan and "ReadSchema: struct<text:string>" in plan


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_optional_parts(tmp_path, pipeline):
    """A copy without the subpackage, with corpus_pipeline.py or not, has all queries of the library and no others."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import os, shutil, sys
shutil.copytree({root!r} + "/millrace", {str(tmp_path)!r} + "/millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
shutil.copy({root!r} + "/__spark_entry__.py", {str(tmp_path)!r})
if {pipeline} and os.path.exists({root!r} + "/corpus_pipeline.py"):
    shutil.copy({root!r} + "/corpus_pipeline.py", {str(tmp_path)!r})
sys.path.insert(0, {str(tmp_path)!r})
import __spark_entry__ as e
assert e.__file__.startswith({str(tmp_path)!r})
assert set(e.queries()) == set(e.oracle_sql()) and len(e.queries()) > 20 and not any(k.startswith("op1_") for k in e.queries())
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, timeout=120).returncode == 0
