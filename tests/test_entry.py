import subprocess
import sys

import __spark_entry__ as entry

from .conftest import ROOT, SF


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert entry.entry(spark).count() > 0
    assert queries["daily_rollup"](spark, SF).count() > 0


def test_nothing_else_imports_the_corpus_operators():
    code = "import sys; sys.modules['signalpanel.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), e.llm)"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 80 and out[1] == "None"


def test_workers_find_the_package_from_any_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
q = e.queries()
print("rows", q["roi_distribution_pert"](spark, {SF!r}).count())
"""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert "rows 1" in out.stdout, out.stderr[-2000:]
