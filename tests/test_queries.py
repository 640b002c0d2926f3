import os
import shutil
import subprocess
import sys

import pytest
from conftest import SMALL, same_rows

from raysheaf.plans.queries import ORACLES, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    assert same_rows(QUERIES[name](spark, SMALL).toPandas(), duck.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_optional_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; names = e.queries(); assert 'weighted_averages' in names and not any(n.startswith('op') for n in names), names"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_plans_push_down_and_avoid_nested_loops(spark):
    plan = QUERIES["radius_neighbour_count"](spark, SMALL)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    plan = QUERIES["weighted_averages"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "event_type" not in plan.split("ReadSchema")[1]
