"""Every registered query next to its SQL twin on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract
from flightlens.plans.oracle import ORACLES
from flightlens.plans.registry import QUERIES
from tests.oracle_check import connect, duck_rows, mismatch, spark_rows

FOLDER = "/root/testdata/sf0.001"
UNWANTED = (
    "PythonUDF", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "CartesianProduct",
    "NestedLoopJoin",
)


def built(spark, name):
    """The query's frame, whose plan must hold no Python and no cross join."""
    df = contract.queries()[name](spark, FOLDER)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert not [node for node in UNWANTED if node in text]
    return df


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


# Robust smoothers and a penalty chosen by cross-validation; tests/test_stl.py and test_trend.py hold them against plain versions.
WITHOUT_TWIN = {"series_clean_decomposed", "role_trend_spline"}


def test_queries_and_twins_pair_up():
    assert set(ORACLES) == set(QUERIES) - WITHOUT_TWIN


@pytest.mark.parametrize("blocked", ["ahocorasick", "corpus_pipeline", "flightlens.llm"])
def test_entry_without_text_queries(blocked):
    code = f"import sys; sys.modules[{blocked!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(contract.__file__).parent, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))], done.stderr


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal(spark, duck, name):
    assert mismatch(spark_rows(built(spark, name)), duck_rows(duck, ORACLES[name])) is None


def test_entry(spark):
    found = contract.entry(spark)
    assert found.columns == ["flight_day", "aircraft_role", "CO2_daily"] and found.count() > 0
