"""Registered queries against their SQL on the smallest tables, and the driver contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from idscreen.plans.catalogue import QUERIES
from idscreen.plans.expected import SQL
from tests.conftest import SMALL_DIR
from tests.oracle import compare, connect

WITHOUT_SQL = {
    "near_reuse_minhash",
    "near_vectors_lsh",
    "match_one_to_many_lsh",
    "stage_times_approx",
    "linked_records",  # weights come from EM; held against all pairs in test_linkage
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert compare(spark, connect(SMALL_DIR), name, SMALL_DIR) == []


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL
    assert set(contract.queries()) >= set(QUERIES)
    assert set(contract.oracle_sql()) >= set(SQL)


def test_flagship_entry(spark):
    total = contract.entry(spark).where("level = 7").collect()
    assert [r["cases"] for r in total] == [1_500]


def test_task_functions_need_no_package_on_executors(tmp_path):
    import os
    import subprocess
    import sys

    from pyspark.cloudpickle import cloudpickle

    from idscreen.streaming.cases import _completion, _earliest

    code = "import sys, pickle; print([f.__name__ for f in pickle.loads(sys.stdin.buffer.read())])"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    data = cloudpickle.dumps([_earliest, _completion(["a"], 1)])
    done = subprocess.run([sys.executable, "-c", code], input=data, cwd=tmp_path, env=env, capture_output=True)
    assert done.stdout.decode().strip() == "['_earliest', 'step']", done.stderr.decode()
