"""Every registered query beside its SQL on the smallest tables."""

import re
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as driver
from riskloom.catalog.check import compare, sql_connection

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return sql_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, connection, name):
    got = QUERIES[name](spark, FOLDER).toArrow()
    want = connection.execute(SQL[name]).to_arrow_table()
    assert compare(got, want) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).toArrow().num_rows > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    rows = driver.entry(spark)
    assert rows.columns[:2] == ["trial_id", "phase_encoded"] and rows.columns[-1] == "terminated"
    assert rows.count() == 200


def test_entry_without_the_tokenizer_package():
    code = "import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; print(*e.queries())"
    root = Path(driver.__file__).parent
    found = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()
    assert set(QUERIES) - set(found) <= {n for n in QUERIES if re.match(r"op\d+_|pipeline$", n)}
    assert "engineer_features" in found and "pipeline" not in found
