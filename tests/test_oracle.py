"""Every registered query against its SQL on the smallest tables."""

import os
import subprocess
import sys

import pytest

from recordloom.queries import BUILDERS, SQL
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", BUILDERS)
def test_query_matches_sql(spark, db, name):
    frame = BUILDERS[name](spark, FOLDER)
    assert compare(db, SQL[name], frame) is None


def test_entry_runs():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_workers_can_import_the_package_anywhere(tmp_path):
    """Run from another folder, so only the shipped package can be found."""
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "import __spark_entry__ as E\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
        ".config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        f"print('rows', E.queries()['headings'](s, {FOLDER!r}).count())\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, text=True,
                          capture_output=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]


def test_sorted_queries_are_in_order(spark):
    for name in ("sort_asc_missing_last", "sort_desc_missing_first"):
        got = [(r["value"], r["event_id"]) for r in BUILDERS[name](spark, FOLDER).collect()]
        sign = 1 if "asc" in name else -1
        first = "first" in name
        key = lambda v: ((v[0] is None) != first, sign * (v[0] or 0), v[1])
        assert got == sorted(got, key=key)
