"""How registered queries get their results."""

import os

import duckdb
import pytest

from pyspark.sql import functions as F

from recordloom.queries import BUILDERS, SQL
from tests.oracle import compare

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_joins_that_read_counts_build_no_lists(spark):
    frame = BUILDERS["join_grouped_hot_keys"](spark, FOLDER)
    assert "collect_list" not in frame._jdf.queryExecution().optimizedPlan().toString()


ORDERS = "o_orderkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"


def hot_orders(spark, folder, data):
    """The query on a table of one file, and DuckDB on the same table."""
    path = f"{folder}/orders.parquet"
    spark.createDataFrame(data, ORDERS).coalesce(1).write.parquet(path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{path}/*.parquet'")
    return BUILDERS["join_grouped_hot_keys"](spark, str(folder)), db


def test_pairs_of_one_slot_are_made_by_many_tasks(spark, tmp_path):
    data = [(1000 * i, "O", 500000.0 if i % 10 == 0 else 1.0, "1-URGENT") for i in range(200)]
    frame, db = hot_orders(spark, tmp_path, data)
    assert compare(db, SQL["join_grouped_hot_keys"], frame) is None
    assert frame.count() == 200 * 20
    tasks = frame.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) >= 4 and max(t["count"] for t in tasks) <= 200 * 20 // 4


def test_orders_without_key_status_or_priority(spark, tmp_path):
    data = [(1000 * i if i % 5 else None, [None, "O", "F"][i % 3], [None, 1.0, 500000.0, 600000.0][i % 4],
             [None, "1-URGENT"][i % 2]) for i in range(120)]
    frame, db = hot_orders(spark, tmp_path, data)
    assert compare(db, SQL["join_grouped_hot_keys"], frame) is None
    assert frame.count() > 0
