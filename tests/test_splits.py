import os

import pytest
from pyspark.sql import functions as F

from recordloom.sources import sinks, splits
from recordloom.sources.tree import scan_tree
from recordloom.streaming import incremental as I
from tests.test_sources import put

MB = 1 << 20


def loads(frame):
    return sorted(r[1] for r in frame.groupBy(F.spark_partition_id()).agg(F.sum("size")).collect())


def test_splits_hold_about_the_stated_bytes(spark):
    files = spark.range(2000).selectExpr("id", "if(id = 7, 900, id % 10) as size")
    got = splits.dealt(files, split_bytes=100, open_bytes=1)
    total = 900 + sum(i % 10 for i in range(2000)) - 7
    assert sorted(r["id"] for r in got.collect()) == list(range(2000))
    sums = loads(got)
    assert got.rdd.getNumPartitions() >= (total + 2000) // 100 and got.rdd.getNumPartitions() == len(sums)
    assert sums[-1] == 900 and sums[-2] <= 100


def test_rows_without_bytes_and_no_rows(spark):
    files = spark.sql("select id, cast(null as bigint) as size, 'x' as `__first_` from range(10)")
    got = splits.dealt(files, split_bytes=2, open_bytes=1)
    assert got.columns == files.columns and 5 <= got.rdd.getNumPartitions() <= 9
    assert splits.dealt(files.limit(0)).count() == 0


def test_neighbours_go_together_beyond_the_most(spark, monkeypatch):
    monkeypatch.setattr(splits, "MOST_SPLITS", 4)
    got = splits.dealt(spark.range(100).selectExpr("id", "1 as size"), split_bytes=2, open_bytes=1)
    assert got.count() == 100 and got.rdd.getNumPartitions() <= 4


@pytest.fixture
def small_splits(monkeypatch):
    for function in (splits.dealt,):
        monkeypatch.setattr(function, "__defaults__", ("size", 40_000, 1000))


def test_files_are_opened_and_copied_by_many_tasks(spark, tmp_path, small_splits):
    root, mirror = str(tmp_path / "in"), str(tmp_path / "out")
    put(root, **{f"d{i % 3}/f{i}.bin": b"x" * 9000 for i in range(60)})
    found = scan_tree(spark, root, content=True)
    at_least = 60 * 10_000 // 40_000
    used = found.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("size")).collect()
    assert len(used) >= at_least and max(r[1] for r in used) <= 40_000
    assert found.filter("octet_length(content) = size").count() == 60
    plan = I.changes(found.limit(0), found.drop("content"), carry=["size"])
    assert sinks.copy_files(plan, root, mirror) == 60
    assert sum(len(names) for _, _, names in os.walk(mirror)) == 60


def page(spark, body):
    return spark.createDataFrame([("web", "a.md", 0, body)], "edition string, page_path string, part int, body string")


def test_a_run_counts_when_it_is_whole(spark, tmp_path, monkeypatch):
    site = str(tmp_path / "site")
    assert sinks.published(site) is None
    read = lambda: open(f"{sinks.published(site)}/web/a.md").read()
    sinks.publish_pages(page(spark, "1"), site)
    assert read() == "1"

    def fail(*_):
        raise OSError("injected")

    for step, left in (("write_page_files", "1"), ("_mark_done", "1"), ("_clear_runs", "2")):
        with monkeypatch.context() as patch:
            patch.setattr(sinks, step, fail)
            with pytest.raises(OSError):
                sinks.publish_pages(page(spark, "2"), site)
        assert read() == left
    with pytest.raises(Exception):
        sinks.publish_pages(page(spark, "3").withColumn("body", F.raise_error(F.lit("no")).cast("string")), site)
    assert read() == "2"
    kept = sinks.published(site)
    assert sinks.publish_pages(page(spark, "4"), site) == sinks.published(site)
    assert read() == "4" and open(f"{kept}/web/a.md").read() == "2"
    # This run, the one before, and their marks; nothing of failed or older runs.
    assert len(os.listdir(site)) == 4


def test_very_many_small_files_are_not_as_many_tasks(spark):
    files = spark.range(100_000, numPartitions=4).selectExpr("id", "if(id = 7, 700, 1) as size")
    got = splits.dealt(files, split_bytes=64 * 256, open_bytes=64)
    assert 8 <= got.rdd.getNumPartitions() <= 64  # 392 of 256 files each if every one counted 64
    assert got.count() == 100_000 and got.select("id").distinct().count() == 100_000
    few = splits.dealt(files.filter("id < 1024"), split_bytes=64 * 256, open_bytes=64)
    assert few.rdd.getNumPartitions() >= 4
