import os

import pytest
from pyspark.sql import functions as F

from recordloom.operators.views import source
from recordloom.streaming import keyed as K
from tests.conftest import rows

SPEC = {"from": "events", "where": {"not": {"kind": "error"}}, "grouped": {"by": "u"}}


@pytest.fixture
def batches(spark, tmp_path):
    """Ten batches of a stream: a third of all rows have one key."""
    path = str(tmp_path / "in")
    frame = spark.range(300).selectExpr(
        "id", "if(id % 3 = 0, 0, id % 50) as u", "if(id % 7 = 0, 'error', 'ok') as kind", "cast(id div 30 as int) as b")
    for b in range(10):
        frame.filter(F.col("b") == b).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return source(stream, ["id"]), frame


def size(path):
    return sum(os.path.getsize(f"{at}/{n}") for at, _, names in os.walk(path) for n in names if n.endswith(".parquet"))


def test_lists_of_many_batches(spark, batches, tmp_path, monkeypatch):
    stream, frame = batches
    home = str(tmp_path / "kept")
    written = []
    real = K._write
    monkeypatch.setattr(K, "_write", lambda *a: (real(*a), written.append((a[3], a[4], a[5]))))
    K.keep_grouped(stream, home, {}, SPEC, str(tmp_path / "cp"), fan_in=3).awaitTermination()
    # Every batch is written once; three parts of a level become one of the next.
    assert [w for w in written if w[0] == 0] == [(0, n, n) for n in range(10)]
    assert [w for w in written if w[0] > 0] == [(1, 0, 2), (1, 3, 5), (1, 6, 8), (2, 0, 8)]
    assert [(p[0], p[1], p[2]) for p in K.parts(home)] == [(0, 9, 9), (2, 0, 8)] and len(os.listdir(home)) == 2
    items = K.grouped_items(spark, home)
    wanted = {r["u"]: r["ids"] for r in frame.filter("kind <> 'error'").groupBy("u").agg(
        F.sort_array(F.collect_list("id")).alias("ids")).collect()}
    got = {r["u"]: [e["id"] for e in r["events"]] for r in rows(K.grouped_lists(items, SPEC))}
    assert got == wanted
    some = K.grouped_lists(items.filter("u = 7"), SPEC)
    assert [e["id"] for e in rows(some)[0]["events"]] == wanted[7]
    assert "PushedFilters: [IsNotNull(u), EqualTo(u,7)]" in some._jdf.queryExecution().toString()


def test_a_batch_reads_and_writes_its_own_rows_only(spark, tmp_path):
    """Behind a large base, a batch of few keys costs what its few rows cost."""
    home, view = str(tmp_path / "kept"), {"from": "events", "grouped": {"by": "u"}}
    big = spark.range(200_000).selectExpr("id", "id % 1000 as u", "sha2(cast(id as string), 256) as t")
    big.selectExpr("u", "struct(id, u, t) as events").write.parquet(f"{home}/part-1-{800:012d}-{807:012d}")
    base = size(home)
    path = str(tmp_path / "in")
    big.filter("u < 3 and id < 3000").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(big.schema).parquet(path)
    K.keep_grouped(stream, home, {}, view, str(tmp_path / "cp")).awaitTermination()
    names = {p[3]: size(f"{home}/{p[3]}") for p in K.parts(home)}
    assert len(names) == 2 and min(names.values()) < base / 100 and max(names.values()) == base
    lists = {r["u"]: r["n"] for r in K.grouped_lists(K.grouped_items(spark, home).filter("u < 4"), view).select(
        "u", F.size("events").alias("n")).collect()}
    assert lists == {0: 203, 1: 203, 2: 203, 3: 200}


def test_parts_that_are_not_whole_do_not_count(spark, batches, tmp_path):
    stream, frame = batches
    home = str(tmp_path / "kept")
    K.keep_grouped(stream, home, {}, SPEC, str(tmp_path / "cp"), fan_in=4).awaitTermination()
    before = K.parts(home)
    torn = f"{home}/part-9-{0:012d}-{99:012d}"
    spark.range(1).write.parquet(torn)
    os.remove(f"{torn}/_SUCCESS")
    assert K.parts(home) == before
    # A compaction that was cut off before it deleted: the larger part counts, once.
    items = K.grouped_items(spark, home)
    K._write(spark.createDataFrame(items.collect(), items.schema), "u", home, 5, 0, 9)
    assert [p[0] for p in K.parts(home)] == [5]
    assert K.grouped_items(spark, home).count() == frame.filter("kind <> 'error'").count()


def test_views_that_cannot_be_kept(spark, batches, tmp_path):
    stream, _ = batches
    for spec in ({"from": "events"}, {**SPEC, "sort": {"by": "u"}}, {**SPEC, "select": [{"item": "u"}]}):
        with pytest.raises(ValueError):
            K.keep_grouped(stream, str(tmp_path), {}, spec, "")
    with pytest.raises(ValueError):
        K.grouped_items(spark, str(tmp_path / "none"))
