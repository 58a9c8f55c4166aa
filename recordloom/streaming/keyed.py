"""Lists by key over a stream, kept as a base and deltas.

A batch writes the items that it brings, sorted by key and place, as a part of its
own and reads nothing that is there already: its work grows with its own rows,
whatever the number of keys or the length of their lists. Once ``fan_in`` parts of
a level are there, they are written together as one part of the next level, so a
row is rewritten as often as there are levels, which is the logarithm of the
number of batches. Items stay rows, so a key may have any number of them; a list
is put together where one is asked for. As parts are sorted by key, a filter on
keys reads their row groups alone.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recordloom.functions.paths import ORD, column, has_path
from recordloom.operators.groups import nested_lists
from recordloom.plans.bundle import ViewSpec, run_views
from recordloom.sources.sinks import _delete, _entries_of

FAN_IN = 8
_PART = re.compile(r"part-(\d+)-(\d{12})-(\d{12})")


def keep_grouped(
    stream: DataFrame, home: str, frames: Mapping[str, DataFrame], spec: ViewSpec, checkpoint: str,
    fan_in: int = FAN_IN, **options,
) -> StreamingQuery:
    """Keep the items of a ``grouped`` view over a stream below ``home``; take in what
    there is, then stop. The clauses before ``grouped`` run on each batch alone, so
    joins are to static ``frames``. A batch repeated after a failure replaces its own
    part. Read with :func:`grouped_items` or :func:`grouped_lists`."""
    if "grouped" not in spec or "sort" in spec or "select" in spec:
        raise ValueError("only a grouped view without select and sort can be kept; apply those to its lists")
    flat = {**spec, "grouped": {**spec["grouped"], "flat": True}}
    by = spec["grouped"]["by"]

    def step(batch: DataFrame, number: int) -> None:
        items = run_views({**frames, spec["from"]: batch}, {"view": flat}, keep_order=True, **options)["view"]
        _write(items, by, home, 0, number, number)
        compact(batch.sparkSession, home, by, fan_in)

    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _write(items: DataFrame, by: str, home: str, level: int, first: int, last: int) -> None:
    order = [column(by), *([column(ORD)] if ORD in items.columns else [])]
    path = f"{home.rstrip('/')}/part-{level}-{first:012d}-{last:012d}"
    items.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def parts(home: str) -> list[tuple[int, int, int, str]]:
    """``level, first batch, last batch, name`` of the parts that count: those that
    are whole and whose batches no larger whole part has."""
    home, found = home.rstrip("/"), []
    for entry in _entries_of(home)[1]:
        match = _PART.fullmatch(entry.base_name)
        if match and any(e.base_name == "_SUCCESS" for e in _entries_of(f"{home}/{entry.base_name}")[1]):
            found.append((int(match[1]), int(match[2]), int(match[3]), entry.base_name))
    covered = lambda p: any(
        q is not p and q[1] <= p[1] and p[2] <= q[2] and q[0] > p[0] for q in found)
    return sorted(p for p in found if not covered(p))


def compact(spark: SparkSession, home: str, by: str, fan_in: int = FAN_IN) -> None:
    """Write ``fan_in`` parts of a level together, level by level, and delete what a
    whole part has taken over."""
    level = 0
    while True:
        held = parts(home)
        mine = [p for p in held if p[0] == level]
        if len(mine) >= fan_in:
            rows = spark.read.parquet(*[f"{home}/{name}" for *_, name in mine])
            _write(rows, by, home, level + 1, mine[0][1], mine[-1][2])
            counted = {name for *_, name in parts(home)}
            for *_, name in mine:
                if name not in counted:
                    _delete(spark, f"{home.rstrip('/')}/{name}")
        elif not any(p[0] > level for p in held):
            return
        level += 1


def grouped_items(spark: SparkSession, home: str) -> DataFrame:
    """A row per item: the key, the item, and its place in the order if the stream's
    rows have one."""
    names = [name for *_, name in parts(home)]
    if not names:
        raise ValueError(f"nothing was taken in yet: {home}")
    return spark.read.parquet(*[f"{home.rstrip('/')}/{n}" for n in names])


def grouped_lists(items: DataFrame, spec: ViewSpec) -> DataFrame:
    """A row per key of :func:`grouped_items`, or of some keys of it, with its list."""
    by = spec["grouped"]["by"]
    as_ = spec["grouped"].get("as", spec["from"].rsplit(".", 1)[-1])
    if not has_path(items, as_):
        raise ValueError(f"the items have no '{as_}'")
    keyed = items.withColumnRenamed(by, "__key")
    lists = nested_lists(keyed, "__key", column(as_), as_)
    return lists.select(F.col("__key").alias(by), *[column(n) for n in lists.columns if n not in ("__key", ORD)])
