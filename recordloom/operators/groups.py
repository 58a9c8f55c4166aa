"""Nested lists per key.

A list is one value of one row, so it has to fit a task; there is one per key
whatever its size. What reads a list only to take it apart again should keep the
flat form instead (``flat`` of :func:`.views.grouped` and :func:`.views.attach`),
which is a row per item and has no such bound.

A join that pairs many equal rows with many others need not carry each through it:
:func:`counted` makes one row of them, :func:`repeated` gives them back afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.paths import ORD, column

_ITEM = "__item"

#: :func:`repeated` makes at most so many rows of one at a time.
REPEATS = 4096


def orderable(data_type: T.DataType) -> bool:
    """Whether Spark can sort values of this type."""
    if isinstance(data_type, T.StructType):
        return all(orderable(f.dataType) for f in data_type.fields)
    if isinstance(data_type, T.ArrayType):
        return orderable(data_type.elementType)
    return not isinstance(data_type, (T.MapType, T.VariantType))


def nested_lists(frame: DataFrame, key: str, item: Column, as_: str) -> DataFrame:
    """One row per value of ``key`` with its items, in source order, under
    ``as_``; the hidden ordinal becomes that of the group's first row."""
    ordered = ORD in frame.columns
    columns = [column(key).alias(key), item.alias(_ITEM)]
    frame = frame.select(*columns, *([column(ORD)] if ordered else []))
    sortable = orderable(frame.schema[_ITEM].dataType)
    if not ordered:
        items = F.collect_list(_ITEM)
        items = F.sort_array(items) if sortable else items
    else:
        pairs = F.collect_list(F.struct(column(ORD).alias("o"), column(_ITEM).alias("i")))
        if sortable:
            pairs = F.sort_array(pairs)
        else:
            pairs = F.array_sort(
                pairs,
                lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0),
            )
        items = F.transform(pairs, lambda pair: pair["i"])
    aggregates = [items.alias(as_)]
    if ordered:
        aggregates.append(F.min(column(ORD)).alias(ORD))
    return frame.groupBy(column(key)).agg(*aggregates)


def counted(frame: DataFrame, names: Sequence[str], as_: str) -> DataFrame:
    """The distinct rows of the columns ``names``, with the number of rows that have
    each under ``as_``."""
    return frame.groupBy(*[column(n) for n in names]).agg(F.count(F.lit(1)).alias(as_))


def repeated(frame: DataFrame, times: str) -> DataFrame:
    """Every row as often as its column ``times`` says, without that column; null and
    less than 1 are none.

    Few rows may stand for very many, so the work says nothing by its bytes: rows are
    cut at :data:`REPEATS` and dealt evenly over partitions that adaptive execution
    does not merge.
    """
    spark = frame.sparkSession
    names = [n for n in frame.columns if n != times]
    total, most = column(times).cast("bigint"), F.lit(REPEATS).cast("bigint")
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(total, F.lit(1)) - 1, most)
    cut = frame.filter(total > 0).select("*", F.explode(starts).alias("__from"))
    part = F.least(most, total - F.col("__from")).cast("int").alias("__part")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = cut.select(*[column(n) for n in names], part).repartition(tasks)
    copies = F.explode(F.array_repeat(F.lit(True), F.col("__part")))
    return dealt.select(*[column(n) for n in names], copies.alias("__copy")).drop("__copy")
