"""File work dealt out by bytes.

A table that names files says nothing of the bytes behind its rows, so Spark
would give all of them to one task. Here the rows are packed into splits of about
a stated number of bytes, in the order they come, and each split is one partition
that adaptive execution does not merge with others.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.session import ensure_checkpoint_dir

SPLIT_BYTES = 64 << 20
#: What opening a file costs, as bytes; so many small files are many splits too.
OPEN_BYTES = 1 << 18
#: Beyond so many splits, neighbours go together.
MOST_SPLITS = 100_000


def dealt(
    files: DataFrame, size: Column | str = "size", split_bytes: int = SPLIT_BYTES, open_bytes: int = OPEN_BYTES,
) -> DataFrame:
    """The rows of ``files``, a partition for each ``split_bytes`` of them. A row
    counts its ``size`` (null as 0) and ``open_bytes``; a larger one is a split of
    its own. Where there are so many rows that all cores have splits enough without
    it, opening counts a fourth or a sixteenth of that: a task costs as much as some
    thousand small files. The narrow table is computed and stored once, below the
    checkpoint folder; what goes to the driver is three numbers for each task that
    wrote it."""
    spark = files.sparkSession
    columns = files.columns
    weight = F.coalesce(F.col(size) if isinstance(size, str) else size, F.lit(0))
    weighed = files.withColumn("__bytes", weight.cast("bigint"))
    opens = sorted({max(1, open_bytes >> shift) for shift in (0, 2, 4)})
    names = [f"__split_{n}" for n in range(len(opens))]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        at, filled = [0] * len(opens), [0] * len(opens)
        for batch in batches:
            sizes, splits = batch.column("__bytes").to_pylist(), []
            for level, each in enumerate(opens):
                split, held, found = at[level], filled[level], []
                for bytes_ in sizes:
                    if held and held + bytes_ + each > split_bytes:
                        split, held = split + 1, 0
                    held += bytes_ + each
                    found.append(split)
                at[level], filled[level] = split, held
                splits.append(pa.array(found, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array([task] * batch.num_rows, pa.int32()), *splits],
                names=[*columns, "__task", *names])

    path = f"{ensure_checkpoint_dir(spark)}/splits-{uuid.uuid4().hex}"
    kind = T.StructType([
        *files.schema.fields, T.StructField("__task", T.IntegerType()), *[T.StructField(n, T.LongType()) for n in names]])
    weighed.mapInArrow(pack, kind).write.parquet(path)
    packed = spark.read.schema(kind).parquet(path)
    tasks = sorted(packed.groupBy("__task").agg(*[F.max(n) for n in names]).collect())
    if not tasks:
        return packed.select(*columns)
    enough = 2 * spark.sparkContext.defaultParallelism
    totals = [sum(last[level] + 1 for _, *last in tasks) for level in range(len(opens))]
    level = next((n for n, total in enumerate(totals) if total >= enough), len(opens) - 1)
    first, rows = 0, []
    for task, *last in tasks:
        rows.append((task, first))
        first += last[level] + 1
    together = -(-first // MOST_SPLITS)
    offsets = spark.createDataFrame(rows, "__task int, __first bigint")
    number = F.floor((F.col("__first") + F.col(names[level])) / together).cast("int")
    return packed.join(offsets, "__task").repartitionById(-(-first // together), number).select(*columns)


def numbered(files: DataFrame, most: int) -> DataFrame | None:
    """The rows of a stored table, a partition for each ``most`` of them and one for
    the rest; nothing for an empty table. One number per task goes to the driver."""
    spark = files.sparkSession
    row = F.monotonically_increasing_id()
    placed = files.withColumn("__task", F.shiftright(row, 33).cast("int")).withColumn("__row", row.bitwiseAND(F.lit((1 << 33) - 1)))
    counts = sorted(placed.groupBy("__task").count().collect())
    first, rows = 0, []
    for task, count in counts:
        rows.append((task, first))
        first += count
    if not first:
        return None
    offsets = F.broadcast(spark.createDataFrame(rows, "__task int, __first bigint"))
    number = F.floor((F.col("__first") + F.col("__row")) / most).cast("int")
    return placed.join(offsets, "__task").repartitionById(-(-first // most), number).select(*files.columns)
