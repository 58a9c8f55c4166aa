"""Helpers shared by the operators: staged tables, column picking, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.session import ensure_checkpoint_dir

#: Run of the six ASCII white space characters.
BLANKS = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's address below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(frame: DataFrame, name: str) -> DataFrame:
    """Write the frame once to the shared folder and go on from the files, so
    nothing is computed twice and a lost executor costs only its own tasks."""
    path = shared_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    staged = frame.sparkSession.read.schema(frame.schema).parquet(path)
    staged.staged_at = path
    return staged


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables once whatever was made of them is staged itself."""
    for frame in frames:
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame.staged_at)
        path.getFileSystem(frame.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def picked(frame: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; whatever else the
    frame has, and however it is called, stays out of the way."""
    return frame.select(*[frame[old].alias(new) for new, old in columns.items()])


def spare(frame: DataFrame, name: str) -> str:
    """A column name that the frame does not have, in any letter case."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_text(column: Column | str) -> Column:
    """Text with null counting as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fingerprint(frame: DataFrame, *columns: str) -> tuple[int, int]:
    """Row count and an order-free hash of the rows."""
    row = frame.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*columns)).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected edge list with the bigint columns
    ``a`` and ``b``: a row ``(node, component)`` for each node of an edge between
    two different nodes; the component is its smallest node.

    Alternating large and small stars: each node hands its neighbours to the
    smallest one it knows, until the list is one star per component. Minima are
    combined before the shuffle; both join sides are stored tables, so AQE can
    split a hub with very many neighbours. Edges never reach the driver.
    """
    tidy = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    star = stage(tidy.distinct(), "edges")
    seen = fingerprint(star, "u", "v")
    while seen[0]:
        both = star.union(star.select("v", "u"))
        lows = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lows")
        large = stage(
            both.join(lows, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            "large")
        unstage(lows)
        lows = stage(large.groupBy("u").agg(F.min("v").alias("m")), "lows")
        small = large.join(lows, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, star = star, stage(small.union(lows).distinct(), "edges")
        unstage(before, large, lows)
        now = fingerprint(star, "u", "v")
        if now == seen:
            break
        seen = now
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        star.select("v", "v").distinct())


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows``, so a task holds the Python
    objects of few rows at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def blocked_pairs(
    left: DataFrame, right: DataFrame, keys: list[str], member: list[str], block: int, by: str, weight: str = "1",
) -> DataFrame:
    """Pairs of blocks that cover every left-right pair within a key.

    Each key's rows are dealt by a hash of ``by`` into blocks with a ``weight`` (an
    SQL expression; rows by default) of about ``block``, and every left block meets every right block in a row of its
    own with the array columns ``left`` and ``right`` (structs of ``member``). A
    key that very many rows share thus becomes many rows, on many tasks; no row
    holds more than two blocks.
    """
    tally = lambda frame, name: frame.groupBy(*keys).agg(
        F.ceil(F.sum(F.expr(weight)) / block).cast("int").alias(name))
    sizes = stage(tally(left, "lefts").join(tally(right, "rights"), keys), "blocks")

    def side(frame: DataFrame, own: str, other: str) -> DataFrame:
        place = F.pmod(F.xxhash64(by, F.lit("block")), F.col(f"{own}s")).cast("int")
        return frame.join(sizes, keys).withColumn(f"{own}_block", place).groupBy(
            *keys, f"{own}_block", f"{other}s").agg(F.collect_list(F.struct(*member)).alias(own)).withColumn(
            f"{other}_block", F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))).drop(f"{other}s")

    at = [*keys, "left_block", "right_block"]
    return side(left, "left", "right").join(side(right, "right", "left"), at).select("left", "right")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its part) that join what the links between
    ``a`` and ``b`` join; never more than there are nodes."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a):]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]
