"""Packing of tokenized documents into sequences by vector best-fit.

Every bin has three residual capacities: tokens, documents and attention cost
(sum of squared lengths). A piece may only go where all three suffice, and goes
where a weighted dot product of residual and demand is largest, or where the
weighted norm of what is left is smallest.

Pieces of one length make the same demand, so the decisions are taken on the
histogram of lengths, which never has more rows than a sequence has tokens, and
for whole classes of like bins at once. The pieces themselves are only numbered
within their length and looked up: none of them meets the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import picked, sliced, stage, whole_text
from recordloom.llm.tokens import encoder


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds. None: as much as its tokens allow at most."""

    tokens: int = 4096
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rule: str = "norm"

    def limits(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], dtype=float)


def plan(counts: dict[int, int], capacity: Capacity) -> dict[int, np.ndarray]:
    """Where the pieces of each length go: length -> rows of (first number,
    pieces per sequence, first sequence, offset), by first number. The piece with
    number t of a row's range goes to sequence ``first + t // per`` at ``offset +
    t % per * length``.

    Lengths go from long to short. A piece that no open bin can take opens one.
    A single piece over the attention capacity gets a sequence of its own.
    """
    limits, weights = capacity.limits(), np.array(capacity.weights)
    left = np.empty((1024, 3))  # residuals of the classes of open bins
    bins = np.zeros((1024, 2), dtype=np.int64)  # first sequence, how many
    used, sequences = 0, 0
    out: dict[int, list[tuple[int, int, int, int]]] = {}

    def keep(residual: np.ndarray, first: int, n: int) -> None:
        nonlocal left, bins, used
        if n <= 0 or residual.min() <= 0:
            return
        if used == len(left):
            left, bins = np.concatenate([left, left]), np.concatenate([bins, bins])
        left[used], bins[used], used = residual, (first, n), used + 1

    for length in sorted(counts, reverse=True):
        n, number, rows = counts[length], 0, out.setdefault(length, [])
        demand = np.array([length, 1, length * length], dtype=float)
        while n:
            fits = np.flatnonzero((left[:used] >= demand).all(1))
            if len(fits):
                if capacity.rule == "dot":
                    score = -((left[fits] / limits) * (demand / limits) * weights).sum(1)
                else:
                    score = ((((left[fits] - demand) / limits) ** 2) * weights).sum(1)
                best = fits[int(np.argmin(score))]
                residual, (first, many) = left[best].copy(), map(int, bins[best])
                used -= 1
                left[best], bins[best] = left[used], bins[used]
            else:
                residual, first, many = limits.copy(), sequences, n
            per = max(1, min(n, int((residual // demand).min())))
            full = min(many, n // per)
            offset = int(limits[0] - residual[0])
            rows.append((number, per, first, offset))
            keep(residual - per * demand, first, full)
            number, n = number + full * per, n - full * per
            if not len(fits):
                many = full
                sequences += full
            keep(residual, first + full, many - full)
        out[length] = rows
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


# ── Jobs ─────────────────────────────────────────────────────────────

PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary, part int, number bigint"


def pieces(
    documents: DataFrame, path: str, tokens: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Encode every whole text with the lower-casing file at ``path``, end it with
    ``end_id``, and cut what is longer than ``tokens`` into pieces.

    Null and empty texts are a piece of the end id alone. ``part`` and
    ``number`` tell the pieces of one length apart within the task that made
    them; store the frame before using both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end, most = encoder(path, "word"), np.array([end_id], "<u4").tobytes(), 4 * tokens
        part, seen = TaskContext.get().partitionId(), {}
        for batch in sliced(batches):
            rows: list[tuple] = []
            for name, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = own.encode(value) + end
                for piece, start in enumerate(range(0, len(ids), most)):
                    own_ids = ids[start: start + most]
                    length = len(own_ids) // 4
                    number = seen[length] = seen.get(length, -1) + 1
                    rows.append((name, piece, start // 4, length, zlib.crc32(own_ids), own_ids, part, number))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    fields = [f.split() for f in PIECE.split(", ")]
    names = [n for n, _ in fields]
    types = [{"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t] for _, t in fields]
    rows = picked(documents, doc_id=doc_id, text=text)
    return rows.select(F.col("doc_id").cast("bigint"), whole_text("text").alias("text")).mapInArrow(run, PIECE)


def pack(stored: DataFrame, capacity: Capacity | None = None) -> DataFrame:
    """Give each stored piece its ``sequence_id`` and ``offset``.

    Needs ``length``, ``part`` and ``number`` (see :func:`pieces`); all other
    columns stay. Which of several pieces of one length goes where is settled by
    part and number, so ties have no say in how many sequences there are. An
    empty table gives no rows.
    """
    capacity = capacity or Capacity()
    tallies = stored.groupBy("part", "length").agg((F.max("number") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(
        tallies.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))), "offsets")
    # At most a row per length: capacity.tokens rows.
    counts = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = stored.sparkSession.sparkContext.broadcast(plan(counts, capacity))

    @F.pandas_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        numbers = number.to_numpy()
        for size, index in length.groupby(length).indices.items():
            table, t = where.value[size], numbers[index]
            row = table[np.searchsorted(table[:, 0], t, "right") - 1]
            at = t - row[:, 0]
            sequence[index], offset[index] = row[:, 2] + at // row[:, 1], row[:, 3] + at % row[:, 1] * size
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    numbered = stored.join(offsets.drop("n"), ["part", "length"])
    placed = numbered.withColumn("at", place("length", F.col("ahead") + F.col("number")))
    return placed.select(*[c for c in stored.columns if c not in ("part", "number")], "at.*")
