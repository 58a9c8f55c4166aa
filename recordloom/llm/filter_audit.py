"""Interaction of quality filters, for every order they can be applied in.

A document is its mask: which filters it fails. The masks of a part are counted
in Spark, so a part is a histogram of at most 2^filters masks whatever its size.
A filter's place in an order is a row of the position matrix (the inverse
permutation); the mask matrix holds 0 where a mask fails a filter and infinity
elsewhere. Their min-plus product is the step at which an order removes a mask.
That step places the mask's weight in the counts of the order; a filter it also
fails, later in the order, is redundant for it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import BLANKS, picked, stage, whole_text


def text_filters(text: Column) -> dict[str, Column | None]:
    """Failure conditions by letter; None stands for a text that a smaller id has too."""
    words = F.array_remove(F.split(text, BLANKS), "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals.cast("bigint") > 3 * F.length(text).cast("bigint"),
        "D": text.rlike("[#$%&*|]"),
        "E": None,
    }


def judged(documents: DataFrame, labels: DataFrame, filters=text_filters) -> tuple[list[str], DataFrame]:
    """The filters' letters and a row per document: ``part, mask, good, toxic``.

    The texts are read once and leave as digests. Labels are one row per id first.
    """
    rows = picked(documents, doc_id="doc_id", text="text", part="lang")
    conditions = filters(whole_text("text"))
    letters = list(conditions)
    if len(letters) > 7:
        raise ValueError("orders of more than seven filters are too many to list")
    bits = sum((c.cast("int") * (1 << n) for n, c in enumerate(conditions.values()) if c is not None), F.lit(0))
    repeated = sum(1 << n for n, c in enumerate(conditions.values()) if c is None)
    seen = rows.select(
        "doc_id", F.coalesce("part", F.lit("")).alias("part"), bits.alias("mask"),
        F.unhex(F.sha2(whole_text("text").cast("binary"), 256)).alias("digest"))
    if repeated:
        seen = stage(seen, "filters")
        groups = seen.groupBy("digest").agg(
            F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
        later = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).cast("int") * repeated
        # Stored tables on both sides: AQE splits the digest of a text a third of the rows share.
        seen = seen.join(stage(groups, "groups"), "digest", "left").select(
            "doc_id", "part", (F.col("mask") + later).alias("mask"))
    marks = stage(labels.groupBy(labels["doc_id"].alias("label_id")).agg(
        F.max((labels["quality"] == 1).cast("int")).alias("good"),
        F.max((labels["toxic"] == 1).cast("int")).alias("toxic")), "marks")
    kept = seen.join(marks, seen["doc_id"] == marks["label_id"], "left")
    return letters, kept.select(
        "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def histogram(rows: DataFrame) -> DataFrame:
    """``part, masks``: the weights of each mask a part has."""
    counted = rows.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))


class Orders:
    """All orders of ``k`` filters: ``sequence[o, s]`` is the filter at step ``s``,
    ``place[o, f]`` the step of filter ``f``, its inverse permutation."""

    def __init__(self, k: int):
        self.k = k
        self.sequence = np.array(list(itertools.permutations(range(k))))
        self.place = np.argsort(self.sequence, axis=1)

    def removal(self, masks: np.ndarray) -> np.ndarray:
        """``step[mask, order]``, ``k`` where the mask fails nothing."""
        fails = masks[:, None] >> np.arange(self.k) & 1
        cost = np.where(fails == 1, 0, self.k)
        step = np.full((len(masks), len(self.place)), self.k)
        for f in range(self.k):
            np.minimum(step, cost[:, f, None] + self.place[None, :, f], out=step)
        return step

    def counts(self, masks: np.ndarray, weights: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Each count as an array by order and step."""
        step = self.removal(masks)
        order = np.broadcast_to(np.arange(len(self.place)), step.shape)

        def scattered(weight: np.ndarray) -> np.ndarray:
            out = np.zeros((len(self.place), self.k + 1), np.int64)
            np.add.at(out, (order, step), np.broadcast_to(weight[:, None], step.shape))
            return out[:, : self.k]

        n = weights["n"]
        removed = scattered(n)
        fails = (masks[:, None] >> np.arange(self.k) & 1).astype(bool)
        failing = n @ fails  # by filter
        alone = np.array([n[masks == 1 << f].sum() for f in range(self.k)])
        at_step = self.sequence
        shapley = np.zeros(self.k, np.int64)
        np.add.at(shapley, at_step, removed)
        return {
            "kept": n.sum() - removed.cumsum(1),
            "removed": removed,
            "redundant": failing[at_step] - removed,
            "unique_fails": alone[at_step],
            "good_lost": scattered(weights["good"]),
            "toxic_lost": scattered(weights["toxic"]),
            "shapley": shapley[at_step],
        }


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(documents: DataFrame, labels: DataFrame, filters=text_filters) -> DataFrame:
    """``part, filter_order, step`` and the counts, a row for each part, order and
    step, zeros included.

    ``filters`` maps the text column to failure conditions by letter. ``part`` is
    the document's ``lang``, null as empty. A document is good or toxic if any of
    its labels says so. Null text is empty text. A row without id has no label and
    is no repetition, and neither is a row whose text only rows with its own id
    share; each row counts. A very long text is split into words in one task. An
    empty table gives no rows. Other columns are not looked at.
    """
    letters, rows = judged(documents, labels, filters)
    k = len(letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = Orders(k)
        names = pa.array(["".join(letters[f] for f in s) for s in orders.sequence]).take(
            pa.array(np.repeat(np.arange(len(orders.sequence)), k)))
        steps = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders.sequence)))
        for batch in batches:
            for part, masks in zip(batch.column("part"), batch.column("masks"), strict=True):
                cells = masks.values
                column = lambda c: cells.field(c).to_numpy().astype(np.int64)  # noqa: B023, E731
                counts = orders.counts(column("mask"), {c: column(c) for c in ("n", "good", "toxic")})
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * len(steps), pa.string()), names, steps,
                     *[pa.array(counts[c].reshape(-1), pa.int64()) for c in COUNTS]],
                    names=["part", "filter_order", "step", *COUNTS])

    return histogram(rows).mapInArrow(
        run, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS))
