"""Near-duplicate vectors within a label: spherical k-means cells, and blocked
cosine products inside each cell.

A vector is at home in the cell of its nearest centroid. It is also put, as a
guest, into every cell in which a vector linked to it could be at home: two unit
vectors with cosine c are ``sqrt(2 - 2c)`` apart, so a vector at home in another
cell can only have a link here if its distance to the border is no more than
that. Each vector meets, once, in its home cell, everybody at home or guest
there, so no link is lost and none is counted twice.

Cells are cut into blocks of a fixed number of rows, and a task multiplies two
blocks; a cell that a third of all vectors share becomes many tasks. Of a
product only counts and a spanning forest of the links leave the task, not the
pairs. Equal vectors of a label are one class with a weight and a number of its
own; ids come in again only with the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import blocked_pairs, components, forest, picked, stage

# ── Cells ────────────────────────────────────────────────────────────


def spherical_kmeans(points: np.ndarray, cells: int, rounds: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors; far-apart starting points, empty cells
    keep their centroid."""
    draw = np.random.default_rng(seed)
    centroids = points[draw.integers(len(points))][None]
    near = points @ centroids[0]
    for _ in range(cells - 1):
        far = np.maximum(1 - near, 0)
        nxt = draw.choice(len(points), p=far / far.sum()) if far.sum() > 0 else draw.integers(len(points))
        centroids = np.vstack([centroids, points[nxt]])
        near = np.maximum(near, points @ points[nxt])
    for _ in range(rounds):
        home = (points @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, points)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centroids)
    return centroids


def fit_cells(unit: DataFrame, cell_rows: int | None, most_cells: int, sample_rows: int, rounds: int) -> dict:
    """label -> centroids, for the labels of several cells: one for ``cell_rows``
    vectors, or half as many as the square root of the label's vectors.

    Fitted per label, as Spark groups, on at most ``sample_rows`` vectors of each
    label drawn by a hash. There are about ``most_cells`` centroids at most
    altogether, the bound of what is sent to all tasks; beyond it cells grow, not
    their number.
    """
    rows = F.col("rows")
    wanted = rows / cell_rows if cell_rows else F.sqrt(rows) / 2
    sizes = unit.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).withColumn("wanted", wanted).filter("wanted > 1")
    total = sizes.agg(F.sum("wanted")).first()[0] or 0
    if not total:
        return {}
    sizes = sizes.withColumn("cells", F.ceil(F.col("wanted") * min(1.0, most_cells / total)).cast("int")).filter(
        "cells > 1").drop("wanted")
    draw = F.pmod(F.xxhash64("key", F.lit("cells")), F.lit(1 << 30))
    share = (F.lit(1 << 30) * F.least(F.lit(1.0), F.lit(1.3 * sample_rows) / F.col("rows"))).cast("bigint")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["draw", "key"]).head(sample_rows)
        points = np.stack(rows["unit"].map(np.asarray)).astype(float)
        found = spherical_kmeans(points, int(rows["cells"].iloc[0]), rounds)
        return pd.DataFrame({"label": rows["label"].iloc[0], "cell": np.arange(len(found)), "centroid": list(found)})

    drawn = unit.join(sizes, "label").withColumn("draw", draw).filter(F.col("draw") < share)
    # At most sample_rows of a label get so far; its group is bounded.
    found = drawn.select("label", "key", "unit", "cells", "draw").groupBy("label").applyInPandas(
        fit, "label bigint, cell int, centroid array<double>")
    out: dict[int, list] = {}
    for row in found.orderBy("label", "cell").collect():
        out.setdefault(row["label"], []).append(row["centroid"])
    return {k: np.array(v) for k, v in out.items()}


def seats(points: np.ndarray, centroids: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each point, and a table of the cells it is a guest of."""
    near = points @ centroids.T
    home = near.argmax(1)
    gap = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 1e-18))
    behind = (near[np.arange(len(points)), home][:, None] - near) / gap[home]
    guest = behind <= reach + 1e-9
    guest[np.arange(len(points)), home] = False
    return home, guest


# ── Blocks ───────────────────────────────────────────────────────────


def _products(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Each input row is a pair of blocks."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            ids, weight = {}, {}
            unit = {}
            for side in ("left", "right"):
                block = row.column(side)[0].values
                ids[side] = block.field("node").to_numpy()
                weight[side] = block.field("n").to_numpy()
                flat = block.field("unit").flatten().to_numpy()
                unit[side] = flat.reshape(len(ids[side]), -1)
            links = unit["left"] @ unit["right"].T >= threshold
            links &= ids["left"][:, None] != ids["right"][None, :]
            counts = links @ weight["right"]
            some = np.flatnonzero(counts)
            x, y = np.nonzero(links)
            node, root = forest(ids["left"][x], ids["right"][y])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([ids["left"][some], node])),
                 pa.array(np.concatenate([counts[some], np.zeros(len(node), np.int64)])),
                 pa.array(np.concatenate([np.full(len(some), -1), root]), mask=np.arange(len(some) + len(node)) < len(some))],
                names=["node", "links", "root"])


def link_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    threshold: float = 0.98, cell_rows: int | None = None, most_cells: int = 4096, sample_rows: int = 20_000,
    rounds: int = 8, block_rows: int = 1024,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: how many other vectors of the same
    label have a cosine of ``threshold`` or more with each vector (in double
    precision), the smallest id it is joined with through such links, and whether
    that is its own.

    A vector that is null or zero, holds null or non-finite components, or has no
    label is linked with nothing, and so is one of another length than its
    partner. Every row is a vector of its own, also where an id repeats, under the
    same label or another: equal vectors are linked with each other, and rows are
    never joined by their id alone. Rows without an id get no component and are not
    counted. An empty table gives no rows. Other columns are not looked at.
    """
    rows = picked(vectors, vec_id=vec_id, embedding=embedding, label=label).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        F.col("embedding").cast("array<double>").alias("v"))
    good = (
        "vec_id is not null and label is not null and v is not null and size(v) > 0"
        " and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
        " and exists(v, x -> x <> 0)")
    # Scaled by the largest component first, so no square over- or underflows.
    peak = F.array_max(F.transform("v", F.abs))
    scaled = F.transform("v", lambda x: x / F.col("peak"))
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x))
    keyed = rows.withColumn("good", F.expr(f"coalesce({good}, false)")).withColumn(
        "v", F.when(F.col("good"), F.col("v"))).withColumn("key", F.when(F.col("good"), F.unhex(F.sha2(
            F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))), 256))))
    keyed = stage(keyed.select("vec_id", "label", "v", "key"), "vectors")
    linkable = keyed.filter("key is not null")
    classes = linkable.groupBy("label", "key").agg(
        F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("n"), F.any_value("v").alias("v"))
    unit = classes.withColumn("peak", peak).withColumn("s", scaled).withColumn("norm", norm).select(
        "label", "key", "class_id", "n", F.transform("s", lambda x: x / F.col("norm")).alias("unit"),
        F.size("v").alias("width"))
    unit = stage(unit.withColumn("node", F.monotonically_increasing_id()), "units")
    # Vectors of another length are told apart like labels are.
    named = unit.withColumn("label", F.xxhash64("label", "width"))
    centroids = vectors.sparkSession.sparkContext.broadcast(
        fit_cells(named, cell_rows, most_cells, sample_rows, rounds))
    reach = float(np.sqrt(2 - 2 * threshold))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_numpy()
            home, guests = np.zeros(len(labels), np.int32), [[] for _ in labels]
            for one in np.unique(labels):
                if one in centroids.value:
                    mine = np.flatnonzero(labels == one)
                    points = batch.column("unit").take(pa.array(mine)).flatten().to_numpy().reshape(len(mine), -1)
                    home[mine], table = seats(points, centroids.value[one], reach)
                    for k, flags in zip(mine, table, strict=True):
                        guests[k] = np.flatnonzero(flags).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("label", "node", "n", "unit")]
                + [pa.array(home), pa.array(guests, pa.list_(pa.int32()))],
                names=["label", "node", "n", "unit", "home", "guests"])

    seated = stage(named.select("label", "node", "n", "unit").mapInArrow(
        place, "label bigint, node bigint, n bigint, unit array<double>, home int, guests array<int>"), "seats")
    present = seated.select(
        "label", "node", "n", "unit", "home", F.explode(F.concat(F.array("home"), "guests")).alias("cell"))
    member = ["node", "n", "unit"]
    pairs = blocked_pairs(
        present.filter("home = cell"), present, ["label", "cell"], member, block_rows, "node")
    found = stage(pairs.mapInArrow(
        lambda b: _products(b, threshold), "node bigint, links bigint, root bigint"), "links")
    counted = found.filter("root is null").groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.filter("root is not null").select(F.col("node").alias("a"), F.col("root").alias("b")))
    grouped = stage(
        unit.select("label", "key", "node", "class_id", "n").join(counted, "node", "left").join(joined, "node", "left")
        .select("label", "key", "class_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("component", "node").alias("component")), "grouped")
    lowest = stage(grouped.groupBy("component").agg(F.min("class_id").alias("component_id")), "lowest")
    classes = stage(grouped.join(lowest, "component").select("label", "key", "n_links", "component_id"), "classes")
    alone = keyed.filter("key is null").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linkable.select("vec_id", "label", "key").join(classes, ["label", "key"]).select(
        "vec_id", "n_links", "component_id").union(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
