"""A whole project: a content tree, its schema and its views.

The schema, view and edition files are small and read on the driver; records,
documents and files are only ever read by Spark.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from recordloom.operators import checks as C
from recordloom.operators.nodes import assign_pages, node_index, origin_types
from recordloom.plans import catalog as K
from recordloom.plans.bundle import ViewSpec, run_views
from recordloom.session import ensure_checkpoint_dir
from recordloom.sources import yaml12
from recordloom.sources.schema import (
    CONTENT_SCHEMA,
    Schema,
    checked,
    entities,
    is_single,
    with_content,
)
from recordloom.sources.sinks import export_namespace
from recordloom.sources.tree import read_entities, read_tree

DEFAULT_EDITION = "default"


@dataclass(frozen=True)
class Project:
    """A content folder, its schema, and named views and editions."""

    root: str
    schema: Schema
    views: Sequence[tuple[str, ViewSpec]] = ()
    editions: Mapping[str, Sequence[str]] = field(default_factory=lambda: {DEFAULT_EDITION: ()})


def load_config(path: str) -> dict:
    """The mapping in one YAML or JSON file."""
    with open(path, encoding="utf-8") as handle:
        value = yaml12.load(handle.read())
    if not isinstance(value, dict):
        raise ValueError(f"{path}: expected a mapping at the root")
    return value


def load_views(folder: str) -> list[tuple[str, ViewSpec]]:
    """The views of all files below ``folder`` in path order; a name used twice
    stays in the list, to be refused later."""
    paths = sorted(
        os.path.join(at, name)
        for at, _, names in os.walk(folder)
        for name in names
        if name.lower().endswith((".yaml", ".yml", ".json")) and not name.startswith(".")
    )
    return [pair for path in paths for pair in load_config(path).items()]


def load_editions(config: Mapping[str, object]) -> dict[str, list[str]]:
    """Edition name to the types that open a page of their own: either a single
    ``file_per`` list, or one per entry of ``editions``."""
    named = config.get("editions")
    if named is None:
        named = {DEFAULT_EDITION: config}
    bad = [n for n in named if not n or n.startswith("__")]
    if bad:
        raise ValueError(f"edition names not allowed: {bad}")
    return {n: [str(t) for t in (e.get("file_per") or ())] for n, e in named.items()}


@dataclass(frozen=True)
class Tree:
    """The content of a project, read once into Parquet tables."""

    files: DataFrame
    frames: dict[str, DataFrame]


def read_project(spark: SparkSession, project: Project, stage: str | None = None) -> Tree:
    """Read the content tree into the ``stage`` folder, by default a new one
    below the shared checkpoint folder."""
    checked(with_content(project.schema))
    if stage is None:
        stage = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    frames = read_tree(spark, project.root, project.schema, stage)
    return Tree(spark.read.parquet(f"{stage}/files"), frames)


def check_tree(project: Project, tree: Tree) -> DataFrame:
    """All findings of a content tree in one table, a row per occurrence:
    schema rules on the text of every record file, hand-written blobs, dangling
    references, duplicate ids."""
    schema = with_content(project.schema)
    parts = [
        C.text_violations(tree.files, schema),
        C.check_handwritten_blobs(read_entities(tree.files, CONTENT_SCHEMA)["blob"]),
        C.check_references(tree.frames, schema),
        C.check_duplicate_ids(tree.frames, schema),
    ]
    return C.report(parts, tree.files.sparkSession)


def namespace(
    project: Project, tree: Tree, **options
) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Every entity, view, catalog frame and built-in view by name, each with
    its source order, and the origins of the view types."""
    spark, frames = tree.files.sparkSession, tree.frames
    views = run_views(frames, project.views, spark=spark, keep_order=True, **options)
    types = {
        n: frames[n].schema for n, e in entities(with_content(project.schema)).items()
        if not is_single(e)
    }
    specs = dict(project.views)
    shapes = {n: v.schema for n, v in views.items()}
    definitions = K.catalog(spark, types, views=shapes, specs=specs, builtin=("prose", "blob"))
    builtin = K.builtin_views(definitions)
    return {**frames, **views, **definitions, **builtin}, origin_types(specs, {**types, **shapes})


def tap(
    spark: SparkSession, project: Project, out_dir: str, *, strict: bool = False, **options
) -> dict[str, int]:
    """Read and check the tree, evaluate the views and export the whole
    namespace; the output is left alone when the findings block it. Returns the
    number of findings per severity."""
    tree = read_project(spark, project)
    counts = C.gate(check_tree(project, tree), strict)
    frames, _ = namespace(project, tree, **options)
    export_namespace(frames, out_dir)
    return counts


def pages(project: Project, tree: Tree, **options) -> DataFrame:
    """The page of every addressable element, per edition."""
    frames, origins = namespace(project, tree, **options)
    single = [n for n, e in entities(project.schema).items() if is_single(e)]
    return assign_pages(node_index(frames, origins, single), project.editions)
