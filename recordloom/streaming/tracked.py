"""A content tree kept up with its files.

Rows are kept by the file they come from. A run looks at what differs from the
last one, reads added and edited files only, and writes their rows to a folder of
its own together with a snapshot: every file of the tree and the run that holds
its rows. Rows of deleted files, and older rows of edited ones, are in no snapshot
and so no longer there. A run counts once an empty file ``done-<number>`` says so;
what a failed run left is written over by the next.

Checks that compare records with each other are kept up too. References and ids,
links and the addresses they land on are narrow tables by file. A run checks again
what changed files refer to, and what others refer to among the ids and addresses
that came or went; other findings of the last run stay as they are.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from recordloom.operators.checks import FIELDS, REFERENCE_KEY, record_ids, reference_values, text_violations
from recordloom.operators.nodes import element_nodes, node_index
from recordloom.operators.prose import broken_links, heading_array, link_table, node_links
from recordloom.session import together
from recordloom.sources.schema import Schema, checked, entities, is_single, with_content
from recordloom.sources.sinks import _delete, _done_runs, _entries_of, _mark_done, stored
from recordloom.sources.splits import numbered
from recordloom.sources.tree import (
    BLOB, PROSE, RECORD, blob_rows, contents, decode_records, entity_rows, file_kind, listing, nfc, prose_rows,
    record_texts,
)
from recordloom.streaming.incremental import changes

FILE = "__file"
NAMES = "path string, kind string, size bigint, mtime timestamp"
SNAPSHOT = f"{NAMES}, run int"
#: Runs that may hold rows; with more, the smaller ones are written together.
MOST_RUNS = 16


class TrackedTree:
    """The entities of the tree below ``root``, kept in the folder ``home``. One
    writer at a time; readers see the last finished run."""

    def __init__(self, spark: SparkSession, root: str, schema: Schema, home: str, most_runs: int = MOST_RUNS):
        checked(with_content(schema))
        self.spark, self.root, self.home = spark, root, home.rstrip("/")
        self.schema, self.most_runs = schema, most_runs
        self._held: dict[int, list[int]] = {}
        self._kinds: dict[str, T.StructType] = {}

    # ── Runs ─────────────────────────────────────────────────────────

    @property
    def last(self) -> int:
        """The number of the last finished run, 0 before the first."""
        done = _done_runs(self.home)
        return int(done[-1]) if done else 0

    def _at(self, run: int, table: str) -> str:
        return f"{self.home}/run-{run:09d}/{table}"

    def snapshot(self, run: int | None = None) -> DataFrame:
        """``path, kind, size, mtime, run`` of the files as of a run."""
        run = self.last if run is None else run
        if run == 0:
            return self.spark.createDataFrame([], SNAPSHOT)
        return self.spark.read.schema(SNAPSHOT).parquet(self._at(run, "files"))

    def sync(self) -> DataFrame:
        """Take in what was added, edited and deleted since the last run; returns
        ``path, change, kind, size, mtime`` of it. Nothing different, no run."""
        found = changes(self.snapshot(), listing(self.spark, self.root), carry=["kind", "size", "mtime"])
        return self._apply(found.filter("change <> 'unchanged'"))

    def stream(self, checkpoint: str, max_files: int = 10_000) -> StreamingQuery:
        """Take in new files as a stream of their names, of all kinds, batch by
        batch, then stop. Each batch is a run; one repeated after a failure replaces
        its own rows. A file stream reports no edits and no deletions, and leaves out
        names that begin with ``_``: :meth:`sync` sees all of these."""
        # What streams are lists of names, found by tasks: the driver holds no file
        # statuses, and of a batch's files only those with rows are opened.
        names = f"{checkpoint.rstrip('/')}.names"
        self._list_new(names, max_files)
        lists = self.spark.readStream.schema(NAMES).option("maxFilesPerTrigger", 1).option("maxFileAge", "36500d").parquet(names)
        found = lists.withColumn("change", F.lit("added"))
        return found.writeStream.foreachBatch(lambda batch, _: self._apply(batch) and None).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _list_new(self, names: str, max_files: int) -> None:
        """Add the files that no list below ``names`` has yet, in lists of ``max_files``."""
        there = _entries_of(names)[1]
        shown = ~F.col("path").rlike(r"(^|/)_[^/=]*(/|$)")
        files = listing(self.spark, self.root).filter(shown).select("path", "kind", "size", "mtime")
        if there:
            files = files.join(self.spark.read.schema(NAMES).parquet(names).select("path"), "path", "left_anti")
        draft = f"{names}.draft"
        lists = numbered(stored(files, draft), max_files)
        (files.limit(0) if lists is None else lists).write.mode("append").parquet(names)
        _delete(self.spark, draft)

    def _apply(self, found: DataFrame) -> DataFrame:
        run = self.last + 1
        self._held.pop(run, None)
        manifest = stored(found.select("path", "change", "kind", "size", "mtime"), self._at(run, "changes"))
        if manifest.isEmpty():
            return manifest
        fresh = manifest.filter("change <> 'deleted'")
        kept = self.snapshot(run - 1).join(manifest.select("path"), "path", "left_anti")
        folded = self._folded(kept)
        moved = F.col("run").isin(folded) if folded else F.lit(False)
        stays = kept.withColumn("run", F.when(moved, run).otherwise(F.col("run")).cast("int"))
        stored(stays.unionByName(fresh.select("path", "kind", "size", "mtime", F.lit(run).alias("run"))),
               self._at(run, "files"))
        self._write_rows(run, fresh, kept.filter(moved) if folded else None)
        self._check(run, manifest)
        _mark_done(self.home, f"{run:09d}")
        self._clear(run)
        return manifest

    def _clear(self, run: int) -> None:
        """Delete the runs that neither this snapshot nor the last one, which readers
        may still be at, has rows in."""
        recent = [r for r in (run - 1, run) if r > 0]
        held = {r for at in recent for r in self._runs(at)}
        for old in self._there() - held - set(recent):
            _delete(self.spark, f"{self.home}/run-{old:09d}")

    def _there(self) -> set[int]:
        return {int(e.base_name[4:]) for e in _entries_of(self.home)[1] if e.base_name.startswith("run-")}

    def _folded(self, kept: DataFrame) -> list[int]:
        """Runs whose remaining rows the next run takes over: the smaller half, once
        there are too many. One row per run is collected."""
        held = kept.groupBy("run").count().orderBy("count").collect()
        return [r["run"] for r in held[: len(held) // 2]] if len(held) >= self.most_runs else []

    # ── Rows ─────────────────────────────────────────────────────────

    def _write_rows(self, run: int, fresh: DataFrame, folded: DataFrame | None) -> None:
        def named(kind: str) -> DataFrame:
            files = contents(fresh.filter(F.col("kind") == kind), self.root)
            path = nfc(F.col("path"))
            return files.select(F.col("path").alias(FILE), path.alias("path"), F.split(path, "/").alias("parts"), "content")

        def write(table: str, rows: DataFrame, derived: bool = False) -> None:
            """A table of this run; what is ``derived`` comes from tables that have the
            folded rows already."""
            if folded is not None and not derived:
                rows = rows.unionByName(self._live(table, folded, run - 1))
            rows = rows.withColumn("__run", F.lit(run))
            rows.write.mode("overwrite").parquet(self._at(run, table))
            self._kinds[table] = rows.schema

        def records() -> None:
            texts = stored(record_texts(named(RECORD), FILE), self._at(run, "texts"))
            by_name = texts.select(FILE, F.col("path").alias("__name"))

            def findings() -> None:
                found = text_violations(texts, self.schema)
                write("findings", found.join(by_name, F.col("record") == F.col("__name")).select(*FIELDS, FILE))

            def rows() -> None:
                write("records", decode_records(texts, self.schema, FILE))
                found = entity_rows(self._rows_of(run, "records"), self.schema, merge=False, carry=(FILE,))
                frames.update({n: f for n, f in found.items() if not is_single(entities(self.schema)[n])})
                together(lambda: write("references", reference_values(frames, self.schema, FILE), True),
                          lambda: write("ids", record_ids(frames, self.schema, FILE), True))

            together(findings, rows)
            _delete(self.spark, self._at(run, "texts"))

        def documents() -> None:
            write("prose", prose_rows(named(PROSE), FILE))
            write("links", node_links(link_table(self._rows_of(run, "prose"), carry=(FILE,))), True)

        frames: dict[str, DataFrame] = {}
        together(records, documents)
        prose = self._rows_of(run, "prose").select(
            "id", "mime_type", heading_array(F.col("content")).alias("headings"), FILE)
        named_files = fresh.select("path", "kind")
        if folded is not None:
            named_files = named_files.unionByName(folded.select("path", "kind"))
        blobs = named_files.filter(F.col("kind") == BLOB).select(F.col("path").alias(FILE), nfc(F.col("path")).alias("path"))
        files = blob_rows(blobs.withColumn("parts", F.split("path", "/")), FILE)
        write("nodes", element_nodes({**frames, PROSE: prose, BLOB: files}, FILE).select("address", "origin", FILE), True)

    def _read(self, run: int, table: str) -> DataFrame:
        """A table of one run; its schema is looked up in its files once."""
        if table not in self._kinds:
            self._kinds[table] = self.spark.read.parquet(self._at(run, table)).schema
        return self.spark.read.schema(self._kinds[table]).parquet(self._at(run, table))

    def _rows_of(self, run: int, table: str) -> DataFrame:
        return self._read(run, table).drop("__run")

    def _runs(self, run: int) -> list[int]:
        """The few runs that hold the rows of a run's snapshot."""
        if run not in self._held:
            rows = self.snapshot(run).select("run").distinct().collect()
            self._held[run] = sorted(r["run"] for r in rows) or [run]
        return self._held[run]

    def _live(self, table: str, files: DataFrame, run: int) -> DataFrame:
        """The rows of a table that ``files`` have, of the snapshot of ``run``."""
        first, *others = self._runs(run)
        every = self._read(first, table)
        if others:
            every = self.spark.read.schema(every.schema).parquet(*[self._at(r, table) for r in (first, *others)])
        held = files.select(F.col("path").alias(FILE), F.col("run").alias("__run"))
        return every.join(held, [FILE, "__run"], "left_semi").drop("__run")

    def _now(self, table: str) -> DataFrame:
        if not self.last:
            raise ValueError(f"nothing was taken in yet: {self.home}")
        return self._live(table, self.snapshot(), self.last)

    def entities(self) -> dict[str, DataFrame]:
        """A frame per declared entity, ``prose`` and ``blob``, as of the last run; as
        :func:`.tree.read_tree` gives them, prose as it is written."""
        frames = entity_rows(self._now("records").drop(FILE), self.schema)
        blobs = self.snapshot().filter(F.col("kind") == BLOB).select(nfc(F.col("path")).alias("path"))
        return {**frames, "prose": self._now("prose").drop(FILE),
                "blob": blob_rows(blobs.withColumn("parts", F.split("path", "/")))}

    def findings(self) -> DataFrame:
        """What the record files break of the schema, as of the last run."""
        return self._now("findings").drop(FILE)

    # ── Checks between records ───────────────────────────────────────

    def dangling(self) -> DataFrame:
        """``entity, record, field, target, attribute, kind, value`` of the references
        of collections whose id is nowhere, as of the last run."""
        return self.spark.read.parquet(self._at(self.last, "dangling")).drop(FILE)

    def duplicates(self) -> DataFrame:
        """``entity, id, rows`` of the ids that several rows of a collection have."""
        repeated = self.spark.read.parquet(self._at(self.last, "repeated"))
        return repeated.filter("attribute = 'id'").select(F.col("target").alias("entity"), F.col("value").alias("id"), "rows")

    def broken_links(self) -> DataFrame:
        """The links of Markdown files into the tree that land nowhere, as of the last
        run: ``id, ord, dest, kind, address, base, fragment``."""
        return self.spark.read.parquet(self._at(self.last, "broken")).drop(FILE)

    def _check(self, run: int, manifest: DataFrame) -> None:
        key = list(REFERENCE_KEY)
        changed = manifest.select("path")
        now, before = self.snapshot(run), self.snapshot(run - 1)
        unchanged = now.join(changed, "path", "left_anti")
        new_files = now.join(changed, "path", "left_semi")
        old_files = before.join(changed, "path", "left_semi")

        def live(table: str, files: DataFrame) -> DataFrame:
            return self._live(table, files, run - 1 if files is old_files else run)

        def differs(table: str, columns: list[str]) -> DataFrame:
            """Values that changed files have now or had before, but not both."""
            new = live(table, new_files).select(columns)
            old = live(table, old_files).select(columns) if run > 1 else new.limit(0)
            sides = new.withColumn("__new", F.lit(1)).unionByName(old.withColumn("__new", F.lit(0)))
            counts = sides.groupBy(columns).agg(F.min("__new").alias("low"), F.max("__new").alias("high"))
            return stored(counts.filter("low = high").select(columns), self._at(run, f"{table}.changed"))

        def earlier(table: str) -> DataFrame:
            """What was found before in files that did not change."""
            rows = self._read(run - 1, table)
            return rows.join(unchanged.select(F.col("path").alias(FILE)), FILE, "left_semi")

        def references() -> None:
            """Those of changed files, and those to ids that came or went."""
            touched, ids = differs("ids", key), live("ids", now).select(key)
            due = live("references", new_files)
            if run > 1:
                due = due.unionByName(live("references", unchanged).join(touched, key, "left_semi"))
            dangling = due.join(ids, key, "left_anti")
            if run > 1:
                dangling = dangling.unionByName(earlier("dangling").join(touched, key, "left_anti"))
            dangling.write.mode("overwrite").parquet(self._at(run, "dangling"))

        def repeats() -> None:
            """Ids of changed files are counted again, the others keep their count."""
            recount = live("ids", new_files).select(key)
            if run > 1:
                recount = recount.union(live("ids", old_files).select(key))
            recount = stored(recount.distinct(), self._at(run, "recount"))
            repeated = live("ids", now).select(key).join(recount, key, "left_semi").groupBy(*key).agg(
                F.count(F.lit(1)).alias("rows")).filter("rows > 1")
            if run > 1:
                repeated = repeated.unionByName(self._read(run - 1, "repeated").join(recount, key, "left_anti"))
            repeated.write.mode("overwrite").parquet(self._at(run, "repeated"))

        def links() -> None:
            """The same for links, by the address or by that of the file it is in."""
            fixed = stored(self._fixed_nodes(now, run), self._at(run, "fixed"))
            moved = differs("nodes", ["address"])
            if run > 1:
                was, is_ = self._read(run - 1, "fixed").select("address"), fixed.select("address")
                moved = moved.union(was.exceptAll(is_)).union(is_.exceptAll(was)).distinct()
            moved = stored(moved, self._at(run, "moved"))
            base = moved.select(F.col("address").alias("base"))
            due = live("links", new_files)
            if run > 1:
                others = live("links", unchanged)
                due = due.unionByName(others.join(moved, "address", "left_semi")).unionByName(
                    others.join(moved, "address", "left_anti").join(base, "base", "left_semi"))
            nodes = live("nodes", now).select("address", "origin").unionByName(fixed)
            broken = broken_links(due, stored(nodes, self._at(run, "addresses")))
            if run > 1:
                broken = broken.unionByName(
                    earlier("broken").join(moved, "address", "left_anti").join(base, "base", "left_anti"))
            broken.write.mode("overwrite").parquet(self._at(run, "broken"))

        self._runs(run)
        together(references, repeats, links)
        for table in ("addresses", "moved", "recount", "ids.changed", "nodes.changed"):
            _delete(self.spark, self._at(run, table))

    def _fixed_nodes(self, now: DataFrame, run: int) -> DataFrame:
        """Nodes of no single file: the collections, and the records of which the
        files have pieces."""
        rows = entity_rows(self._live("records", now, run).drop(FILE), self.schema)
        single = [n for n in rows if is_single(entities(self.schema)[n])]
        empty = self.spark.createDataFrame([], "id string")
        frames = {n: f if n in single else empty for n, f in rows.items()}
        return node_index({**frames, PROSE: empty, BLOB: empty}, single=single).select("address", "origin")
