"""Exact duplicates by a persistent digest index.

The index is a table of ``(digest, keep_id)``, bucketed and sorted by digest. A
batch of documents is reduced to one row per digest, compared with the index by
a sort-merge anti-join that reads the index as it lies, and what is new is
appended to it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.common import BLANKS, picked, stage, whole_text


def text_digest(text: Column | str) -> Column:
    """SHA-256 of the text with every run of white space as one space."""
    return F.unhex(F.sha2(F.regexp_replace(whole_text(text), BLANKS, " ").cast("binary"), 256))


class DigestIndex:
    """A digest index in a folder that all executors share.

    Opening the folder of an earlier run goes on with what it holds. ``buckets``
    is fixed when the folder is first used: at scale, as many as give files of a
    few hundred MB.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark = spark
        self.buckets = buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{folder}'")

    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def add(self, documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Judge a batch and append its new texts to the index.

        Returns a row per document: ``doc_id, keep_id, group_size, kept,
        text_sha256``. ``keep_id`` is the document that stays: the one the index
        already holds for this text, or else the smallest id of the batch.
        ``group_size`` counts the batch's documents with that text.

        Null text is empty text. A null id never stays while its text has
        another one; rows that repeat id and text get the same answer each. A very
        long text is hashed where it is read and goes on as its digest. An empty
        batch gives no rows. Other columns of the batch are not looked at.
        """
        rows = stage(
            picked(documents, doc_id=doc_id, text=text).select("doc_id", text_digest("text").alias("digest")),
            "digests")
        groups = stage(
            rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("group_size")),
            "groups")
        fresh = groups.hint("merge").join(self.table(), "digest", "left_anti")
        (fresh.select("digest", F.col("first_id").alias("keep_id")).repartition(self.buckets, "digest")
            .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
            .saveAsTable(self.name))
        known = stage(
            groups.hint("merge").join(self.table(), "digest").select("digest", "keep_id", "group_size"), "known")
        # Two stored tables: AQE splits the digest of a text that a third of the rows share.
        return rows.join(known, "digest").select(
            "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"))
