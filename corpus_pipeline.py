"""From raw documents to packed training sequences, stage by stage.

Each stage is written to the shared folder as Parquet and read again by the
next, so a lost executor never costs more than the tasks it ran.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import exact_dedup, language, near_dedup, packing, pii
from recordloom.llm.common import shared_folder, spare, stage, whole_text
from recordloom.llm.tokens import tokenizer_path
from recordloom.session import ship_package

#: Code length from which on a text is in none of the learned languages: random
#: letters need more than 7 bits a byte, prose of a learned language 2 to 3.
FOREIGN_BITS = 6.5


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what is in a learned language; no letters, or no language, goes."""
    ship_package(spark)
    model = language.learn(docs.filter(~language.held_out("doc_id")))
    name = spare(docs, "judged")
    judged = docs.withColumn(name, language.judgement(spark, model, F.col("text")))
    known = (F.col(f"{name}.lang_pred") != language.UNDETERMINED) & (F.col(f"{name}.bits_per_byte") < FOREIGN_BITS)
    return judged.filter(known).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each text, and one row of it: rows
    that repeat id and text are copies too. Of those that differ in white space, the
    text that sorts first stays."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = exact_dedup.DigestIndex(spark, shared_folder(spark, "index"), buckets)
    judged = index.add(docs).groupBy("doc_id", "text_sha256", "kept").agg(F.count(F.lit(1)).alias("n"))
    marks = stage(judged.filter("not kept or n > 1").select(
        F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("digest"), "kept"), "copies")
    digest = exact_dedup.text_digest(docs["text"])
    same = lambda other: docs["doc_id"].eqNullSafe(other["id"]) & (digest == other["digest"])
    rest = docs.join(marks, same(marks), "left_anti")
    repeated = marks.filter("kept")
    if repeated.isEmpty():
        return rest
    # The key is one struct, so the join has not dealt the rows out by it: each
    # task has chosen its row before a group comes together.
    key, row = spare(docs, "key_of_row"), spare(docs, "row_of_key")
    chosen = docs.join(repeated, same(repeated), "left_semi").groupBy(
        F.struct(docs["doc_id"], digest.alias("digest")).alias(key)).agg(
        F.min_by(F.struct(*[docs[c] for c in docs.columns]), whole_text(docs["text"])).alias(row))
    return rest.unionByName(chosen.select(f"{row}.*"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, that of the smallest id."""
    ship_package(spark)
    copies = stage(near_dedup.near_duplicates(docs, near_dedup.Settings()).filter("not kept").select(
        F.col("doc_id").alias("id")), "near_copies")
    return docs.join(copies, docs["doc_id"] == copies["id"], "left_anti")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets."""
    ship_package(spark)
    clean = pii.redact(docs, pii.find_personal_data(docs))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with the sequence and the place each one goes to."""
    ship_package(spark)
    cut = packing.pieces(docs, tokenizer_path("word_bpe_49k.json"))
    return packing.pack(stage(cut.drop("ids"), "pieces"))


STAGES = [
    ("language", identify),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("personal_data", redact),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs


#: No SQL can express the language model, MinHash or tokenizer stages.
ORACLE_SQL = None

BUILDERS = {"pipeline": run}
SQL: dict[str, str] = {}
