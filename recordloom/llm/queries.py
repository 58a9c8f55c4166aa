"""One registered query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import (
    bpe, credentials, exact_dedup, filter_audit, html_text, language, lexical, licenses, near_dedup, packing, pii, vectors,
    warc)
from recordloom.llm.common import shared_folder, stage
from recordloom.llm.tokens import tokenizer_path
from recordloom.session import ship_package

BUILDERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of the session and a table reader under its name."""

    def add(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return build(spark, lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))

        BUILDERS[build.__name__] = run
        if sql is not None:
            SQL[build.__name__] = sql
        return build

    return add


@query(r"""SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW w AS (PARTITION BY t)""")
def op1_exact_dedup(spark, read):
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = exact_dedup.DigestIndex(spark, shared_folder(spark, "index"), buckets)
    return index.add(read("documents"))


@query()
def op3_bpe_round_trip(spark, read):
    coded = bpe.encode_texts(read("documents"), tokenizer_path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query()
def op4_best_fit_packing(spark, read):
    cut = packing.pieces(read("documents"), tokenizer_path("word_bpe_49k.json"))
    return packing.pack(stage(cut.drop("ids"), "pieces"))


@query()
def op7_ppm_language(spark, read):
    documents = read("documents")
    model = language.learn(documents.filter(~language.held_out("doc_id")))
    return language.predict(documents, model).select(
        "doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query()
def op6_warc_dictionary(spark, read):
    return warc.read_archives(warc.write_archives(read("pages"))).drop("url")


@query()
def op5_html_text(spark, read):
    return html_text.extract_pages(read("pages"))


@query()
def op9_vector_near_dup(spark, read):
    return vectors.link_vectors(read("embeddings"))


@query()
def op2_minhash_near_dup(spark, read):
    return near_dedup.near_duplicates(read("documents"), near_dedup.Settings(words=3, percent=85))


@query()
def op8_linked_secrets(spark, read):
    return credentials.find_secrets(read("documents"))


@query()
def op10_personal_data(spark, read):
    found = pii.find_personal_data(read("documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("bigint")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)],
        F.sha2(pii.span_text(F.col("spans")), 256).alias("base_sha256"),
        pii.span_text(F.concat("spans", F.coalesce("extra", F.array()))).alias("spans"))


@query(licenses.summary_sql())
def op11_license_templates(spark, read):
    return licenses.summary(licenses.find_licenses(read("documents")))


@query(r"""WITH filters AS (
  SELECT unnest([{'f': 'A', 'bit': 1}, {'f': 'B', 'bit': 2}, {'f': 'C', 'bit': 4}, {'f': 'D', 'bit': 8},
    {'f': 'E', 'bit': 16}], recursive := true)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM filters a, filters b, filters c, filters d, filters e
  WHERE length(a.f || b.f || c.f || d.f || e.f) = len(list_distinct([a.f, b.f, c.f, d.f, e.f]))),
worded AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM worded d LEFT JOIN marks m ON d.doc_id = m.doc_id),
counted AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM masks GROUP BY part, mask),
steps AS (SELECT filter_order, step, f, bit FROM orders, range(1, 6) r(step), filters WHERE filter_order[step] = f),
removals AS (
  SELECT filter_order, mask, coalesce(min(step) FILTER (mask & bit > 0), 6) AS gone
  FROM steps, (SELECT DISTINCT mask FROM counted) GROUP BY filter_order, mask),
rows_ AS (
  SELECT c.part, s.filter_order, s.step, s.f,
    coalesce(sum(n) FILTER (gone > s.step), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (gone = s.step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone < s.step AND c.mask & s.bit > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (c.mask = s.bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (gone = s.step), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (gone = s.step), 0)::BIGINT AS toxic_lost
  FROM counted c JOIN removals r ON c.mask = r.mask JOIN steps s ON s.filter_order = r.filter_order
  GROUP BY c.part, s.filter_order, s.step, s.f)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM rows_""")
def op12_filter_audit(spark, read):
    return filter_audit.audit(read("documents"), read("labels"))


@query(r"""WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
held AS (SELECT r, doc_id, len(terms) AS n, terms FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*) AS N_, sum(n)::BIGINT AS L_ FROM held),
postings AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM held)
  GROUP BY r, doc_id, n, term),
asked AS (
  SELECT DISTINCT q, item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS q, item_id, text FROM benchmark)),
weights AS (
  SELECT term, floor(1000 * ln((2 * N_ + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM postings, totals WHERE term IN (SELECT term FROM asked) GROUP BY term, N_),
scores AS (
  SELECT q, item_id, r, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * N_) // L_)))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term), totals GROUP BY q, item_id, r, doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, r) AS rank
  FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50""")
def op13_best_position_search(spark, read):
    return lexical.search(lexical.Index(read("documents")), read("benchmark"))
