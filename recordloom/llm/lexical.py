"""Ranked lexical search by the Best Position Algorithm.

The index holds every document: its distinct terms with their counts. It is dealt
by a hash into shards of about ``shard_terms`` postings, so their number grows
with the corpus and each fits a task. A shard is searched for a block of queries
at a time: every query term has a list of the shard's documents by descending
impact, and the lists are read from the top in step. A document met in one list
is looked up in all others, and the places found count as seen. The best position
of a list is the last one before which nothing is unseen; no unseen document can
score more than the sum of the impacts there. Reading stops when that sum is
strictly below the k-th score. The shards' best are merged per query.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import picked, sliced, stage

#: Every byte as part of a term, in lower case, or as a blank.
TERM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))


def term_counts(text: bytes, span: int = 1 << 20) -> Counter:
    """Occurrences of each term; long texts are read in spans."""
    spaced = text.translate(TERM_BYTES)
    counts: Counter = Counter()
    at = 0
    while at < len(spaced):
        end = spaced.find(b" ", at + span)
        end = len(spaced) if end < 0 else end
        counts.update(spaced[at:end].split())
        at = end
    return counts


def with_terms(rows: DataFrame) -> DataFrame:
    """``id, n, terms, tfs`` of the rows ``id, text``: the terms they hold, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [term_counts(t.as_py() or b"") for t in batch.column("text")]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            terms = pa.array([t for c in found for t in c], pa.binary())
            tfs = pa.array([n for c in found for n in c.values()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([sum(c.values()) for c in found], pa.int64()),
                 pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, tfs)],
                names=["id", "n", "terms", "tfs"])

    return rows.select(F.col("id").cast("bigint").alias("id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "id bigint, n bigint, terms array<binary>, tfs array<bigint>")


class Index:
    """All documents by their terms, stored in the shared folder, with the number of
    documents that have terms and of all their terms."""

    def __init__(self, documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_terms: int = 1_000_000):
        rows = with_terms(picked(documents, id=doc_id, text=text)).filter("n > 0")
        self.table = stage(rows.withColumn("row", F.monotonically_increasing_id()), "index")
        totals = self.table.agg(
            F.count(F.lit(1)).alias("N"), F.sum("n").alias("L"), F.sum(F.size("terms")).alias("postings")).first()
        self.documents, self.length = totals["N"], totals["L"] or 0
        self.shards = max(1, -(-(totals["postings"] or 0) // shard_terms))

    def weights(self, terms: DataFrame) -> DataFrame:
        """``term, weight`` of the terms that documents hold."""
        held = self.table.select(F.explode("terms").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
        df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        ratio = (2 * F.lit(self.documents) + 2) / (2 * F.col("df") + 1)
        return df.select("term", F.floor(1000 * F.log(ratio)).cast("bigint").alias("weight"))


def impact(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    m = 100 - 50 + 50 * n * documents // length
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class ImpactList:
    """A term's documents by descending impact, and where each document stands."""

    def __init__(self, docs: np.ndarray, impacts: np.ndarray):
        order = np.lexsort((docs, -impacts))
        self.docs, self.impacts = docs[order], impacts[order]
        self.by_doc = np.argsort(self.docs)
        self.sorted_docs = self.docs[self.by_doc]

    def __len__(self) -> int:
        return len(self.docs)

    def places(self, docs: np.ndarray) -> np.ndarray:
        """Direct access: the place of each document, or -1."""
        at = np.minimum(np.searchsorted(self.sorted_docs, docs), len(self) - 1)
        return np.where(self.sorted_docs[at] == docs, self.by_doc[at], -1)


def best_positions(lists: list[ImpactList], weights: list[int], k: int, depth: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The documents that can be among the k highest scores, with their scores, ties
    at the k-th included; ``depth`` places are read first, then twice as many."""
    seen = [np.zeros(len(x) + 1, bool) for x in lists]  # the last place stays unseen
    best = [0] * len(lists)
    docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    read = 0
    longest = max(map(len, lists), default=0)
    while read < longest:
        met = np.unique(np.concatenate([x.docs[read: read + depth] for x in lists]))
        read, depth = read + depth, depth * 2
        new = met[~np.isin(met, docs, assume_unique=True)]
        score = np.zeros(len(new), np.int64)
        bound = 0
        for i, (x, w) in enumerate(zip(lists, weights, strict=True)):
            at = x.places(new)
            hit = at >= 0
            score[hit] += w * x.impacts[at[hit]]
            seen[i][at[hit]] = True
            best[i] += int(seen[i][best[i]:].argmin())
            if best[i] < len(x):
                bound += w * int(x.impacts[best[i] - 1])
        docs, scores = np.concatenate([docs, new]), np.concatenate([scores, score])
        if len(scores) > k:  # keep what can still be among the best
            low = np.partition(scores, len(scores) - k)[len(scores) - k]
            if bound < low:
                break
    if len(scores) > k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        docs, scores = docs[keep], scores[keep]
    return docs, scores


_BEST = pa.schema([(c, pa.int64()) for c in ("query", "id", "row", "score")])


def _search_shard(index: pa.Table, queries: pa.Table, k: int, documents: int, length: int) -> pa.Table:
    """The shard's k best of each query; of equal scores those of the smallest ids."""
    if not len(index) or not len(queries):
        return _BEST.empty_table()
    terms = index.column("terms").combine_chunks()
    asked = queries.column("term").combine_chunks()
    known = pc.unique(asked)
    ends = terms.offsets.to_numpy()
    owner = np.repeat(np.arange(len(terms)), np.diff(ends))
    which = pc.index_in(terms.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
    hit = np.flatnonzero(which >= 0)
    which, owner = which[hit], owner[hit]
    tfs = index.column("tfs").combine_chunks().flatten().to_numpy()[hit]
    values = impact(tfs, index.column("n").to_numpy()[owner], documents, length)
    order = np.argsort(which, kind="stable")
    cut = np.searchsorted(which[order], np.arange(len(known) + 1))
    made: dict[int, ImpactList] = {}

    def listed(term: int) -> ImpactList:
        if term not in made:
            part = order[cut[term]: cut[term + 1]]
            made[term] = ImpactList(owner[part], values[part])
        return made[term]

    ids = index.column("id").fill_null(0).to_numpy()
    null = index.column("id").is_null().to_numpy()
    rows = index.column("row").to_numpy()
    number = queries.column("query").to_numpy()
    weight = queries.column("weight").to_numpy()
    term = pc.index_in(asked, value_set=known).to_numpy()
    out: list[tuple[np.ndarray, ...]] = []
    by_query = np.argsort(number, kind="stable")
    for at in np.split(by_query, np.flatnonzero(np.diff(number[by_query])) + 1):
        at = [i for i in at if weight[i] > 0 and cut[term[i]] < cut[term[i] + 1]]
        if not at:
            continue
        docs, scores = best_positions([listed(term[i]) for i in at], [int(weight[i]) for i in at], k)
        top = np.lexsort((rows[docs], ids[docs], null[docs], -scores))[:k]
        top = top[scores[top] > 0]
        out.append((np.full(len(top), number[at[0]]), docs[top], scores[top]))
    query, docs, scores = (
        np.concatenate([o[c] for o in out]) if out else np.empty(0, np.int64) for c in range(3))
    return pa.table([
        pa.array(query, pa.int64()), index.column("id").take(pa.array(docs)).combine_chunks(),
        pa.array(rows[docs], pa.int64()), pa.array(scores, pa.int64())], schema=_BEST)


def search(
    index: Index, items: DataFrame, item_id: str = "item_id", text: str = "text", k: int = 50, block: int = 512,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of the highest scores
    above 0 for each item, equal scores by ascending id.

    Terms are runs of ASCII digits and letters and of all characters beyond ASCII,
    A-Z as lower case; an item's terms count once each. Null and empty texts have
    no terms: such documents are not counted, such items have no rows. Each row of
    either table is a document or item of its own, also where rows repeat; ids may
    be null, and null ids stand last among equals. Very long texts are read in
    spans. An empty table on either side gives no rows. Other columns are not
    looked at.
    """
    asked = with_terms(picked(items, id=item_id, text=text)).filter("n > 0").select(
        F.monotonically_increasing_id().alias("query"), "id", "terms")
    asked = stage(asked, "items")
    words = asked.select("query", F.explode("terms").alias("term"))
    weighed = stage(words.join(stage(index.weights(words), "weights"), "term"), "asked")
    blocks = -(-asked.count() // block)
    if not blocks or not index.documents:
        return items.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    # Each shard meets each block of items once; both are bounded.
    shard = F.pmod(F.xxhash64("row"), F.lit(index.shards)).cast("int")
    left = index.table.withColumn("shard", shard).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = weighed.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(index.shards - 1))))
    documents, length = index.documents, index.length

    def run(index_part: pa.Table, queries: pa.Table) -> pa.Table:
        return _search_shard(index_part, queries, k, documents, length)

    best = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        run, "query bigint, id bigint, row bigint, score bigint")
    best = stage(best, "best")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("query", F.col("id").alias("item_id")), "query").select(
        "item_id", "rank", F.col("id").alias("doc_id"), "score")
