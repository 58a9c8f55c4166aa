"""Near duplicates by MinHash with sequential Bayesian verification.

Documents with the same shingle set are one class. Classes that agree on a band
of their signatures are candidates. A candidate pair's signatures are compared
batch by batch; as soon as the posterior probability that the pair is similar
enough falls below the miss probability, it is dropped. Survivors are verified
on their full shingle sets.

What is asked for are groups, so a bucket's pairs are not all written out: first
every member is compared with one centre of its bucket; what the verified links
do not yet join to the bucket's largest group is then compared with all others
of the bucket, block by block, so no link between different texts is lost. The
blocks carry the full sets, and only a spanning forest of verified links leaves
a task.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import blocked_pairs, components, forest, picked, sliced, stage, unstage, whole_text

U64 = np.uint64


@dataclass(frozen=True)
class Settings:
    """``percent``: similarity to link at, in hundredths. ``batch`` hashes are
    compared at a time. Bands of ``band`` hashes, as many as leave a pair just at
    the threshold undiscovered with probability ``undiscovered`` at most. Blocks
    of a bucket hold about ``block_members`` signatures or ``block_shingles``
    shingles."""

    words: int = 5
    percent: int = 80
    band: int = 4
    batch: int = 16
    undiscovered: float = 1e-6
    miss: float = 1e-6
    block_members: int = 2000
    block_shingles: int = 500_000
    seed: int = 11

    @property
    def bands(self) -> int:
        need = math.log(self.undiscovered) / math.log(1 - (self.percent / 100) ** self.band)
        return math.ceil(math.ceil(need) * self.band / self.batch) * self.batch // self.band

    @property
    def hashes(self) -> int:
        return self.bands * self.band

    def least_matches(self) -> np.ndarray:
        """Fewest matches to go on with after 1, 2, ... batches: with uniform prior
        the similarity given m of n matches is Beta(m + 1, n - m + 1), and it is at
        least t with the probability that n + 1 throws of chance t give m at most."""
        t = self.percent / 100
        out = []
        for n in range(self.batch, self.hashes + 1, self.batch):
            tail = np.cumsum([math.comb(n + 1, j) * t**j * (1 - t) ** (n + 1 - j) for j in range(n + 1)])
            out.append(int(np.searchsorted(tail, self.miss, "left")))
        return np.array(out)


# ── Shingles and signatures ──────────────────────────────────────────


class Words(dict):
    """Word -> 64-bit hash, remembered within a task."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingles(text: str, words: int, known: Words) -> np.ndarray:
    """The distinct word shingles as sorted 64-bit hashes. Only A-Z is lowered;
    words end at ASCII white space; fewer words than that make one shingle."""
    parts = text.encode().lower().split()
    if not parts:
        return np.empty(0, U64)
    if len(known) > 200_000:
        known.clear()
    each = np.fromiter(map(known.__getitem__, parts), U64, len(parts))
    width = min(words, len(parts))
    out = np.full(len(parts) - width + 1, width * 0x9E3779B97F4A7C15 % 2**64, U64)
    for k in range(width):
        out = (out ^ each[k: len(out) + k]) * U64(0xD6E8FEB86659FD93)
        out ^= out >> U64(32)
    return np.unique(out)


@functools.lru_cache(8)
def _rearrangements(hashes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    return (draw.integers(0, 2**63, hashes, dtype=np.int64).astype(U64) * U64(2) + U64(1),
            draw.integers(0, 2**63, hashes, dtype=np.int64).astype(U64))


def signature(hashes: np.ndarray, settings: Settings) -> bytes:
    """The smallest of each random rearrangement of the shingle hashes."""
    a, b = _rearrangements(settings.hashes, settings.seed)
    low = np.full(settings.hashes, 2**32 - 1, np.uint32)
    for at in range(0, len(hashes), 1024):
        part = hashes[at: at + 1024, None] * a[None] + b[None]
        np.minimum(low, (part >> U64(32)).astype(np.uint32).min(0), out=low)
    return low.astype("<u4").tobytes()


def signed(documents: DataFrame, settings: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in sliced(batches):
            sets = [shingles(t, settings.words, known) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                          pa.binary()),
                 pa.array([signature(s, settings) if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "sig"])

    return documents.mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, sig binary")


def shingle_sets(documents: DataFrame, settings: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in sliced(batches, 64):
            texts = batch.column("text").to_pylist()
            sets = [np.sort(shingles(t, settings.words, known).view(np.int64)) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "members"])

    return documents.mapInArrow(run, "node bigint, members array<bigint>")


# ── Candidates ───────────────────────────────────────────────────────


def survivors(left: np.ndarray, right: np.ndarray, settings: Settings) -> np.ndarray:
    """Row numbers of the pairs, given by row of ``left`` and of ``right``, that no
    batch of signature comparisons rules out."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for k, least in enumerate(settings.least_matches()):
        at = slice(k * settings.batch, (k + 1) * settings.batch)
        matches[alive] += (left[alive, at] == right[alive, at]).sum(1)
        alive = alive[matches[alive] >= least]
    return alive


def _signatures(column: pa.Array, settings: Settings) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, settings.hashes)


def pruned(pairs: DataFrame, classes: DataFrame, settings: Settings) -> DataFrame:
    """The candidate pairs (a, b) that may be similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = survivors(
                _signatures(batch.column("sig_a"), settings), _signatures(batch.column("sig_b"), settings), settings)
            yield batch.select(["a", "b"]).take(pa.array(keep))

    side = lambda name: classes.select(
        F.col("node").alias(name), F.col("sig").alias(f"sig_{name}"), F.col("n").alias(f"n_{name}"))
    fit = f"100 * least(n_a, n_b) >= {settings.percent} * greatest(n_a, n_b)"
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(fit)
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """The pairs similar enough by their full sets."""
    side = lambda name: sets.select(F.col("node").alias(name), F.col("members").alias(f"set_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - F.col("common")
    return both.withColumn("common", common).filter(F.col("common") * 100 >= union * settings.percent).select("a", "b")


def rest_links(members: DataFrame, compared: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) between different groups within a bucket that were not compared
    with its centre: whoever is outside the bucket's largest group, with all
    others. A pair is compared in the first bucket it shares, and of a block's
    links only a spanning forest is returned. Signatures and sets are joined to the
    members of buckets with several groups alone."""
    mark = lambda seed: F.bit_xor(F.xxhash64("node", F.lit(seed)))
    sizes = members.groupBy("key", "label").agg(
        F.count(F.lit(1)).alias("rows"), F.min("band").alias("band"), mark("a").alias("x"), mark("b").alias("y"))
    buckets = sizes.groupBy("key").agg(
        F.max_by("label", F.struct("rows", "label")).alias("main"), F.count(F.lit(1)).alias("labels"),
        F.sum("rows").alias("total"), F.min("band").alias("band"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    # Of buckets with the same members the first one has all their pairs.
    mixed = stage(
        buckets.filter("labels > 1 and total > 2").groupBy("total", "x", "y").agg(
            F.min_by(F.struct("key", "main"), F.struct("band", "key")).alias("first")).select("first.*"), "mixed")
    open_members = stage(
        members.join(mixed, "key").filter("node <> center").join(compared, "node"), "open")
    member = ["key", "node", "label", "main", "band", "n", "sig"]

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = (batch.column(c)[k].values for c in ("left", "right"))
                nodes = [np.empty(0, np.int64)]
                for i, j in _near_pairs(x, y, settings):
                    nodes += [np.unique(x.field("node").to_numpy()[i]), np.unique(y.field("node").to_numpy()[j])]
                found = np.unique(np.concatenate(nodes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), x.field("key")[0].as_py())), pa.array(found)], names=["key", "node"])

    # By signatures alone first: only members with a partner left carry their sets.
    outside = F.col("label") != F.col("main")
    left = stage(blocked_pairs(
        open_members.filter(outside), open_members, ["key"], member, settings.block_members, "node").mapInArrow(
        hopeful, "key bigint, node bigint").distinct(), "hopeful")
    here = stage(open_members.join(left, ["key", "node"]).join(sets, "node"), "here")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield _across(*(batch.column(c)[k].values for c in ("left", "right")), settings)

    blocks = blocked_pairs(
        here.filter(outside), here, ["key"], [*member, "members"], settings.block_shingles, "node", weight="n")
    found = stage(blocks.mapInArrow(run, "a bigint, b bigint"), "rest")
    unstage(open_members, left, here)
    return found


def _near_pairs(x: pa.StructArray, y: pa.StructArray, settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of pairs of different groups that no batch of signatures rules
    out, in the first bucket they share."""
    node, label, n = ([s.field(c).to_numpy() for s in (x, y)] for c in ("node", "label", "n"))
    main, band = y.field("main").to_numpy(), int(y.field("band")[0].as_py())
    sigs = [_signatures(s.field("sig"), settings) for s in (x, y)]
    step = max(1, 200_000 // max(1, len(node[1])))
    for at in range(0, len(node[0]), step):
        part = slice(at, at + step)
        size = n[0][part, None], n[1][None]
        allowed = (label[0][part, None] != label[1][None]) & (
            100 * np.minimum(*size) >= settings.percent * np.maximum(*size))
        # Two outsiders meet twice; once is enough.
        allowed &= (label[1] != main)[None] <= (node[0][part, None] < node[1][None])
        i, j = np.nonzero(allowed)
        i += at
        keep = survivors(sigs[0][i], sigs[1][j], settings)
        i, j = i[keep], j[keep]
        same = (sigs[0][i] == sigs[1][j]).reshape(-1, settings.bands, settings.band).all(2)
        keep = same.argmax(1) == band
        yield i[keep], j[keep]


def _across(x: pa.StructArray, y: pa.StructArray, settings: Settings) -> pa.RecordBatch:
    node = [s.field("node").to_numpy() for s in (x, y)]
    sets = [_arrays(s.field("members")) for s in (x, y)]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i, j in _near_pairs(x, y, settings):
        for k in np.unique(i):
            others = j[i == k]
            near = _similar(sets[0][k], [sets[1][o] for o in others], settings.percent)
            found.append((np.full(near.sum(), node[0][k]), node[1][others[near]]))
    a, b = (np.concatenate([f[s] for f in found]) if found else np.empty(0, np.int64) for s in (0, 1))
    a, b = forest(a, b)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]


def _similar(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the other sets have the Jaccard similarity with the one; sets are sorted."""
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    common = np.add.reduceat(one[at] == flat, np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64)
    return 100 * common >= percent * (len(one) + sizes - common)


def regrouped(groups: DataFrame, links: DataFrame) -> DataFrame:
    """The groups after more links: only groups that a link joins are touched."""
    def label(name: str) -> DataFrame:
        return groups.select(F.col("node").alias(name), F.col("component").alias(f"group_{name}"))

    between = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(
        "a", "b", F.coalesce("group_a", "a").alias("x"), F.coalesce("group_b", "b").alias("y"))
    between = stage(between, "between")
    merged = components(between.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    merged = stage(merged.select(F.col("node").alias("component"), F.col("component").alias("new")), "merged")
    single = between.select("a").union(between.select("b")).distinct().withColumnRenamed("a", "node").join(
        groups, "node", "left_anti").withColumn("component", F.col("node"))
    return groups.unionByName(single).join(merged, "component", "left").select(
        "node", F.coalesce("new", "component").alias("component"))


# ── Job ──────────────────────────────────────────────────────────────


def near_duplicates(
    documents: DataFrame, settings: Settings | None = None, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every whole text.

    Texts are linked when their sets of distinct word shingles have a Jaccard
    similarity of ``percent`` hundredths or more; a text of fewer words than a
    shingle is one shingle; one without words, or null, has none and is linked
    with nothing. ``component_id`` is the smallest id reachable by links, and the
    document with that id is ``kept``. Equal texts are linked; rows that repeat
    an id are one document, linked with whatever either text is linked with. Rows
    without an id are never linked and always kept. An empty table gives no
    rows. Other columns are not looked at.
    """
    settings = settings or Settings()
    rows = picked(documents, doc_id=doc_id, text=text).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), whole_text("text").alias("text"))
    docs = stage(signed(rows, settings), "signed")
    named = docs.filter("set_key is not null and doc_id is not null")
    classes = stage(
        named.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.any_value("n_shingles").alias("n"),
                                     F.any_value("sig").alias("sig")), "classes")
    width = 4 * settings.band
    band_keys = F.array(*[
        F.xxhash64(F.lit(k), F.substring("sig", width * k + 1, width)) for k in range(settings.bands)])
    banded = classes.select("node", F.posexplode(band_keys).alias("band", "key"))
    centres = stage(
        banded.groupBy("key").agg(F.min_by("node", F.xxhash64("node", "key")).alias("center"),
                                  F.count(F.lit(1)).alias("size")).filter("size > 1"), "centres")
    members = stage(banded.join(centres, "key"), "members")
    nodes = stage(members.select("node").distinct(), "nodes")
    sets = stage(shingle_sets(
        rows.join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi"), settings), "sets")

    # Only what shares a bucket is compared; all others stay out of the joins.
    compared = stage(classes.join(nodes, "node", "left_semi").select("node", "n", "sig"), "compared")
    a, b = F.least("node", "center"), F.greatest("node", "center")
    stars = stage(members.filter("node <> center").select(a.alias("a"), b.alias("b")).distinct(), "stars")
    candidates = stage(pruned(stars, compared, settings), "pruned")
    unstage(stars, nodes)
    links = stage(verified(candidates, sets, settings), "links")
    unstage(candidates)
    groups = stage(components(links), "groups")
    labelled = stage(members.filter("size > 2").join(groups, "node", "left").select(
        "node", "band", "key", "center", F.coalesce("component", "node").alias("label")), "labelled")
    unstage(members)
    groups = stage(regrouped(groups, rest_links(labelled, compared, sets, settings)), "groups")
    unstage(labelled, sets, compared)
    joined = classes.select("set_key", "node").join(groups, "node", "left").select(
        "set_key", F.coalesce("component", "node").alias("component"))
    # The same id under several texts joins their groups.
    found = docs.join(joined, "set_key", "left")
    return found.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias(
            "component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
