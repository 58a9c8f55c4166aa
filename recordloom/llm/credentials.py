"""Secret scans that link the parts of a credential.

Strong parts are reported by their form alone: assigned secrets, access
identifiers, long hexadecimal strings. Weak parts (a user or client name, a
bare 40-character key, an endpoint) look like much else and are reported only
where the parts that complement them stand in the same scope, which is the text
within ``reach`` characters: an interval join of weak parts with all parts.

All of it is column expressions and joins. Positions come from splitting a text
at its matches; the lengths add up in a window over the matches alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.common import picked, stage, whole_text


@dataclass(frozen=True)
class Part:
    """``keep``: what a matched text must pass, besides the pattern. ``needs``: the
    roles that must stand near a weak part."""

    kind: str
    role: str
    pattern: str
    keep: Callable[[Column], Column] = lambda found: F.lit(True)
    needs: tuple[str, ...] = ()


ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: In the order in which kinds are listed at equal starts. The first three are
#: the strong ones.
PARTS = (
    Part("assign", "secret", ASSIGN, lambda found: F.length(F.regexp_extract(found, ASSIGN, 1)) >= 8),
    Part("access", "identifier", r"AKIA[A-Z0-9]+", lambda found: F.length(found) >= 16),
    Part("hex", "secret", r"[0-9a-f]{32,}"),
    Part("identity", "identifier",
         r"""\b(?:(?i:client_?id|access_?key_?id|user_?name|account_?id|login|user))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""",
         needs=("secret",)),
    Part("key", "secret", r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])",
         lambda found: found.rlike("[A-Z]") & found.rlike("[a-z]") & found.rlike("[0-9]"), ("identifier",)),
    Part("endpoint", "endpoint",
         r"""(?:https?|s3|ftp|amqps?|redis|mongodb|postgres(?:ql)?|mysql|jdbc:[a-z]+)://[^\s"'<>]+""",
         needs=("identifier", "secret")),
)
STRONG = tuple(p.kind for p in PARTS if not p.needs)
ORDER = {p.kind: n for n, p in enumerate(PARTS)}


def _matches(text: Column, part: Part) -> Column:
    """The matches with the length of the text before each, up to the one before."""
    found = F.regexp_extract_all(text, F.lit(part.pattern), F.lit(0))
    between = F.split(text, part.pattern, -1)
    pairs = F.zip_with(found, between, lambda m, g: F.struct(
        F.lit(part.kind).alias("kind"), F.length(g).alias("gap"), m.alias("found")))
    empty = F.expr("cast(array() as array<struct<kind: string, gap: int, found: string>>)")
    return F.when(text.rlike(part.pattern), F.filter(pairs, lambda x: x["found"].isNotNull())).otherwise(empty)


def parts_of(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A stored row per document, ``uid, doc_id, hits``; the uid tells rows apart."""
    rows = picked(documents, doc_id=doc_id, text=text).select("doc_id", whole_text("text").alias("text"))
    hits = F.concat(*[_matches(F.col("text"), p) for p in PARTS])
    return stage(rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", hits.alias("hits")), "hits")


def located(stored: DataFrame) -> DataFrame:
    """``uid, kind, role, start, end, found`` of the matches that pass, end exclusive."""
    each = stored.filter(F.size("hits") > 0).select("uid", F.posexplode("hits").alias("n", "hit")).select(
        "uid", "n", "hit.*")
    run = Window.partitionBy("uid", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.length("found")).over(run)
    passes = reduce(lambda c, p: c.when(F.col("kind") == p.kind, p.keep(F.col("found"))), PARTS, F.when(F.lit(False), True))
    role = reduce(lambda c, p: c.when(F.col("kind") == p.kind, p.role), PARTS, F.when(F.lit(False), ""))
    return each.withColumn("end", end).filter(passes).select(
        "uid", "kind", role.alias("role"), (F.col("end") - F.length("found")).alias("start"), "end", "found")


def linked(spans: DataFrame, reach: int) -> DataFrame:
    """The weak spans whose complements are within reach.

    Spans are laid on a grid as wide as the reach. Per square and role only the
    first start and the last end are kept, which is all that the nearest part on
    either side can be; so a square full of parts is one row, and no pairs of
    parts are written out.
    """
    square = lambda at: F.floor(F.col(at) / reach)
    grid = spans.withColumn("square", F.explode(F.sequence(square("start"), square("end"))))
    here = grid.groupBy("uid", "square", "role").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    weak = [p.kind for p in PARTS if p.needs]
    around = spans.filter(F.col("kind").isin(weak)).withColumn(
        "square", F.explode(F.sequence(square("start") - 1, square("end") + 1)))
    near = around.join(here.withColumnRenamed("role", "near"), ["uid", "square"]).filter(
        (F.col("first") - F.col("end") <= reach) & (F.col("start") - F.col("last") <= reach))
    roles = near.groupBy("uid", "kind", "start", "end").agg(F.collect_set("near").alias("near"))
    enough = reduce(
        lambda c, p: c.when(F.col("kind") == p.kind, F.size(F.array_except(
            F.array(*map(F.lit, p.needs)), "near")) == 0),
        [p for p in PARTS if p.needs], F.when(F.lit(False), True))
    return roles.filter(enough).select("uid", "kind", "start", "end")


def find_secrets(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = 200,
) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked`` of every
    whole text.

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then
    kind as listed, joined by commas; ``base_sha256`` is over those of the three
    strong kinds. A weak span may lie in or over a strong one. Null and empty
    texts have no spans; repeated rows are scanned row by row; null ids are passed
    through. An empty table gives no rows. Other columns are not looked at.
    """
    stored = parts_of(documents, doc_id, text)
    spans = stage(located(stored), "spans")
    strong = spans.filter(F.col("kind").isin(*STRONG)).select("uid", "kind", "start", "end")
    every = strong.union(linked(spans, reach))
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv]), F.col("kind"))
    said = F.struct("start", rank.alias("rank"), "end", F.concat_ws(":", "kind", "start", "end").alias("span"))
    per = every.groupBy("uid").agg(
        F.array_sort(F.collect_list(said)).alias("all"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in STRONG],
        F.count_if(~F.col("kind").isin(*STRONG)).alias("n_linked"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["span"]), ",")
    base = F.filter("all", lambda x: x["rank"] < len(STRONG))
    with_hits = stored.filter(F.size("hits") > 0).select("uid", "doc_id").join(per, "uid", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in STRONG],
        F.sha2(F.coalesce(joined(base), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(joined("all"), F.lit("")).alias("spans"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"))
    zero = F.lit(0).cast("bigint")
    without = stored.filter(F.size("hits") == 0).select(
        "doc_id", *[zero.alias(f"n_{k}") for k in STRONG], F.sha2(F.lit(""), 256).alias("base_sha256"),
        F.lit("").alias("spans"), zero.alias("n_linked"))
    return with_hits.union(without)
