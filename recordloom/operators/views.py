"""The view clauses: from, flatten, join, where, grouped, select, sort.

Each takes and returns a DataFrame. A frame made by :func:`source` carries a
hidden ordinal column that keeps the source order of rows; the clauses carry it
along, use it for the order inside lists and for ties of a sort, and
:func:`finish` drops it. Catalyst prunes it where nothing needs it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.paths import ORD, Field, column, has_path, resolve, visible
from recordloom.functions.predicates import domain, predicate
from recordloom.operators.groups import nested_lists, orderable

SelectItem = str | tuple[str, str] | Mapping[str, str]


class ClauseError(ValueError):
    """A clause that does not fit the rows it is given."""


def source(frame: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """``frame`` as a view source whose row order is that of the ``order``
    columns. Without them rows have no order of their own, and lists are
    ordered by the content of their rows."""
    if not order:
        return frame
    return frame.withColumn(ORD, F.struct(*[resolve(frame, p).column.alias(f"o{i}")
                                            for i, p in enumerate(order)]))


def finish(frame: DataFrame) -> DataFrame:
    """``frame`` without the hidden ordinal."""
    return frame.drop(ORD)


def where(frame: DataFrame, clause: Mapping[str, object]) -> DataFrame:
    """The rows ``clause`` matches."""
    return frame.filter(predicate(frame, clause))


def select(frame: DataFrame, items: Sequence[SelectItem]) -> DataFrame:
    """The named fields, each optionally renamed. No items: all columns. A name
    given twice keeps its first place and its last present value."""
    if not items:
        return frame
    chosen: dict[str, list[Field]] = {}
    for entry in items:
        path, name = _item(entry)
        chosen.setdefault(name, []).append(resolve(frame, path))
    columns = [_last_present(fields).alias(name) for name, fields in chosen.items()]
    return frame.select(*columns, *_hidden(frame))


def _item(entry: SelectItem) -> tuple[str, str]:
    if isinstance(entry, str):
        return entry, entry
    if isinstance(entry, Mapping):
        return entry["item"], entry.get("as", entry["item"])
    return entry


def _last_present(fields: list[Field]) -> Column:
    last = fields[-1]
    same = [f.column for f in reversed(fields) if f.data_type == last.data_type]
    return F.coalesce(*same) if len(same) > 1 else last.column


def flatten(
    frame: DataFrame, of: str, as_: str | None = None, preserve_empty: bool = False
) -> DataFrame:
    """One row per element of the array ``of``, the element under ``as_``.
    A row with no elements goes away, or with ``preserve_empty`` stays with
    ``as_`` absent."""
    as_ = of if as_ is None else as_
    field = resolve(frame, of)
    if not isinstance(field.data_type, T.ArrayType):
        raise ClauseError(f"flatten target '{of}' is not an array")
    if as_ != of:
        _refuse_taken(frame, as_, "flatten")
    others = [column(n) for n in visible(frame.schema) if n not in (of, as_)]
    if ORD not in frame.columns:
        explode = F.explode_outer if preserve_empty else F.explode
        return frame.select(*others, explode(field.column).alias(as_))
    explode = F.posexplode_outer if preserve_empty else F.posexplode
    out = frame.select(*others, column(ORD), explode(field.column).alias("__at", as_))
    return out.withColumn(ORD, F.struct(column(ORD).alias("a"), F.col("__at").alias("b"))).drop(
        "__at"
    )


def join(
    left: DataFrame,
    right: DataFrame,
    on: tuple[str, str],
    as_: str,
    *,
    right_where: Mapping[str, object] | None = None,
    preserve_empty: bool = False,
    many: DataFrame | None = None,
) -> DataFrame:
    """One row per matching pair, the right row as a struct under ``as_``; with
    ``preserve_empty`` left rows without a match stay, ``as_`` absent.

    ``right_where`` filters the right side before the join, so it never removes
    a left row under ``preserve_empty``.

    AQE splits both sides of a skewed inner join but only the left side of a
    left join. Keys known to have very many right rows may be named in ``many``,
    a frame of one column; they are joined apart as an inner join. The rows are
    the same with and without it.
    """
    left_key, keyed, matchable = _join_sides(left, right, on, as_, right_where)
    condition = left_key == F.col("__rk") if matchable else F.lit(False)
    if many is None or not preserve_empty or not matchable:
        joined = left.join(keyed, condition, "left" if preserve_empty else "inner")
    else:
        hot = many.toDF("__hot").filter("__hot is not null").distinct()
        hot = keyed.select(F.col("__rk").alias("__hot")).distinct().join(hot, "__hot", "left_semi")
        on_left, on_right = left_key == F.col("__hot"), F.col("__rk") == F.col("__hot")
        cold = left.join(hot, on_left, "left_anti").join(
            keyed.join(hot, on_right, "left_anti"), condition, "left"
        )
        joined = cold.unionByName(
            left.join(keyed.join(hot, on_right, "left_semi"), condition, "inner")
        )
    return _merge_order(left, joined.drop("__rk"))


def attach(
    left: DataFrame,
    right: DataFrame,
    on: tuple[str, str],
    as_: str,
    *,
    right_where: Mapping[str, object] | None = None,
    flat: bool = False,
) -> DataFrame:
    """Every left row with the list of its matching right rows under ``as_``,
    an empty list where none match. ``flat`` gives a row per list item instead,
    and one with ``as_`` absent for an empty list."""
    if flat:
        return join(left, right, on, as_, right_where=right_where, preserve_empty=True)
    left_key, keyed, matchable = _join_sides(left, right, on, as_, right_where)
    empty = F.array().cast(T.ArrayType(keyed.schema[as_].dataType))
    keyed = keyed.filter(F.col("__rk").isNotNull() if matchable else F.lit(False))
    keyed = keyed.withColumnRenamed("__rord", ORD)
    lists = nested_lists(keyed, "__rk", column(as_), as_).drop(ORD)
    condition = left_key == F.col("__rk") if matchable else F.lit(False)
    out = left.join(lists, condition, "left").drop("__rk")
    return out.withColumn(as_, F.coalesce(column(as_), empty))


def _join_sides(left, right, on, as_, right_where):
    left_path, right_path = on
    left_field, right_field = resolve(left, left_path), resolve(right, right_path)
    _refuse_taken(left, as_, "join")
    if right_where:
        right = where(right, right_where)
    row = F.struct(*[column(n) for n in visible(right.schema)])
    hidden = [column(ORD).alias("__rord")] if ORD in right.columns else []
    keyed = right.select(right_field.column.alias("__rk"), row.alias(as_), *hidden)
    # Keys of different kinds never match; Spark would cast one and then fail.
    matchable = domain(left_field.data_type) == domain(right_field.data_type)
    return left_field.column, keyed, matchable


def _merge_order(left: DataFrame, joined: DataFrame) -> DataFrame:
    if "__rord" not in joined.columns:
        return joined
    if ORD not in left.columns:
        return joined.drop("__rord")
    both = F.struct(column(ORD).alias("a"), F.col("__rord").alias("b"))
    return joined.withColumn(ORD, both).drop("__rord")


def grouped(frame: DataFrame, by: str, as_: str, *, flat: bool = False) -> DataFrame:
    """One row per value of ``by`` with its whole rows, in source order, under
    ``as_``. A row without ``by`` fails the job. ``flat`` gives a row per item
    instead, which keeps its place in the order."""
    field = resolve(frame, by)
    missing = F.raise_error(F.lit(f"grouped: a row has no '{by}'"))
    key = F.coalesce(field.column, missing.cast(field.data_type))
    row = F.struct(*[column(n) for n in visible(frame.schema)])
    pair = frame.select(key.alias("__key"), row.alias("__row"), *_hidden(frame))
    if flat:
        return pair.select(F.col("__key").alias(by), F.col("__row").alias(as_), *_hidden(frame))
    lists = nested_lists(pair, "__key", F.col("__row"), as_)
    rest = [column(n) for n in lists.columns if n != "__key"]
    return lists.select(F.col("__key").alias(by), *rest)


def sort(
    frame: DataFrame, by: str, direction: str = "asc", missing: str = "last"
) -> DataFrame:
    """Rows ordered by one field. Ties keep source order; rows without the
    field go ``first`` or ``last`` whatever the direction.

    The tie-break also spreads rows that share one value over several range
    partitions.
    """
    if direction not in ("asc", "desc") or missing not in ("first", "last"):
        raise ClauseError(f"unknown sort: {direction}, missing {missing}")
    key = getattr(resolve(frame, by).column, f"{direction}_nulls_{missing}")()
    if ORD in frame.columns:
        ties = [column(ORD)]
    else:
        ties = [column(f.name) for f in frame.schema.fields if orderable(f.dataType)]
    return frame.orderBy(key, *ties)


def _hidden(frame: DataFrame) -> list[Column]:
    return [column(ORD)] if ORD in frame.columns else []


def _refuse_taken(frame: DataFrame, name: str, clause: str) -> None:
    if has_path(frame, name):
        raise ClauseError(f"{clause}: the rows already have a field '{name}'")
