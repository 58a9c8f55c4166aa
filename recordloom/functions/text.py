"""Text expressions: addresses, Markdown escapes, relative paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ASCII characters an address segment keeps as they are.
_UNRESERVED = r"A-Za-z0-9._~\-"

# The RFC 3987 ucschar ranges, kept as they are.
_UCSCHAR = (
    r"\x{A0}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFEF}"
    + "".join(rf"\x{{{p:X}0000}}-\x{{{p:X}FFFD}}" for p in range(1, 14))
    + r"\x{E1000}-\x{EFFFD}"
)

# ASCII kept in an external URL. Parentheses are escaped, as they
# would end a Markdown link target.
_URL_KEPT = r":/?#\[\]@!$&'*+,;="


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once per row, however often
    ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def iri_escape(value: Column, kept: str = "") -> Column:
    """Percent-encode all but unreserved ASCII, ``kept`` (the inside of a regex
    character class) and the non-ASCII characters an IRI may carry."""
    plain = f"[{_UNRESERVED}{kept}{_UCSCHAR}]"
    encoded = F.array_join(
        F.transform(
            F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)),
            lambda c: F.when(c.rlike(f"^{plain}$"), c).otherwise(
                F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
            ),
        ),
        "",
    )
    # Nearly all segments need no work; those skip the per-character pass.
    return F.when(value.rlike(f"^{plain}*\\z"), value).otherwise(encoded)


def url_encode(value: Column) -> Column:
    """An external URL, its structure kept, safe inside a Markdown link."""
    return iri_escape(value, _URL_KEPT)


def md_escape(value: Column) -> Column:
    """Every ASCII punctuation mark behind a backslash."""
    return F.regexp_replace(value, r"([!-/:-@\[-`{-~])", r"\\$1")


def md_cell(value: Column) -> Column:
    """Text for a table cell: escaped, on one line."""
    return F.replace(md_escape(value), F.lit("\n"), F.lit("<br>"))


def md_link(text: Column, url: Column) -> Column:
    return F.concat(F.lit("["), md_escape(text), F.lit("]("), url, F.lit(")"))


def _longest_backticks(value: Column) -> Column:
    runs = F.regexp_extract_all(value, F.lit("`+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0))


def md_code(value: Column) -> Column:
    """A code span, fenced with one backtick more than the text holds."""
    fence = F.repeat(F.lit("`"), _longest_backticks(value) + 1)
    pad = value.startswith("`") | value.endswith("`") | ~value.rlike(r"(?U)\S")
    body = F.when(pad, F.concat(F.lit(" "), value, F.lit(" "))).otherwise(value)
    return F.concat(fence, body, fence)


def md_fence(value: Column, language: Column | None = None) -> Column:
    """A code block whose fence is longer than any backtick run inside."""
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), _longest_backticks(value) + 1))
    tag = F.lit("") if language is None else F.coalesce(language, F.lit(""))
    body = F.when(value.endswith("\n"), value).otherwise(F.concat(value, F.lit("\n")))
    return F.concat(fence, tag, F.lit("\n"), body, fence)


def dedent(value: Column) -> Column:
    """``value`` without the leading blanks all its non-blank lines share;
    blank lines become empty."""
    lines = F.transform(
        F.split(value, "\n"), lambda line: F.regexp_replace(line, r"^[ \t]+$", "")
    )
    margins = F.transform(
        F.filter(lines, lambda line: line != ""), lambda line: F.regexp_extract(line, r"^[ \t]*", 0)
    )
    first, last = F.array_min(margins), F.array_max(margins)
    # The smallest and largest margin in sort order share what all share.
    shared = F.size(
        F.filter(
            F.sequence(F.lit(1), F.greatest(F.length(first), F.lit(1))),
            lambda n: (F.length(first) >= n)
            & (F.substring(first, F.lit(1), n) == F.substring(last, F.lit(1), n)),
        )
    )
    cut = F.transform(lines, lambda line: F.substring(line, shared + 1, F.length(line)))
    return F.when(F.size(margins) == 0, F.array_join(lines, "\n")).otherwise(
        F.array_join(cut, "\n")
    )


def shown(value: Column) -> Column:
    """A value as text; an absent one is empty."""
    return F.coalesce(value.cast("string"), F.lit(""))


def folder(path: Column) -> Column:
    """The folder steps of a path as an array."""
    steps = F.split(path, "/")
    return F.slice(steps, 1, F.size(steps) - 1)


def relative_path(target: Column, source: Column) -> Column:
    """The path of file ``target`` as seen from file ``source``."""
    steps = F.struct(folder(source).alias("start"), F.split(target, "/").alias("steps"))
    return bind(steps, lambda p: _climb(p["start"], p["steps"]))


def _climb(start: Column, steps: Column) -> Column:
    same = F.zip_with(start, steps, lambda a, b: F.coalesce(a == b, F.lit(False)))

    def path(shared: Column) -> Column:
        up = F.array_repeat(F.lit(".."), F.size(start) - shared)
        down = F.slice(steps, shared + 1, F.greatest(F.size(steps) - shared, F.lit(0)))
        return F.array_join(F.concat(up, down), "/")

    differ = F.array_position(F.array_append(same, F.lit(False)), False).cast("int")
    joined = bind(differ - 1, path)
    return F.when(F.array_join(start, "/") == F.array_join(steps, "/"), ".").otherwise(joined)


def normal_path(steps: Column) -> Column:
    """Path steps with ``.`` and ``..`` worked off; leading ``..`` stay."""
    return F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda done, step: F.when((step == ".") | (step == ""), done)
        .when(
            (step == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."),
            F.slice(done, 1, F.size(done) - 1),
        )
        .otherwise(F.array_append(done, step)),
    )
