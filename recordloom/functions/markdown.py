"""Headings and inline links of Markdown texts, as column expressions.

A text is cut into tokens by one pattern, in one pass: links, and between them
runs of all else, of which code fences, code spans, comments, tags and escapes are
parts, so nothing inside them is taken for a link. A run of plain characters is
one step of the pattern, and what only a line can begin with is looked for only
after a line break. Putting the tokens together again gives the text back.
Headings are found in the same way by a pattern of their own.

Covered: ATX headings, also inside quotes and list items; a paragraph of any
number of lines underlined by ``=`` or ``-``; backtick and tilde fences; indented code after a
blank line; comments and tags; inline links and images ``[text](target)``
without title. An image inside a link's text belongs to that text. Not covered:
reference links, titles, targets in angle brackets or with escapes or entities.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.text import bind

# Loops over groups are possessive: Java then runs them without recursion, so
# long texts do not use up the stack.
_INSIDE = r"(?: {0,3}(?:>|[-+*](?=[ \t])|[0-9]{1,9}[.)](?=[ \t]))[ \t]?+)*+"
_CLOSE = r" {0,3}\1[`~]*+[ \t\r]*+$"
_FENCE = rf"(?md:^{_INSIDE} {{0,3}}(`{{3,}}+(?![^\n]*`)|~{{3,}}+)[^\n]*+(?:\n(?!{_INSIDE}{_CLOSE})[^\n]*+)*+(?:\n[^\n]*+)?+)"
_COMMENT = r"<!--(?s:.*?)(?:-->|\z)"
_BLOCK_TAG = r"(?md:^ {0,3}</?+[A-Za-z][A-Za-z0-9-]*+(?:[\s/>]|$)[^\n]*+(?:\n(?![ \t]*+$)[^\n]*+)*+)"
_ATX = rf"(?md:^{_INSIDE} {{0,3}}#{{1,6}}+(?:[ \t\r][^\n]*+)?+$)"
# What ends a paragraph, or is none: headings, quotes, tags, lists, rules, blank lines.
_NO_TEXT = (
    r" {0,3}(?:#{1,6}+(?:[ \t\r]|$)|>|<|[-+*](?:[ \t]|$)|[0-9]{1,9}[.)](?:[ \t]|$)|[-*_][-*_ \t]*+$|=)|[ \t\r]*+$"
)
_UNDERLINE = r" {0,3}(?:=++|-++)[ \t\r]*+$"
# A paragraph as a whole, so that long ones are read once; a heading if it is underlined.
_PARAGRAPH = (
    rf"(?md:^(?!{_NO_TEXT}| {{4}}|\t)[^\n]++(?:\n(?!{_NO_TEXT}| {{0,3}}(?:`{{3}}|~{{3}}))[^\n]++)*+(?:\n{_UNDERLINE})?+)"
)
_HEADINGS = f"{_FENCE}|{_COMMENT}|{_BLOCK_TAG}|{_ATX}|{_PARAGRAPH}"
_OUTLINE = f"{_FENCE}|{_COMMENT}|{_BLOCK_TAG}|(?md:^ {{0,3}}#{{1,6}}+(?=[ \\t\\r]|$))"

_INDENTED = r"(?: {4}|\t)[^\n]*+(?:\n(?: {4}|\t)[^\n]*+)*+"
_CODE = r"(`++)(?:[^`\n]++|\n(?![ \t]*+\n)|(?!{0}(?!`))`++)*+{0}(?!`)"
_ESCAPE = r"\\[!-/:-@\[-`{-~]"
_TAG = r"</?[A-Za-z][^<>\n]*+>"
_TEXT = (
    r"(?:[^\[\]\\`!\n]++|\n(?![ \t]*+\n)|\\[^\n]|" + _CODE.replace("{0}", r"\3") + r"|`++"
    r"|!\[[^\[\]\n]*+\]\([^()\n]*+\)|!|\[[^\[\]\n]*+\](?!\())*+"
)
_LINK = rf"!?\[{_TEXT}\]\((?:[^\s()\\<>&]++|&(?![#A-Za-z0-9]++;)|\([^\s()\\<>]*+\))*+\)"
# What is no link: a plain run; a fence or, after a blank line, indented code, where
# a line begins; a comment, an escape, a code span, a tag; or one character.
_OTHER = (
    rf"(?:\n|\A){_FENCE}|(?:(?:\n|\A)[ \t]*+\n|\A){_INDENTED}|[^\n!\[<\\`]++|{_COMMENT}|{_ESCAPE}|"
    + _CODE.replace("{0}", r"\2") + rf"|`++|{_TAG}|[\n<\\]"
)
# The start of a text begins a line too; there code needs no blank line before it.
_LINKS = rf"(?:{_OTHER})++|{_LINK}|[!\[]"


def cut(text: Column, pattern: str) -> Column:
    """Array of ``(gap, mark)``; the last one has the rest of the text as its gap
    and no mark."""
    marks = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(F.split(text, pattern, -1), marks, lambda g, m: F.struct(g.alias("gap"), m.alias("mark")))


def joined(tokens: Column, new: Callable[[Column, Column], Column]) -> Column:
    """The text of the tokens with each replaced by ``new(token, its number)``."""
    return F.array_join(F.transform(tokens, new), "")


# ── Headings ─────────────────────────────────────────────────────────


def visible(title: Column) -> Column:
    """A title without link targets, emphasis by underscores, and entities."""
    flat = F.regexp_replace(title, r"!?\[([^\[\]]*+)\]\([^()]*+\)", "$1")
    flat = F.regexp_replace(flat, r"(?<![\p{L}\p{N}_])(_++)([^_\s](?:[^_]*+[^_\s])?)\1(?![\p{L}\p{N}_])", "$2")
    return F.regexp_replace(flat, r"&[#A-Za-z0-9]++;", "")


def slug(text: Column) -> Column:
    """An anchor: letters, marks, digits and connectors in lower case, blanks as
    hyphens. A capital sigma is lowered as if it stood inside a word."""
    kept = F.regexp_replace(text, r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\- ]", "")
    return F.translate(F.lower(F.translate(kept, "Σ", "σ")), " ", "-")


def _heading(mark: Column) -> Column:
    hashes = F.regexp_extract(mark, rf"^{_INSIDE} {{0,3}}(#{{1,6}}+)(?:[ \t]|\r?\z)", 1)
    line = F.regexp_replace(mark, rf"^{_INSIDE} {{0,3}}#++[ \t]*+", "")
    atx = F.regexp_replace(line, r"(?:^|[ \t]++)#++[ \t\r]*+\z|[ \t\r]++\z", "")
    last = F.substring_index(mark, "\n", -1)
    under = mark.contains("\n") & last.rlike(_UNDERLINE) & ~mark.rlike(rf"^{_INSIDE} {{0,3}}(?:`{{3}}|~{{3}}|<)")
    level = F.when(hashes != "", F.length(hashes)).when(under, F.when(last.contains("="), 1).otherwise(2))
    title = F.when(hashes != "", F.regexp_replace(atx, r"[ \t]++\z", "")).when(
        under, F.regexp_replace(F.regexp_replace(mark, r"\n[^\n]*+\z", ""), r"^\s++|\s++\z", ""))
    return F.struct(title.alias("title"), level.cast("bigint").alias("level"))


def _numbered(names: Column) -> Column:
    """Each name, or with the lowest number that makes it a new one."""

    def add(done: Column, name: Column) -> Column:
        tries = F.transform(
            F.sequence(F.lit(0), F.size(done)),
            lambda k: F.when(k == 0, name).otherwise(F.concat(name, F.lit("-"), k.cast("string"))))
        return F.array_append(done, F.get(F.filter(tries, lambda t: ~F.array_contains(done, t)), F.lit(0)))

    apart = F.size(F.array_distinct(names)) == F.size(names)
    return F.when(apart, names).otherwise(F.aggregate(names, F.array().cast("array<string>"), add))


def headings(text: Column) -> Column:
    """Array of ``(id, title, level)``; a repeated id is numbered."""
    marks = F.regexp_extract_all(text, F.lit(_HEADINGS), F.lit(0))
    # Most marks are paragraphs: only what can be a heading is taken apart.
    some = F.filter(marks, lambda m: m.contains("#") | (m.contains("\n") & m.rlike(r"[=\-][ \t\r]*+\z")))
    found = F.filter(F.transform(some, _heading), lambda h: h["level"].isNotNull())

    def named(all_: Column) -> Column:
        ids = _numbered(F.transform(all_, lambda h: slug(visible(h["title"]))))
        return F.zip_with(ids, all_, lambda i, h: F.struct(
            i.alias("id"), h["title"].alias("title"), h["level"].alias("level")))

    return bind(found, named)


def shifted(text: Column, levels: int) -> Column:
    """The text with its own ATX headings, outside quotes and lists, ``levels``
    deeper, six at most."""

    def deeper(mark: Column, _: Column) -> Column:
        run = F.regexp_extract(mark, r"^ {0,3}(#{1,6}+)\z", 1)
        more = F.repeat(F.lit("#"), F.least(F.lit(levels), 6 - F.length(run)))
        return F.when(run != "", F.concat(mark, more)).otherwise(mark)

    return joined(cut(text, _OUTLINE), lambda c, i: F.concat(
        c["gap"], F.coalesce(deeper(c["mark"], i), F.lit(""))))


# ── Links ────────────────────────────────────────────────────────────

_TARGET = r"\(((?:[^\s()]++|\([^\s()]*+\))*+)\)\z"


def link_cuts(text: Column) -> Column:
    """The text as an array of tokens: links, and what stands between them."""
    return F.regexp_extract_all(text, F.lit(_LINKS), F.lit(0))


def is_link(token: Column) -> Column:
    """A bracket or an exclamation mark that begins no link is a token by itself."""
    return (token.startswith("[") | token.startswith("![")) & (F.length(token) > 1)


def target(mark: Column) -> Column:
    """Where a link mark points; null for another mark."""
    return F.when(is_link(mark), F.regexp_extract(mark, r"(?s)\A.*\]" + _TARGET, 1))


def with_target(mark: Column, new: Column) -> Column:
    """A link mark with another target; without one, its text in brackets."""
    head = F.regexp_replace(mark, _TARGET, "")
    return F.concat(head, F.coalesce(F.concat(F.lit("("), new, F.lit(")")), F.lit("")))


def links(text: Column) -> Column:
    """Array of ``(at, dest, kind)``: the number of the token, its target, and
    whether it is a link or an image."""
    return links_of(link_cuts(text))


def links_of(tokens: Column) -> Column:
    """:func:`links` from the tokens."""
    each = F.transform(tokens, lambda t, i: F.struct(
        i.alias("at"), target(t).alias("dest"),
        F.when(t.startswith("!"), "image").otherwise("link").alias("kind")))
    return F.filter(each, lambda x: x["dest"].isNotNull())
