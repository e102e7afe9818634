"""Leaf blocks of html, however deep their containers are nested.

A body is cut to tokens: tags, text between them, and scripts, styles and
comments as one token each. The tags that matter are walked, in order, along
a stack of the containers that are open. Nothing is shuffled, and a body takes
time linear in its length (times its depth). The walk is a function of one body
on Arrow batches: a fold of expressions is interpreted and slower.

A paragraph or heading ends at its end tag, or where a block starts or a
container ends before that. An item ends at the next item of its list. An end
tag without its start tag within the same table is ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
LEAVES = ("p", *HEADINGS)
LISTS = ("ul", "ol")
#: Containers whose leaves are simple, and others that a class can make footnotes of.
BOXES, SECTIONS = ("table", *LISTS, "li"), ("div", "section", "aside", "footer", "article")
#: Tags that end a leaf, besides those above.
_ENDS = (
    "address", "blockquote", "body", "center", "dd", "details", "dialog", "dl", "dt", "fieldset", "figcaption", "figure", "form", "header", "hr", "html",
    "main", "menu", "nav", "pre", "summary", "tbody", "td", "tfoot", "th", "thead", "tr",
)
_RELEVANT = frozenset(f"{slash}{name}" for name in (*LEAVES, *BOXES, *SECTIONS, *_ENDS) for slash in ("", "/"))
# letters of any case, white space and words are those of ASCII
_TOKEN = re.compile(r"""<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|</?[a-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^<]++|<""", re.I | re.S | re.A)
_NOTE_ITEM = re.compile(r"""<li\s(?:[^>]*\s)?id\s*=\s*["']?footnote""", re.I | re.S | re.A)
_NOTE_CLASS = re.compile(r"""\sclass\s*=\s*(?:"(?:[^"]*\s)?footnotes(?:\s[^"]*)?"|'(?:[^']*\s)?footnotes(?:\s[^']*)?'|footnotes[\s>])""", re.I | re.S | re.A)
_NAME = re.compile("<(/?[A-Za-z][A-Za-z0-9]*)")
_LEAF = pa.struct([
    ("tag", pa.string()), ("inner_html", pa.string()), ("plain", pa.string()), ("in_table_or_list", pa.bool_()), ("in_footnotes", pa.bool_()), ("next_tag", pa.string()),
])
_KIND = ArrayType(StructType([StructField(f.name, BooleanType() if f.type == pa.bool_() else StringType()) for f in _LEAF]))


def _last(stack: list[tuple], names: tuple[str, ...]) -> int:
    """The place, from 1, of the last open container with one of these names; 0 if there is none."""
    return next((at for at in range(len(stack), 0, -1) if stack[at - 1][0] in names), 0)


def _step(stack: list[tuple], base: str, closing: bool, i: int, note: bool) -> None:
    """Changes the stack of open containers (name, place, note) by a tag of one."""
    own, table, around = _last(stack, (base,)), _last(stack, ("table",)), _last(stack, LISTS) if base == "li" else 0
    # an end tag, or the next item of a list, closes what is open within the innermost table (and list, for an item)
    if (closing or base == "li") and own > around and (own > table or base == "table"):
        del stack[own - 1 :]
    if not closing:
        stack.append((base, i, note))


def _bounds(tokens: list[str]) -> list[tuple]:
    """(i, name, boxed, noted, item, lists) of the tags that start or end leaves, in order, with what encloses them."""
    stack: list[tuple] = []
    out = []
    for i, t in enumerate(tokens):
        name = _name(t)
        if name not in _RELEVANT:
            continue
        base, closing, item = name.lstrip("/"), name[0] == "/", bool(_NOTE_ITEM.match(t))
        if base in BOXES or base in SECTIONS:
            _step(stack, base, closing, i, not closing and (item or bool(_NOTE_CLASS.search(t))))
        if name in LEAVES or item:
            out.append((i, name, any(s[0] in BOXES for s in stack), any(s[2] for s in stack), item, [s[1] for s in stack if s[0] == "ol"]))
        else:
            out.append((i, name, False, False, False, []))
    return out


def _name(token: str) -> str:
    found = _NAME.match(token)
    return found[1].lower() if found else ""


def leaves_of(html: str) -> Iterator[tuple]:
    """What ``leaves`` tells of one body."""
    tokens = _TOKEN.findall(html)
    bounds = _bounds(tokens)
    notes = {at for b in bounds if b[4] for at in b[5]}
    for (i, name, boxed, noted, _, lists), (end, bound, *_) in zip(bounds, [*bounds[1:], (len(tokens), "")]):
        if name not in LEAVES:
            continue
        inner = tokens[i + 1 : end]
        follows = bound
        if bound == "/" + name:
            # the token after the end tag is an element, or text before one
            follows = next(filter(None, map(_name, tokens[end + 1 : end + 17])), "")
        plain = "".join(t for t in inner if t[0] != "<" or len(t) == 1)
        yield name, "".join(inner), plain, boxed, noted or not notes.isdisjoint(lists), None if not follows or follows[0] == "/" else follows


@F.arrow_udf(_KIND)
def _leaves(html: pa.Array) -> pa.Array:
    rows, ends = [], [0]
    for body in html.to_pylist():
        rows.extend(leaves_of(body or ""))
        ends.append(len(rows))
    columns = zip(*rows) if rows else [()] * len(_LEAF)
    fields = [pa.array(c, f.type) for c, f in zip(columns, _LEAF)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_LEAF)))


def leaves(html: Column) -> Column:
    """An array of (tag, inner_html, plain, in_table_or_list, in_footnotes, next_tag) of a body's paragraphs and headings, in order.

    ``plain`` is the text between tags, without scripts and styles, entities as they stand. ``next_tag`` is the element that follows
    beside the leaf, if any. A list that holds a note is all notes. Null and empty bodies have none.
    """
    return _leaves(html)
