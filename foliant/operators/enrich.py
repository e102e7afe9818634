"""Bold and italic of pages put into html: the one operator that needs a parsed tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = {"br", "img", "hr", "input", "meta", "link", "col", "wbr"}
_SAME = {"strong": ("strong", "b"), "em": ("em", "i")}


class _Node:
    def __init__(self, name: str, start: str):
        self.name, self.start, self.children, self.closed = name, start, [], ""

    def html(self) -> str:
        return self.start + "".join(c if isinstance(c, str) else c.html() for c in self.children) + self.closed


class _Tree(HTMLParser):
    """A tree whose html is the source again."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=False)
        self.root = _Node("", "")
        self.open = [self.root]
        self.feed(source)
        self.close()

    def _text(self, x: str) -> None:
        here = self.open[-1].children
        if here and isinstance(here[-1], str):
            here[-1] += x
        else:
            here.append(x)

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, self.get_starttag_text())
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(_Node(tag, self.get_starttag_text()))

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].name == tag:
                self.open[depth].closed = f"</{tag}>"
                del self.open[depth:]
                return

    def handle_data(self, data):
        self._text(data)

    def handle_entityref(self, name):
        self._text(f"&{name};")

    def handle_charref(self, name):
        self._text(f"&#{name};")

    def handle_comment(self, data):
        self.open[-1].children.append(_Node("!", f"<!--{data}-->"))

    def handle_decl(self, decl):
        self.open[-1].children.append(_Node("!", f"<!{decl}>"))


def fuzzy_regex(wanted: str) -> re.Pattern:
    """Finds a text with any blanks for its spaces and either apostrophe, whatever the case."""
    parts = [r"\s*" if c == " " else r"['’]\s*" if c in "'’" else re.escape(c) for c in wanted]
    return re.compile("".join(parts), re.IGNORECASE)


def _wrap(node: _Node, pattern: re.Pattern, tag: str) -> bool:
    changed = False
    for i, child in enumerate(list(node.children)):
        if isinstance(child, str):
            found = pattern.search(child)
            if found:
                made = _Node(tag, f"<{tag}>")
                made.children, made.closed = [found[0]], f"</{tag}>"
                at = node.children.index(child)
                before, after = child[: found.start()], child[found.end() :]
                node.children[at : at + 1] = [x for x in (before, made, after) if x]
                return True
        elif child.name not in _SAME[tag] and child.name != "!" and _wrap(child, pattern, tag):
            changed = True
    return changed


def wrap_text(html: str, wanted: str, tag: str) -> tuple[str, bool]:
    """The html with the first match of ``wanted`` (3 characters or more) in each element outside <strong> or <em> wrapped, and if there was one."""
    if len(wanted.strip()) < 3:
        return html, False
    tree = _Tree(html)
    changed = _wrap(tree.root, fuzzy_regex(wanted), tag)
    return (tree.root.html(), True) if changed else (html, False)


def enrich(blocks: DataFrame, html: str = "inner_html") -> DataFrame:
    """``blocks`` with bold_spans and italic_spans put into their html, and n_bold, n_italic: how many were.

    Null html or spans change nothing.
    """
    columns = [c for c in blocks.columns if c not in (html, "bold_spans", "italic_spans")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.select(*columns).schema) + f", `{html}` string, n_bold long, n_italic long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for body, bold, italic in zip(batch[html], batch["bold_spans"], batch["italic_spans"]):
                counts = []
                for spans, tag in ((bold, "strong"), (italic, "em")):
                    n = 0
                    for wanted in spans if spans is not None and body is not None else ():
                        body, did = wrap_text(body, wanted, tag)
                        n += did
                    counts.append(n)
                made.append((body, *counts))
            out = batch[columns].reset_index(drop=True)
            out[[html, "n_bold", "n_italic"]] = pd.DataFrame(made, columns=[html, "n_bold", "n_italic"])
            yield out

    return blocks.mapInPandas(run, schema)


def enrich_counts(enriched: DataFrame) -> DataFrame:
    """n_enriched, n_skipped blocks, n_bold, n_italic insertions."""
    changed = F.col("n_bold") + F.col("n_italic") > 0
    return enriched.agg(F.count_if(changed).alias("n_enriched"), F.count_if(~changed).alias("n_skipped"), F.coalesce(F.sum("n_bold"), F.lit(0)).alias("n_bold"), F.coalesce(F.sum("n_italic"), F.lit(0)).alias("n_italic"))
