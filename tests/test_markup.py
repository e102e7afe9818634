"""Leaf blocks of generated pages against a walk of the standard library's parser."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from foliant.operators import roles
from foliant.operators.markup import leaves

BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol", "li", "div", "section", "td", "tr"}


class Walk(HTMLParser):
    """Leaves as (tag, text, boxed, noted, next tag), by a stack of all elements with an object for each."""

    def __init__(self, html):
        super().__init__(convert_charrefs=False)
        self.stack, self.found, self.open, self.ended = [], [], None, None
        self.feed(html)
        self.close()
        self.end()
        for leaf in self.found:
            leaf["noted"] = any(x["note"] or x.get("holds") for x in leaf["around"])

    def end(self, following=None):
        if self.open:
            self.open["next"] = following
            self.open = None

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if self.ended:
            self.ended["next"], self.ended = tag, None
        if tag in BLOCKS:
            self.end(tag)
        if tag == "li":
            self.close_item()
        if tag in ("p", "h2"):
            self.open = {"tag": tag, "text": "", "around": list(self.stack), "boxed": any(x["tag"] in ("table", "ul", "ol", "li") for x in self.stack), "next": None}
            self.found.append(self.open)
        elif tag in BLOCKS - {"td", "tr"}:
            note = (tag == "li" and (attrs.get("id") or "").startswith("footnote")) or "footnotes" in (attrs.get("class") or "").split()
            if tag == "li" and note:
                for x in self.stack:
                    x["holds"] = x.get("holds") or x["tag"] == "ol"
            self.stack.append({"tag": tag, "note": note})

    def close_item(self):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i]["tag"] in ("ul", "ol", "table"):
                return
            if self.stack[i]["tag"] == "li":
                del self.stack[i:]
                return

    def handle_endtag(self, tag):
        self.ended = None
        if tag in BLOCKS:
            if self.open and self.open["tag"] == tag:
                self.ended, self.open = self.open, None
            self.end()
        if tag == "li":
            self.close_item()
        elif tag in ("ul", "ol", "table", "div", "section"):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i]["tag"] == tag:
                    del self.stack[i:]
                    return
                if self.stack[i]["tag"] == "table":
                    return

    def handle_data(self, data):
        if self.open and not self.cdata_elem:  # a script's text is none of the page's
            self.open["text"] += data

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")


def page(rng, depth=0):
    parts = []
    for _ in range(rng.randint(0, 4)):
        word = rng.choice(["un", "deux <b>trois</b>", "a &amp; b", "", "<!-- <p>no</p> -->x", "long <i title='a > b'>c</i>"])
        inner = page(rng, depth + 1) if depth < 5 else ""
        parts.append(rng.choice([
            f"<p>{word}</p>", f"<p class='x'>{word}", f"<h2>{word}</h2>{rng.choice(['', ' ', '<a>l</a>'])}", f"<ul><li>{inner}</li><li>{word}</ul>", f"<ol><li><p>{word}</p>{inner}</ol>",
            f'<ol><li id="footnote-1"><p>{word}</p></li></ol>', f'<div class="a footnotes">{inner}</div><p>{word}</p>', f"<table><tr><td>{inner}<p>{word}</p></td></tr></table>", f"<div>{inner}",
            f"</ul><p>{word}</p>", f"<section>{inner}</section>", "<script>var t = '</p><ul>';</script>", word,
        ]))
    return "".join(parts)


def test_leaves_equal_a_parser_walk(spark):
    rng = random.Random(5)
    pages = [(i, page(rng)) for i in range(400)]
    df = spark.createDataFrame(pages, "id int, html string").select("id", leaves(F.col("html")).alias("l"))
    got = {r["id"]: [(x["tag"], x["plain"], x["in_table_or_list"], x["in_footnotes"], x["next_tag"]) for x in r["l"]] for r in df.collect()}
    for i, html in pages:
        assert got[i] == [(x["tag"], x["text"], x["boxed"], x["noted"], x["next"]) for x in Walk(html).found], html


def test_blocks_after_a_nested_list_stay_in_the_outer_one(spark):
    html = "<ul><li><p>a</p><ul><li><p>b</p></li></ul><p>c</p></li></ul><p>d</p><h2>e</h2><table><tr><td><table></table><p>f</p></td></tr></table>"
    rows = roles.html_blocks(spark.createDataFrame([("x", html), ("y", None), ("z", "")], "doc string, html string")).orderBy("pos").collect()
    assert [(r["text"], r["in_table_or_list"], r["next_tag"]) for r in rows] == [("a", True, "ul"), ("b", True, None), ("c", True, None), ("d", False, "h2"), ("e", False, "table"), ("f", True, None)]


def test_deep_and_long_bodies(spark):
    deep = "<ul><li>" * 300 + "<p>x</p>" + "</li></ul>" * 300 + "<p>y</p>"
    long = "<p>z</p>" * 20000
    rows = roles.html_blocks(spark.createDataFrame([("deep", deep), ("long", long)], "doc string, html string")).groupBy("doc").agg(F.count("*").alias("n"), F.count_if("in_table_or_list").alias("boxed")).collect()
    assert {r["doc"]: (r["n"], r["boxed"]) for r in rows} == {"deep": (2, 1), "long": (20000, 0)}


def test_a_long_body_is_walked_in_seconds():
    import time

    from foliant.operators.markup import leaves_of

    start = time.time()
    found = list(leaves_of('<ul><li><p>a<b>b</b></p></li></ul><ol><li ID="footnote-1"><p>c</ol><H2>d</h2>\n<ul>' * 20_000))
    assert len(found) == 60_000 and time.time() - start < 20
    assert found[:3] == [("p", "a<b>b</b>", "ab", True, False, None), ("p", "c", "c", True, True, None), ("h2", "d", "d", False, False, "ul")]
