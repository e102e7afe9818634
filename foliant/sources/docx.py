"""DOCX files as html and as plain text.

A small reader per file takes the package apart with the standard library and
gives rows: paragraphs with their runs, and the style, numbering, note and link
parts that they refer to by ids. Joins by file and id resolve these; which
lists, items and cells a paragraph opens and closes comes from comparing what it is in
with what the paragraph before it is in.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.runtime import materialize

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Run properties and the elements that stand for them, outermost first.
STYLES = (("b", "strong"), ("i", "em"), ("u", "u"))
#: Levels that a list can have.
LEVELS = 9
_RUN = "struct<text:string,styles:array<string>,link:string,anchor:string,note:string>"
_HOLDER = "struct<tag:string,id:string>"
PARTS = f"path string, error string, kind string, pos int, style string, num string, level int, holders array<{_HOLDER}>, runs array<{_RUN}>, name string, value string"
_COLUMNS = [c.split()[0] for c in PARTS.replace(_RUN, "run").replace(_HOLDER, "holder").split(", ")]


def _value(element: ElementTree.Element | None, path: str) -> str | None:
    found = element.find("/".join(f"{_W}{name}" for name in path.split("/"))) if element is not None else None
    return found.get(f"{_W}val") if found is not None else None


def _styles(about: ElementTree.Element | None) -> list[str]:
    marks = [(about.find(f"{_W}{name}") if about is not None else None, element) for name, element in STYLES]
    out = [element for mark, element in marks if mark is not None and mark.get(f"{_W}val", "true") not in ("0", "false", "none")]
    place = _value(about, "vertAlign")
    return [*out, place[:3]] if place in ("superscript", "subscript") else out


def _runs(paragraph: ElementTree.Element) -> list[dict]:
    """The runs of a paragraph; neighbours alike in all but their text are one."""
    out: list[dict] = []

    def add(element: ElementTree.Element, link: str | None, anchor: str | None) -> None:
        for x in element:
            if x.tag == f"{_W}hyperlink":
                add(x, x.get(f"{_R}id") or link, x.get(f"{_W}anchor") or anchor)
            elif x.tag == f"{_W}r":
                styles = _styles(x.find(f"{_W}rPr"))
                for y in x:
                    note = y.get(f"{_W}id") if y.tag == f"{_W}footnoteReference" else None
                    text = "\n" if y.tag == f"{_W}br" else "\t" if y.tag == f"{_W}tab" else (y.text or "") if y.tag == f"{_W}t" else ""
                    about = {"styles": styles, "link": link, "anchor": anchor, "note": note}
                    if out and not note and all(out[-1][k] == v for k, v in about.items()):
                        out[-1]["text"] += text
                    elif text or note:
                        out.append({"text": text} | about)
            elif x.tag in (f"{_W}ins", f"{_W}smartTag", f"{_W}sdt", f"{_W}sdtContent"):
                add(x, link, anchor)

    add(paragraph, None, None)
    return out


def _paragraphs(body: ElementTree.Element, kind: str, name: str | None = None) -> Iterator[dict]:
    """The paragraphs of a part, with the tables, rows and cells that hold each."""
    made = {"tbl": 0, "tr": 0, "tc": 0}

    def walk(element: ElementTree.Element, holders: list[dict]) -> Iterator[dict]:
        for x in element:
            tag = x.tag.removeprefix(_W)
            if tag == "p":
                about = x.find(f"{_W}pPr")
                level = _value(about, "numPr/ilvl")
                yield {"kind": kind, "name": name, "style": _value(about, "pStyle"), "num": _value(about, "numPr/numId"), "level": int(level) if level else None, "holders": holders, "runs": _runs(x)}
            elif tag in made:
                made[tag] += 1
                yield from walk(x, [*holders, {"tag": {"tbl": "table", "tr": "tr", "tc": "td"}[tag], "id": f"{tag}{made[tag]}"}])
            elif tag in ("sdt", "sdtContent", "body"):
                yield from walk(x, holders)

    yield from walk(body, [])


def read_parts(content: bytes) -> Iterator[dict]:
    """Rows of a package: paragraphs and notes, styles, levels of numberings, links."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        there = set(archive.namelist())
        part = lambda name: ElementTree.fromstring(archive.read(name))
        for pos, row in enumerate(_paragraphs(part("word/document.xml"), "paragraph")):
            yield row | {"pos": pos}
        if "word/styles.xml" in there:
            for x in part("word/styles.xml").iter(f"{_W}style"):
                level = _value(x, "pPr/numPr/ilvl")
                yield {"kind": "style", "name": x.get(f"{_W}styleId"), "value": _value(x, "name"), "num": _value(x, "pPr/numPr/numId"), "level": int(level) if level else None}
        if "word/numbering.xml" in there:
            root = part("word/numbering.xml")
            kinds = {a.get(f"{_W}abstractNumId"): [(int(x.get(f"{_W}ilvl")), _value(x, "numFmt")) for x in a.iter(f"{_W}lvl")] for a in root.iter(f"{_W}abstractNum")}
            for x in root.iter(f"{_W}num"):
                for level, form in kinds.get(_value(x, "abstractNumId"), []):
                    yield {"kind": "level", "name": x.get(f"{_W}numId"), "level": level, "value": "ul" if form == "bullet" else "ol"}
        if "word/footnotes.xml" in there:
            for x in part("word/footnotes.xml").iter(f"{_W}footnote"):
                if x.get(f"{_W}type") not in ("separator", "continuationSeparator"):
                    for pos, row in enumerate(_paragraphs(x, "note", x.get(f"{_W}id"))):
                        yield row | {"pos": pos}
        if "word/_rels/document.xml.rels" in there:
            for x in part("word/_rels/document.xml.rels"):
                yield {"kind": "link", "name": x.get("Id"), "value": x.get("Target")}


def parts(files: DataFrame) -> DataFrame:
    """The rows of all files (path, content), and one of kind ``file`` for each, with the error of one that can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows, error = list(read_parts(content)), None
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError) as e:
                    rows, error = [], f"{type(e).__name__}: {e}"
                made = pd.DataFrame([{"kind": "file", "error": error}, *rows]).reindex(columns=_COLUMNS).astype(object)
                made["path"] = path
                yield made.where(made.notna(), None)

    return files.select("path", "content").mapInPandas(run, PARTS)


def _escaped(x: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br />")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _shown(runs: DataFrame) -> DataFrame:
    """path, kind, name, pos, html, plain of paragraphs, from their runs (place, r, target, number)."""
    opens = F.array_join(F.transform("r.styles", lambda s: F.concat(F.lit("<"), s, F.lit(">"))), "")
    closes = F.array_join(F.transform(F.reverse("r.styles"), lambda s: F.concat(F.lit("</"), s, F.lit(">"))), "")
    text = F.concat(opens, _escaped(F.col("r.text")), closes)
    href = F.coalesce(F.col("target"), F.concat(F.lit("#"), F.col("r.anchor")))
    linked = F.when(href.isNotNull(), F.concat(F.lit('<a href="'), F.replace(_escaped(href), F.lit('"'), F.lit("&quot;")), F.lit('">'), text, F.lit("</a>"))).otherwise(text)
    note = F.concat(F.lit('<sup><a href="#footnote-'), "r.note", F.lit('" id="footnote-ref-'), "r.note", F.lit('">['), F.col("number").cast("string"), F.lit("]</a></sup>"))
    html = F.when(F.col("r.note").isNotNull(), F.coalesce(note, F.lit(""))).otherwise(linked)
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.col(c).alias("x")))), lambda p: p["x"]), "")
    return runs.withColumns({"_html": html, "_plain": F.col("r.text")}).groupBy("path", "kind", "name", "pos").agg(joined("_html").alias("html"), joined("_plain").alias("plain"))


def _placed(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs (path, pos, holders, num, level, forms, tag, html) with the tags that open and close around each, as ``made``."""
    w = Window.partitionBy("path").orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    in_list = F.col("forms").isNotNull()
    rows = paragraphs.withColumns({f"_n{k}": F.sum((in_list & (F.col("level") <= k)).cast("int")).over(so_far) for k in range(LEVELS)} | {"_run": F.sum((~in_list).cast("int")).over(so_far)})
    counts = F.array(F.lit(0), *[F.col(f"_n{k}") for k in range(LEVELS)])

    def level(k: Column) -> Column:
        form = F.coalesce(F.try_element_at("forms", k), F.lit("ol"))
        above, own = F.get(counts, k).cast("string"), F.get(counts, k + 1).cast("string")
        return F.array(F.struct(form.alias("tag"), F.concat(F.lit("list"), F.col("_run").cast("string"), F.lit("."), above).alias("id")), F.struct(F.lit("li").alias("tag"), own.alias("id")))

    lists = F.when(in_list, F.flatten(F.transform(F.sequence(F.lit(0), F.col("level")), level))).otherwise(F.array().cast(f"array<{_HOLDER}>"))
    rows = rows.withColumn("_in", F.concat("holders", lists)).withColumn("_before", F.coalesce(F.lag("_in").over(w), F.array().cast(f"array<{_HOLDER}>"))).withColumn("_last", F.lead("pos").over(w).isNull())
    differ = F.array_position(F.zip_with("_before", "_in", lambda a, b: F.coalesce(a == b, F.lit(False))), F.lit(False)).cast("int")
    same = F.when(differ > 0, differ - 1).otherwise(F.size("_in"))
    tags = lambda of, mark: F.array_join(F.transform(of, lambda h: F.concat(F.lit(mark), h["tag"], F.lit(">"))), "")
    rest = lambda c: F.slice(c, same + 1, F.size(c))
    content = F.when(in_list, F.col("html")).when(F.col("html") == "", "").otherwise(F.concat(F.lit("<"), "tag", F.lit(">"), "html", F.lit("</"), "tag", F.lit(">")))
    end = F.when(F.col("_last"), tags(F.reverse("_in"), "</")).otherwise("")
    return rows.withColumn("made", F.concat(tags(F.reverse(rest("_before")), "</"), tags(rest("_in"), "<"), content, end))


def convert(files: DataFrame) -> DataFrame:
    """path, html, text, error of DOCX files (path, content); of a file that isn't one only the error.

    Headings by the names of their styles, lists by their numbering (of the
    paragraph or its style), tables within tables, links, bold, italic,
    underlined, raised and lowered runs, notes as a list at the end. Empty paragraphs are
    left out of the html. The text is the paragraphs, parted by blank lines.
    """
    rows = materialize(parts(files), "docx-parts")
    kind = lambda name: rows.where(F.col("kind") == name)
    styles = kind("style").select("path", F.col("name").alias("style"), F.lower("value").alias("style_name"), F.col("num").alias("style_num"), F.col("level").alias("style_level"))
    forms = kind("level").groupBy("path", F.col("name").alias("num")).agg(F.map_from_entries(F.collect_list(F.struct("level", "value"))).alias("forms"))
    links = kind("link").select("path", F.col("name").alias("link"), F.col("value").alias("target"))

    told = rows.where(F.col("kind").isin("paragraph", "note"))
    runs = told.select("path", "kind", "name", "pos", F.posexplode("runs").alias("place", "r")).withColumn("link", F.col("r.link")).join(links, ["path", "link"], "left")
    order = Window.partitionBy("path").orderBy("pos", "place")
    cited = runs.where((F.col("kind") == "paragraph") & F.col("r.note").isNotNull()).select("path", "pos", "place", F.col("r.note").alias("note"), F.row_number().over(order).alias("number"))
    shown = _shown(runs.join(cited.select("path", "pos", "place", F.lit("paragraph").alias("kind"), "number"), ["path", "pos", "place", "kind"], "left"))

    base = kind("paragraph").select("path", "pos", "style", "num", "level", "holders").join(styles, ["path", "style"], "left")
    base = base.withColumns({"num": F.coalesce("num", "style_num"), "level": F.least(F.coalesce("level", "style_level", F.lit(0)), F.lit(LEVELS - 1))}).join(forms, ["path", "num"], "left")
    heading = F.regexp_extract(F.coalesce("style_name", F.lit("")), "^heading ([1-6])$", 1)
    base = base.withColumn("tag", F.when(heading != "", F.concat(F.lit("h"), heading)).otherwise("p"))
    body = base.join(shown.where("kind = 'paragraph'").select("path", "pos", "html", "plain"), ["path", "pos"], "left").fillna("", ["html", "plain"])
    joined = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col(c).alias("x")))), lambda p: p["x"])
    bodies = _placed(body).groupBy("path").agg(F.array_join(joined("made"), "").alias("body"), F.array_join(joined("plain"), "\n\n").alias("text"))

    first = cited.groupBy("path", "note").agg(F.min("number").alias("number"))
    noted = shown.where("kind = 'note'").select("path", F.col("name").alias("note"), "pos", F.trim("html").alias("html")).join(first, ["path", "note"])
    back = F.concat(F.lit(' <a href="#footnote-ref-'), "note", F.lit('">↑</a></p></li>'))
    item = F.concat(F.lit('<li id="footnote-'), "note", F.lit('"><p>'), F.array_join(joined("html"), "</p><p>"), back)
    items = noted.groupBy("path", "note", "number").agg(item.alias("li"))
    lists = items.groupBy("path").agg(F.concat(F.lit("<ol>"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", "li"))), lambda x: x["li"]), ""), F.lit("</ol>")).alias("notes"))

    out = kind("file").select("path", "error").join(bodies, "path", "left").join(lists, "path", "left")
    fine = F.col("error").isNull()
    html = F.concat(F.coalesce("body", F.lit("")), F.coalesce("notes", F.lit("")))
    return out.select("path", F.when(fine, html).alias("html"), F.when(fine, F.coalesce("text", F.lit(""))).alias("text"), "error")
