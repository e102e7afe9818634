"""Blocks of html bodies and their roles.

``markup.leaves`` finds the blocks within lists and tables of any depth. All
tests of blocks are column expressions; states along a document are windows over it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import fixed
from foliant.functions.text import EDGES, PY_SPACE, SPACE, trim, typography
from foliant.operators.markup import HEADINGS, leaves
from foliant.operators.scan import running

ARROW = r"^(?:" + SPACE + r")*(?:[→🡪🡺\x{2190}-\x{21FF}\x{2B00}-\x{2BFF}\x{1F800}-\x{1F8FF}]|&rarr;|&#8594;)"
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&rarr;", "→"), ("&#8594;", "→"), ("&amp;", "&"))
_NOT_WORD = "(?:[^A-Za-z0-9_]|$)"
#: Beginnings that go on with a reference, besides a lower-case letter, fixed words and an <em>: years, centuries, numerals, lines.
YEAR = "^[0-9]{4}"
CENTURY = rf"(?i)^[i|vxlcdm]+(?:e|ème|°|er)?{SPACE}+(?:siècle|s{_NOT_WORD})"
ROMAN = rf"(?i)^[ivxlcdm]+{_NOT_WORD}"
LINE = rf"^l(?:\.(?:{SPACE}|[0-9]|$)|{SPACE}+[0-9]|{SPACE}+[ivxlcdm])"


def decoded(text: Column) -> Column:
    """A text with its entities as characters, without outer blanks."""
    plain = text
    for name, char in _ENTITIES:
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return trim(F.when(text.contains("&"), plain).otherwise(text))  # most texts have none to look for


def text_content(html: Column) -> Column:
    """The text of an element, without outer blanks."""
    return decoded(F.regexp_replace(html, "<[^>]*>", ""))


def html_blocks(bodies: DataFrame, key: str = "doc", html: str = "html") -> DataFrame:
    """key, pos, tag, inner_html, text, in_table_or_list, in_footnotes, next_tag: a row for each p and h1 to h6, in document order.

    Null and empty bodies have none.
    """
    rows = bodies.select(key, F.posexplode(leaves(F.col(html))).alias("pos", "b"))
    return rows.select(key, F.col("pos").cast("long").alias("pos"), "b.tag", "b.inner_html", decoded(F.col("b.plain")).alias("text"), "b.in_table_or_list", "b.in_footnotes", "b.next_tag")


def strong_only(inner: Column) -> Column:
    """If all of a paragraph is one <strong> or <b>."""
    whole = lambda t: inner.rlike(rf"(?is)^\s*<{t}(?:\s[^>]*)?>.*</{t}\s*>\s*$") & (F.regexp_count(inner, F.lit(rf"(?i)<{t}(?:\s[^>]*)?>")) == 1)
    return whole("strong") | whole("b")


def without_edges(x: Column) -> Column:
    return trim(F.regexp_replace(x, rf"^{EDGES}+|{EDGES}+\z", ""))


def _starts(x: Column, words: tuple[str, ...]) -> Column:
    # as one test, so that what x comes from isn't computed for each word
    return x.rlike("^(?:" + "|".join(map(re.escape, words)) + ")")


def all_capitals(x: Column) -> Column:
    return (x == F.upper(x)) & x.rlike("[A-ZÀ-Ÿ]")


def title_like(text: Column) -> Column:
    """If a line looks like a title: short, begun by a letter or digit, without a stop at its end, no source."""
    x = trim(F.regexp_replace(text, rf"(?i){SPACE}*[\[(][0-9]+[a-f]?[\])]{SPACE}*\z", ""))
    x = without_edges(x)
    return x.rlike("^[a-zA-Z0-9À-ÿŒœ]") & (F.length(x) <= 100) & ~x.rlike("[.!?;:]$") & ~_starts(F.lower(x), fixed.TITLE_EXCLUDES)


def direction(text: Column) -> Column:
    return (text.startswith("[") & text.endswith("]")) | (text.startswith("(") & text.endswith(")"))


def speaker(text: Column, strong: Column) -> Column:
    """If a line is a speaker's name: capitals only, under 35 characters."""
    x = without_edges(text)
    return ~direction(text) & F.length(x).between(1, 34) & ~strong & all_capitals(x) & x.rlike(rf"^(?:[\p{{L}}’'-]|{SPACE})+$")


def continues_reference(text: Column, inner: Column, audit: bool = False) -> Column:
    """If a line's beginning shows that it goes on with a reference; ``audit``: as the audit has it, where letters with accents end no numeral."""
    x = F.regexp_replace(text, rf"^(?:{EDGES}|[+~≈-])+", "")
    first, low = F.substring(x, 1, 1), F.lower(x)
    lower = (first == F.lower(first)) & (first != F.upper(first))
    roman = r"(?i)^[ivxlcdm]+(?:[^\p{L}\p{N}_]|$)" if audit else ROMAN
    century = rf"(?i)^[ivxlcdm]+(?:e|ème|°|er)?{PY_SPACE}+(?:siècle|s(?:[^\p{{L}}\p{{N}}_]|$))" if audit else CENTURY
    italic = trim(inner).rlike("^<(?:em|i)[ >]") if audit else trim(inner).startswith("<em>")
    return lower | _starts(low, fixed.REFERENCE_WORDS + fixed.PUBLISHERS) | x.rlike(YEAR) | x.rlike(century) | x.rlike(roman) | low.rlike(LINE) | italic


def reference_runs(rows: DataFrame, key: str, pos: str, arrow: Column, goes_on: Column, name: str = "is_reference", bits: int | None = None) -> DataFrame:
    """Adds ``name``: if a row is in a run that an arrow starts and rows that go on with it carry on; ``bits`` as in ``scan.running``."""
    starts = F.when(F.coalesce(arrow | ~goes_on, F.lit(True)), F.coalesce(arrow, F.lit(False)))
    return running(rows, key, pos, {name: ("last", starts)}, bits).withColumn(name, F.coalesce(name, F.lit(False)))


def _live(blocks: DataFrame, key: str) -> DataFrame:
    last = F.max("pos").over(Window.partitionBy(key))
    return blocks.withColumn("_last", F.col("pos") == last).where(~F.col("in_footnotes"))


def roles(blocks: DataFrame, key: str = "doc") -> DataFrame:
    """key, pos, text, role, centered of blocks as the reader shows them; notes and empty blocks give no row.

    Before the body starts (a «, more than 150 characters, a speaker or a
    direction) every block is a title. Blocks in lists and tables are simple.
    """
    strong, text = strong_only(F.col("inner_html")), F.col("text")
    rows = _live(blocks, key)
    simple = rows.where("in_table_or_list").select(key, "pos", "text", F.lit("simple").alias("role"), F.lit(False).alias("centered"))
    rows = rows.where(~F.col("in_table_or_list") & (text != "")).withColumns({"_strong": strong, "_direction": direction(text)})
    rows = rows.withColumn("_speaker", speaker(text, F.col("_strong")))
    w = Window.partitionBy(key).orderBy("pos")
    talk = F.col("_speaker") | F.col("_direction")
    starts = text.rlike(f"^{SPACE}*«") | (F.length(text) > 150) | talk
    rows = rows.withColumn("_body", F.bool_or(starts).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    goes_on = (continues_reference(text, F.col("inner_html")) | F.coalesce(F.lag(text).over(w).endswith(","), F.lit(False))) & ~talk
    rows = reference_runs(rows.withColumn("_goes_on", goes_on), key, "pos", text.rlike(ARROW) & ~talk, F.col("_goes_on"))
    heading = F.col("tag").isin(*HEADINGS) | F.col("_strong") | (title_like(text) & ~F.col("_last") & ~F.coalesce(F.col("next_tag").isin("ol", "ul"), F.lit(False)))
    role = (
        F.when(F.col("_speaker"), "dialogue-speaker").when(F.col("_direction"), "dialogue-direction").when(F.col("is_reference"), "reference")
        .when(~F.col("_body"), "title").when(heading, "subheading").otherwise("paragraph")
    )
    bare = without_edges(text)
    centered = (F.col("role") == "subheading") & all_capitals(bare) & (F.length(bare) < 50)
    return rows.withColumn("role", role).select(key, "pos", "text", "role", centered.alias("centered")).unionByName(simple)


def html_roles(bodies: DataFrame, key: str = "doc", html: str = "html") -> DataFrame:
    """``roles`` of the blocks of bodies, typeset first as the reader does."""
    return roles(html_blocks(bodies.select(key, typography(F.col(html)).alias("html")), key), key)


def audit_roles(blocks: DataFrame, key: str = "doc") -> DataFrame:
    """key, pos, text, role, has_bold, has_italic, in_table_or_list as the audit classifies blocks.

    Unlike the reader it knows no speakers, directions or start of the body, and
    no reference goes on for a comma. The first heading of a document, one
    after a reference and one in capitals are titles.
    """
    text, inner = F.col("text"), F.col("inner_html")
    marks = {"has_bold": inner.rlike("(?i)<(?:b|strong)[ >]"), "has_italic": inner.rlike("(?i)<(?:i|em)[ >]")}
    # blocks in lists and tables go along, as rows that no run or heading sees: apart, they would be read twice and shuffled
    simple = F.col("in_table_or_list")
    rows = blocks.where(~F.col("in_footnotes") & (simple | (text != "")))
    heading = F.col("tag").isin(*HEADINGS) | strong_only(inner) | (title_like(text) & ~F.coalesce(F.col("next_tag").isin("ol", "ul"), F.lit(False)))
    # what html tells is told before blocks are shuffled, so that only their texts are
    rows = rows.withColumns({"_goes_on": simple | continues_reference(text, inner, audit=True), "_like": ~simple & heading} | marks)
    rows = rows.select(key, "pos", "text", "in_table_or_list", "_goes_on", "_like", *marks)
    rows = reference_runs(rows, key, "pos", ~simple & text.rlike(ARROW), F.col("_goes_on"))
    w = Window.partitionBy(key).orderBy("pos")
    rows = rows.withColumn("_heading", F.col("_like") & ~F.col("is_reference"))
    after = F.last(F.when(~simple, F.col("is_reference")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = F.sum(F.col("_heading").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    rows = rows.withColumn("_title", first | F.coalesce(after, F.lit(False)) | ((text == F.upper(text)) & text.rlike(r"\p{Lu}")))
    role = F.when(simple, "simple").when(F.col("is_reference"), "reference").when(F.col("_heading"), F.when(F.col("_title"), "title").otherwise("subheading")).otherwise("paragraph")
    return rows.select(key, "pos", "text", role.alias("role"), *marks, "in_table_or_list")


def footnote_anchors(bodies: DataFrame, key: str = "doc", html: str = "html") -> DataFrame:
    """key, number, anchor: links to notes and the ids by which notes link back."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*href=["']#footnote-[0-9]+["'][^>]*>"""), F.lit(0))
    rows = bodies.select(key, F.explode(found).alias("a"))
    return rows.select(key, F.regexp_extract("a", "#footnote-([0-9]+)", 1).cast("long").alias("number"), F.nullif(F.regexp_extract("a", r"""(?i)\sid=["']?([^"'\s>]+)""", 1), F.lit("")).alias("anchor"))


def footnote_notes(bodies: DataFrame, key: str = "doc", html: str = "html") -> DataFrame:
    """key, number, note: the texts of notes."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<li\s[^>]*id=["']?footnote-[0-9]+["']?[^>]*>.*?</li\s*>"""), F.lit(0))
    rows = bodies.select(key, F.explode(found).alias("n"))
    return rows.select(key, F.regexp_extract("n", "(?i)footnote-([0-9]+)", 1).cast("long").alias("number"), F.regexp_replace(text_content(F.col("n")), f"{SPACE}+", " ").alias("note"))
