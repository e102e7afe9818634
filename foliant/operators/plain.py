"""Blocks of plain texts with a few tags: titles, headings, references and footnotes parted by blank lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import SPACE, first_comma, first_comma_or_paren, fold_accents, let, strip_html, trim, typography

MARK = "[[FOOTNOTES]]"
_ENDS = "(?:[^A-Za-z0-9_]|$)"
SOURCE_WORD = r"(?i)^(?:Trad\.?|Traduction|Tome|Vol\.|Éd\.|Ed\.|p\.|Page|Chapitre|col\.)"


def parted(text: Column) -> Column:
    """The blocks of a body: arrows made one sign and put on a line of their own, adjacent quotes parted, cut at blank lines."""
    x = F.regexp_replace(F.regexp_replace(text, "\uf0e0|-->|->", "→"), f"»{SPACE}*«", "»\n\n«")
    x = F.regexp_replace(F.regexp_replace(x, "[ \t]*(→)", "\n\n$1"), "\r\n", "\n")
    return F.filter(F.transform(F.split(x, "\n{2,}"), lambda b: trim(b)), lambda b: strip_html(b) != "")


def text_blocks(texts: DataFrame, key: str = "doc", text: str = "text", author: str = "author") -> DataFrame:
    """key, pos, html, role of the blocks of texts (key, text, author) and of their footnotes, whose lines follow a mark.

    A block that starts with an arrow is a reference; the first other one is the
    title. After it, one with the author and a year (or a translator and either)
    is a reference, a short capitalised one without a stop a subheading.
    """
    whole = F.split(F.coalesce(text, F.lit("")), r"\[\[FOOTNOTES\]\]", -1)
    parts = texts.select(key, F.coalesce(author, F.lit("")).alias("_author"), whole[0].alias("_body"), F.coalesce(F.try_element_at(whole, F.lit(2)), F.lit("")).alias("_notes"))
    rows = parts.select(key, "_author", F.posexplode(parted(F.col("_body"))).alias("pos", "html")).withColumn("_plain", strip_html(F.col("html")))
    plain, name = F.col("_plain"), fold_accents(F.lower("_author"))
    arrow = plain.startswith("→")
    w = Window.partitionBy(key).orderBy("pos")
    titled = F.coalesce(F.sum((~arrow).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0
    by = (name != "") & fold_accents(F.lower(plain)).contains(name)
    year = plain.rlike(r"\([0-9]{4}\)") | plain.rlike(rf"(?i)\([IVXLCDM]+e{SPACE}+siècle\)")
    translated = plain.rlike(rf"(?i)(?:^|[^A-Za-z0-9_])(?:Trad{_ENDS}|Trad\.|Traduction{_ENDS})")
    rows = rows.withColumns({"_titled": titled, "_ref": arrow})
    rows = rows.withColumn("_ref", F.col("_ref") | (F.col("_titled") & ((by & year) | (translated & (by | year)))))
    heading = (F.length(plain) < 80) & ~plain.rlike("[.!?»]$") & plain.rlike("^[A-ZÀÂÆÇÉÈÊËÎÏÔŒÙÛÜŸ]") & ~plain.rlike(SOURCE_WORD)
    role = F.when(F.col("_ref"), "reference").when(~F.col("_titled"), "title").when(heading, "subheading").otherwise("paragraph")
    body = rows.select(key, "pos", "html", role.alias("role"))
    lines = F.filter(F.transform(F.split("_notes", "\r?\n"), lambda x: trim(x)), lambda x: x != "")
    notes = parts.select(key, F.posexplode(lines).alias("pos", "html")).select(key, (F.col("pos") + (1 << 20)).alias("pos"), "html", F.lit("footnote").alias("role"))
    return body.unionByName(notes)


def format_reference(html: Column) -> Column:
    """A reference without its arrow: lines joined by breaks, translators marked, the work of the first line in italics."""

    def work(line: Column, at: Column, rest: Column) -> Column:
        end = first_comma_or_paren(rest)
        cut = F.concat(F.substring(line, F.lit(1), (at + 1).cast("int")), F.lit(" <i>"), trim(F.substring(rest, F.lit(1), end.cast("int"))), F.lit("</i>"), F.substring(rest, (end + 1).cast("int"), F.length(rest)))
        return F.when(end > -1, cut).otherwise(line)

    def first(line: Column) -> Column:
        told = strip_html(line).rlike(rf"^[^,]+,{SPACE}*[^,(]") & ~line.contains("<i>")
        return let(first_comma(line), lambda at: F.when(told & (at > -1), let(trim(F.substring(line, (at + 2).cast("int"), F.length(line))), lambda rest: work(line, at, rest))).otherwise(line))

    def one(line: Column, i: Column) -> Column:
        translator = strip_html(line).rlike(r"(?i)^(?:Trad\.?|Traduction)")
        return F.when(translator, F.concat(F.lit('<span class="ref-translator">'), line, F.lit("</span>"))).when(i == 0, first(line)).otherwise(line)

    bare = trim(F.regexp_replace(html, rf"^(?:<[^>]+>)*{SPACE}*→{SPACE}*(?:</[^>]+>)*", ""))
    lines = F.filter(F.transform(F.split(bare, "\n"), lambda x: trim(x)), lambda x: x != "")
    return F.array_join(F.transform(lines, one), "<br>")


def render(blocks: DataFrame, key: str = "doc") -> DataFrame:
    """key, html: the blocks of each text typeset, tagged by role and joined; footnotes in a division of their own."""
    x = typography(F.col("html"))
    wrap = lambda start, end: F.concat(F.lit(start), F.col("_x"), F.lit(end))
    rows = blocks.withColumn("_x", x).withColumn("_x", F.when(F.col("role") == "reference", format_reference(F.col("_x"))).otherwise(F.col("_x")))
    tagged = (
        F.when(F.col("role") == "title", wrap('<div class="text-body-title">', "</div>")).when(F.col("role") == "subheading", wrap('<h4 class="text-body-subheading">', "</h4>"))
        .when(F.col("role") == "reference", wrap('<div class="text-body-reference">', "</div>")).when(F.col("role") == "footnote", wrap('<div class="footnote-item">', "</div>")).otherwise(wrap('<p class="text-body-paragraph">', "</p>"))
    )
    joined = lambda keep: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct("pos", "_t")))), lambda s: s["_t"]), "")
    note = F.col("role") == "footnote"
    out = rows.select(key, "pos", "role", tagged.alias("_t")).groupBy(key).agg(joined(~note).alias("_b"), joined(note).alias("_n"))
    return out.select(key, F.concat("_b", F.when(F.col("_n") != "", F.concat(F.lit('<div class="footnotes">'), "_n", F.lit("</div>"))).otherwise("")).alias("html"))
