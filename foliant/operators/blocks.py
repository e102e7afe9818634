"""Document-order operators on lines: blocks, sticky states, merging, anomalies of markup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.scan import running

HIDDEN = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
_ATTRIBUTES = r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*?"""
#: Rules whose every match is an anomaly.
ANOMALIES = {
    "empty_element": r"(?i)<p(?:\s" + _ATTRIBUTES + r")?>(?:\s|\x{A0}|&nbsp;)*</p\s*>",
    "inline_style": r"(?i)<[a-z]" + _ATTRIBUTES + r"""\sstyle(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']*)|[\s/>])""",
}


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, line for each line of each text."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
    return lines.withColumn("pos", F.col("pos").cast("long"))


def split_blocks(df: DataFrame, key: str, pos: str, starts, bits: int | None = None) -> DataFrame:
    """Adds ``block``, the running number of rows at which a block starts; ``bits`` for documents of any size, see ``scan.running``."""
    return running(df, key, pos, {"block": ("sum", starts.cast("long"))}, bits)


def sticky(df: DataFrame, key: str, pos: str, condition, name: str, bits: int | None = None) -> DataFrame:
    """Adds ``name``: if the condition held on this row or before."""
    return running(df, key, pos, {name: ("any", condition)}, bits)


def merge_lines(df: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """Lines that go on (lower-case start, or after a line that ends in , ; : or -) are joined to the line before."""
    w = Window.partitionBy(key).orderBy(pos)
    goes_on = F.col(text).rlike("^[a-z(]") | F.lag(text).over(w).rlike("[,;:-]$")
    marked = split_blocks(df.withColumn("new", ~F.coalesce(goes_on, F.lit(False)) | F.lag(pos).over(w).isNull()), key, pos, F.col("new"))
    return marked.groupBy(key, "block").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(pos, text))), lambda x: x[text]), " ").alias("merged"))


def anomalies(df: DataFrame, key: str, html: str) -> DataFrame:
    """key, type, found: a row for each empty paragraph and each element with a style; scripts, style sheets and comments are no markup."""
    markup = F.regexp_replace(html, HIDDEN, "")

    def matches(name: str, rule: str):
        return F.transform(F.regexp_extract_all(markup, F.lit(rule), F.lit(0)), lambda m: F.struct(F.lit(name).alias("type"), m.alias("found")))

    rows = [matches(name, rule) for name, rule in ANOMALIES.items()]
    return df.select(key, F.explode(F.concat(*rows)).alias("a")).select(key, "a.type", "a.found")


_TRANSLATOR = r"(?i)^(Trad\.|Traduction)"
_NOT_HEADING = r"(?i)^(Trad\.|Traduction|Tome|Vol\.|Ed\.|Éd\.|p\.|Page|Chapitre|col\.)"


def merge_references(df: DataFrame, key: str, pos: str, text: str, bits: int | None = None) -> DataFrame:
    """key, ``block`` (position of its first line), n_lines, merged: a line that starts with an arrow takes in the lines that go on with it.

    Lines go on unless they start with «, →, * or N.B., or look like a
    subheading; after , ; : or -, and with a lower-case letter, a bracket or
    Trad. at their start, they go on in any case but the first. Tags don't count.
    With ``bits`` (see ``scan.running``) documents of any size are taken; a merged reference is one row.
    """
    clean = F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"^[\s\x{A0}\x{202F}]+|[\s\x{A0}\x{202F}]+$", "")
    lines = running(df.select(key, pos, text, clean.alias("_clean")), key, pos, {"_lag": ("before", F.col("_clean"))}, bits)
    line, arrow = F.col("_clean"), F.col("_clean").startswith("→")
    starts = line.rlike(r"^(?:[«→*]|N\.B\.)")
    heading = (F.length(line) < 75) & ~line.rlike(r"[.!?»]$") & line.rlike("^[A-ZÀ-Ÿ]") & ~line.rlike(_NOT_HEADING)
    goes_on = F.coalesce(F.col("_lag").rlike("[,;:-]$"), F.lit(False)) | line.rlike(r"^[\p{Ll}(\[]") | line.rlike(_TRANSLATOR)
    lines = lines.withColumn("_arrow", arrow).withColumn("_new", arrow | starts | ~(goes_on | ~heading))
    new = F.coalesce(F.col("_new"), F.lit(False))
    headed = {"_headed": ("last", F.when(new, F.coalesce("_arrow", F.lit(False)))), "_from": ("last", F.when(new, F.col(pos)))}
    lines = running(lines, key, pos, headed, bits)
    plain = F.when(F.col("_arrow"), F.regexp_replace(text, "^(<b><i>|<b>|<i>)?→(</i></b>|</b>|</i>)?", "→")).otherwise(F.col(text))
    lines = lines.select(key, F.when(F.col("_headed"), F.col("_from")).otherwise(F.col(pos)).alias("block"), F.struct(F.col(pos).alias("p"), plain.alias("t")).alias("l"))
    return lines.groupBy(key, "block").agg(F.count("*").alias("n_lines"), F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["t"]), "\n").alias("merged"))
