"""Readers: catalog lines and rows, bodies, page texts, seeds and file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import records as R
from foliant.functions import text as T
from foliant.functions.fixed import BODY_MISSING


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """pos, line of a text file, in its order; a carriage return at a line's end goes."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.monotonically_increasing_id().alias("pos"), F.regexp_replace("value", r"\r\z", "").alias("line"))


def client_rows(lines: DataFrame) -> DataFrame:
    """pos, id_raw, filename, analysis, notions of catalog lines (pos, line) as the reader takes them.

    The first line is the header. Lines are trimmed before they are parted, so
    that an empty first field moves the others; blank lines and those of fewer
    than three fields go; a missing fourth field is null.
    """
    cut = lines.where("pos > 0").select("pos", F.split(T.trim(F.col("line")), "\t", -1).alias("c")).where(F.size("c") >= 3)
    return cut.select("pos", F.col("c")[0].alias("id_raw"), F.col("c")[1].alias("filename"), F.col("c")[2].alias("analysis"), F.try_element_at("c", F.lit(4)).alias("notions"))


def script_rows(lines: DataFrame) -> DataFrame:
    """pos, cells of catalog lines as the scripts take them: header and blank lines go, fields stay as they are, however many."""
    return lines.where("pos > 0").where(T.trim(F.col("line"), T.PY_SPACE) != "").select("pos", F.split("line", "\t", -1).alias("cells"))


def catalog_header(lines: DataFrame) -> DataFrame:
    """The header line as it is."""
    return lines.where("pos = 0").select("line")


def text_records(rows: DataFrame) -> DataFrame:
    """The records of catalog rows, in order of id, rows of the same id in the file's order (column ``pos``)."""
    return R.text_records(rows).orderBy("id", "pos")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return text_records(client_rows(read_lines(spark, path)))


def list_files(spark: SparkSession, folder: str, extension: str) -> DataFrame:
    """path, filename (without extension) of a folder's files in order of their names; lock files (~$) are left out."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").load(folder)
    name = F.url_decode(F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\+", "%2B"))
    files = found.select("path", F.regexp_replace(name, rf"(?i)\.{extension}$", "").alias("filename"))
    return files.where(~F.col("filename").startswith("~$")).orderBy("filename")


def numbered(files: DataFrame, name: str = "filename") -> DataFrame:
    """Files in order of their leading number (999 without one), then of their names."""
    return files.orderBy(T.file_number(F.col(name)), name)


def union_files(*listings: DataFrame) -> DataFrame:
    """Each file of several listings once."""
    out = listings[0]
    for more in listings[1:]:
        out = out.unionByName(more)
    return out.distinct()


def read_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """filename, html: one row a file of the folder."""
    name = F.url_decode(F.regexp_replace(F.col("_metadata.file_name"), r"\+", "%2B"))
    found = spark.read.option("wholetext", True).option("pathGlobFilter", "*.html").text(folder)
    return found.select(F.regexp_replace(name, r"\.html$", "").alias("filename"), F.col("value").alias("html"))


def with_bodies(texts: DataFrame, bodies: DataFrame) -> DataFrame:
    """Texts with their html by file name, a notice where there is none, and ``has_body``."""
    joined = texts.join(bodies.select("filename", "html"), "filename", "left")
    return joined.withColumn("has_body", F.col("html").isNotNull()).withColumn("html", F.coalesce("html", F.lit(BODY_MISSING)))


def page_texts(lines: DataFrame, key: str = "doc") -> DataFrame:
    """key, text from lines of pages (key, page, pos, line): page-number lines go, pages are joined by a blank line."""
    kept = lines.where(~T.page_number_line(F.col("line")))
    pages = kept.groupBy(key, "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("t"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]), "\n\n")
    return pages.groupBy(key).agg(T.trim(whole, T.PY_SPACE).alias("text"))


def seed_blocks(lines: DataFrame, key: str = "doc") -> DataFrame:
    """key, block, lines: blocks of a seed text (key, pos, line) that start at lines of a number and a dot.

    Blocks of a text are numbered in its order, which one task per text does.
    """
    from foliant.operators.blocks import split_blocks

    starts = T.trim(F.col("line"), T.PY_SPACE).rlike(r"^[0-9]+\.")
    rows = split_blocks(lines.select(key, "pos", "line"), key, "pos", starts)
    blank = T.trim(F.col("line"), T.PY_SPACE) == ""
    rows = rows.where((F.col("block") > 0) | ~blank)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    return rows.groupBy(key, "block").agg(ordered.alias("lines"))


def parse_seeds(blocks: DataFrame, key: str = "doc") -> DataFrame:
    """author_norm, themes_norm, title, thesis, summary, notions: one row a key, of the last block with it."""
    told = blocks.select(key, "block", R.parse_seed_block(F.col("lines")).alias("s")).where("s IS NOT NULL")
    told = told.select(key, "block", "s.*", R.parse_header(F.col("s.header"), plain_name=False).alias("h")).where("h.author IS NOT NULL AND h.themes IS NOT NULL")
    keyed = told.select(key, "block", R.seed_key(F.col("h.author"), F.col("h.themes")).alias("k"), F.struct("title", "thesis", "summary", "notions").alias("card"))
    last = keyed.groupBy("k").agg(F.max_by("card", F.struct(key, "block")).alias("card"))
    return last.select("k.*", "card.*")


def read_responses(rows: DataFrame, response: str = "response") -> DataFrame:
    """``rows`` with the parts of a labelled answer: title, thesis, summary, notions."""
    return rows.select("*", R.parse_response(F.col(response)).alias("_r")).select(*rows.columns, "_r.*")


