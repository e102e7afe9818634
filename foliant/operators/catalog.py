"""Operators on catalogs: lookups, upsert and delete, numbers, joins with seeds, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import fixed
from foliant.functions import records as R
from foliant.functions.text import count_label, match_key

#: Where rows that an upsert adds stand: after any row that was there.
_AFTER = 1 << 62


def upsert(base: DataFrame, changes: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """``base`` after ``changes`` (the same columns) are put one by one, in order of their ``pos``.

    A change replaces the first row with its key, at its place; further rows
    with the key stay. Without such a row it is added at the end, where a later
    change with the key replaces it. A null key is a key like any other.
    """
    values = [c for c in base.columns if c not in (key, pos)]
    last = changes.groupBy(key).agg(F.min(pos).alias("_first"), F.max_by(F.struct(*values), pos).alias("_row"))
    there = base.groupBy(key).agg(F.min(pos).alias("_at"))
    placed = last.join(there.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    new = placed.select(key, F.coalesce("_at", F.lit(_AFTER) + F.col("_first")).cast("long").alias(pos), "_row.*")
    gone = placed.where("_at IS NOT NULL").select(F.col(key).alias("_key"), "_at")
    kept = base.join(gone, F.col(key).eqNullSafe(F.col("_key")) & (F.col(pos) == F.col("_at")), "left_anti")
    return kept.select(*base.columns).unionByName(new.select(*base.columns))


def first_match(df: DataFrame, condition: Column, pos: str = "pos") -> DataFrame:
    """The first row, by ``pos``, that meets the condition."""
    return df.where(condition).orderBy(pos).limit(1)


def named(wanted: str, text_id: str = "id", filename: str = "filename") -> Column:
    """If a row has the id, or the file name in whatever case."""
    return F.coalesce((F.col(text_id).cast("string") == wanted) | (F.lower(filename) == wanted.lower()), F.lit(False))


def delete_first(df: DataFrame, condition: Column, pos: str = "pos") -> DataFrame:
    """Without the first row, by ``pos``, that meets the condition."""
    first = df.where(condition).agg(F.min(pos).alias("_at")).where("_at IS NOT NULL")
    return df.join(F.broadcast(first), df[pos] == F.col("_at"), "left_anti")  # one row


def next_id(df: DataFrame, text_id: str = "id", low: int = 50, high: int = 100) -> DataFrame:
    """next_id: one more than the largest id in [low, high), ``low`` if there is none; ``overflow`` where it leaves the range."""
    number = F.col(text_id).cast("string").try_cast("bigint")
    out = df.agg(F.coalesce(F.max(F.when((number >= low) & (number < high), number)) + 1, F.lit(low)).cast("long").alias("next_id"))
    return out.withColumn("overflow", F.col("next_id") >= high)


def by_number(df: DataFrame, text_id: str = "id", pos: str = "pos") -> DataFrame:
    """In order of the id as a number (9999 if it is none), then of ``pos``."""
    return df.orderBy(F.coalesce(F.col(text_id).cast("string").try_cast("bigint"), F.lit(9999).cast("long")), pos)


def existing(df: DataFrame, there: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows whose key is there."""
    return df.join(there, key, "left_semi")


def unmatched(df: DataFrame, there: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows whose key isn't there."""
    return df.join(there, key, "left_anti")


def lookup(df: DataFrame, *tables: DataFrame, key: str | list[str], values: dict[str, object]) -> DataFrame:
    """``df`` with each of ``values`` from the first table that has it for the key, else the default given.

    Tables have a key once; a value's type is that of the first table.
    """
    keys = [key] if isinstance(key, str) else list(key)
    out = df
    for i, t in enumerate(tables):
        out = out.join(t.select(*keys, *[F.col(v).alias(f"_{i}_{v}") for v in values]), keys, "left")
    filled = [F.coalesce(*[F.col(f"_{i}_{v}") for i in range(len(tables))], F.lit(d)).alias(v) for v, d in values.items()]
    return out.select(*df.columns, *filled)


def holding(df: DataFrame, column: Column, terms: tuple[str, ...]) -> DataFrame:
    """``df`` once for each of the terms, a short list, that the column holds, as ``term``."""
    return df.select("*", F.explode(F.filter(F.array(*map(F.lit, terms)), lambda t: column.contains(t))).alias("term"))


def seeded(files: DataFrame, seeds: DataFrame, generated: DataFrame) -> DataFrame:
    """Cards of files (filename): from the seeds by author and themes, else generated (filename), else placeholders.

    Adds id, title, thesis, summary, notions, ``origin`` (seed, generated or
    failed) and ``analysis``. Files of one key share what was generated for the
    first of them, by number and name, as a first answer is kept for the others.
    """
    from foliant.functions.text import file_number

    header = R.parse_header(F.col("filename"), plain_name=True)
    keyed = files.select("filename", header.alias("h")).select("filename", "h.*", R.seed_key(F.col("h.author"), F.col("h.themes")).alias("k")).select("filename", "themes", "k.*")
    cards = lambda df: F.struct("title", "thesis", "summary", "notions")
    keys = ["author_norm", "themes_norm"]
    first = generated.select("filename", cards(generated).alias("g")).join(keyed, "filename")
    first = first.groupBy(*keys).agg(F.min_by("g", F.struct(file_number(F.col("filename")), "filename")).alias("g"))
    out = keyed.join(seeds.select(*keys, cards(seeds).alias("s")), keys, "left").join(first, keys, "left")
    empty = F.array().cast("array<string>")
    placeholder = F.struct(R.fallback_title(F.col("themes")).alias("title"), F.lit(fixed.THESIS_TO_WRITE).alias("thesis"), F.lit(fixed.SUMMARY_TO_WRITE).alias("summary"), empty.alias("notions"))
    origin = F.when(F.col("s").isNotNull(), "seed").when(F.col("g").isNotNull(), "generated").otherwise("failed")
    out = out.select("filename", origin.alias("origin"), F.coalesce("s", "g", placeholder).alias("c")).select("filename", "origin", "c.*")
    notions = R.final_notions(F.col("notions"), F.col("filename"), F.col("title"), F.col("summary"))
    return out.select(file_number(F.col("filename")).alias("id"), "filename", "origin", "title", "thesis", "summary", notions.alias("notions"), R.analysis_column(F.col("title"), F.col("thesis"), F.col("summary")).alias("analysis"))


def origin_counts(cards: DataFrame) -> DataFrame:
    """seeded, generated, failed: how many cards came from where."""
    return cards.agg(*[F.count_if(F.col("origin") == o).alias(n) for o, n in (("seed", "seeded"), ("generated", "generated"), ("failed", "failed"))])


def cards(texts: DataFrame) -> DataFrame:
    """What a result card shows: id, author, title with its version, thesis, summary, tags."""
    heading = F.concat(F.col("title"), F.when(F.col("suffix").isNotNull(), F.concat(F.lit(" ["), F.col("suffix"), F.lit("]"))).otherwise(""))
    return texts.select("id", "author", heading.alias("heading"), "thesis", "summary", F.array_join("notions", " | ").alias("tags"), F.concat(F.lit("pdf/"), F.col("filename"), F.lit(".pdf")).alias("pdf"))


def result_count(found: DataFrame) -> DataFrame:
    """n, label (see ``count_label``) and opens: a single result is opened at once."""
    n = F.count("*")
    return found.agg(n.alias("n"), count_label(n).alias("label"), (n == 1).alias("opens"))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows chosen by a seeded hash of the key, in order of the key."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n).orderBy(key)


def base_name(df: DataFrame, wanted: str, filename: str = "filename") -> DataFrame:
    """Files of a base name, given with or without an extension."""
    import re

    return df.where(F.col(filename) == re.sub(r"\.(pdf|html|docx)$", "", wanted, flags=re.I))


def footnote_pairs(anchors: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """key, number, anchor, note: each anchor of a text with the note of its number."""
    return anchors.join(notes, [key, "number"])


def notion_matches(df: DataFrame, column: Column, notions: DataFrame) -> DataFrame:
    """``df`` joined with notions (notion) by their match key."""
    return df.withColumn("_k", match_key(column, spell_ae=False)).join(F.broadcast(notions.select("notion", match_key(F.col("notion"), spell_ae=False).alias("_k"))), "_k").drop("_k")  # 17 rows
