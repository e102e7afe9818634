"""Exact deduplication by content-defined chunk recipes (DataFrame operations only).

Every normalised text is cut at content-defined boundaries. Chunks meet under
a 64-bit fingerprint and are told apart there by their SHA-256 and length, so
that a chunk's identifier (fingerprint, variant) is verified and never merges
two different chunks; only chunks whose fingerprint collides need a join. A text becomes a recipe, the ordered list of its chunks'
identifiers; equal recipes mean equal texts. Texts are read once and never
shuffled: only recipes move, some 20 bytes for about 700 characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.text import ascii_lower, whole
from foliant.runtime import discard, materialize

#: Chunks end behind one of these characters, between the two lengths, else at the larger one.
BOUNDARY, MIN_CHUNK, MAX_CHUNK = r"[\n.!?|]", 512, 4096


def chunk_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """uid, doc_id, text_sha256 and the array ``chunks`` of (fp, sha, len) for each row of ``docs``; written once."""
    norm = ascii_lower(whole(text))
    pattern = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?{BOUNDARY}|.{{1,{MAX_CHUNK}}}"
    rows = (
        docs.select(F.col(doc_id).alias("doc_id"), norm.alias("norm"))
        .withColumn("uid", F.monotonically_increasing_id())
        .withColumn("pieces", F.regexp_extract_all("norm", F.lit(pattern), F.lit(0)))
    )
    chunks = F.transform(
        "pieces", lambda c: F.struct(F.xxhash64(c).alias("fp"), F.unhex(F.sha2(c, 256)).alias("sha"), F.length(c).alias("len"))
    )
    return materialize(rows.select("uid", "doc_id", F.sha2("norm", 256).alias("text_sha256"), chunks.alias("chunks")), "recipes")


def colliding_chunks(refs: DataFrame) -> DataFrame:
    """fp and the sorted distinct (len, sha) of fingerprints that several chunks share: none, but for collisions.

    Counted map-side first, so that a chunk of many texts meets in few rows.
    """
    return refs.groupBy("fp").agg(F.sort_array(F.collect_set(F.struct("len", "sha"))).alias("variants")).where(F.size("variants") > 1)


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Null texts count as
    empty, and empty texts are equal to each other (their recipe is empty). The
    row with the largest doc_id stays; a null doc_id is below any other. Of
    repeated rows with the same doc_id and text exactly one is kept. An empty
    table gives an empty result; other columns of ``docs`` are not looked at.
    """
    base = chunk_table(docs, doc_id, text)
    refs = base.select("uid", F.posexplode("chunks").alias("pos", "c")).select("uid", "pos", "c.fp", "c.len", "c.sha")
    shared = materialize(colliding_chunks(refs), "collisions")
    if shared.isEmpty():
        known = base.withColumn("recipe", F.transform("chunks", lambda c: F.struct(c["fp"].alias("fp"), F.lit(1).cast("long").alias("v"))))
    else:
        variant = F.array_position("variants", F.struct("len", "sha"))
        told = refs.join(shared.hint("merge"), "fp").select("uid", F.struct("pos", variant.alias("v")).alias("e")).groupBy("uid").agg(F.map_from_entries(F.collect_list("e")).alias("told"))
        recipe = F.transform("chunks", lambda c, i: F.struct(c["fp"].alias("fp"), F.coalesce(F.try_element_at("told", i), F.lit(1).cast("long")).alias("v")))
        known = base.join(told, "uid", "left").withColumn("recipe", recipe)
    known = materialize(known.select("uid", "doc_id", "text_sha256", "recipe"), "known")
    discard(shared)
    discard(base)
    groups = known.groupBy("recipe").agg(F.max(F.struct("doc_id", "uid")).alias("keep"), F.count("*").alias("group_size"))
    groups = materialize(groups, "groups")  # so that the join below can split a large group's rows
    return known.join(groups.hint("merge"), "recipe").select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("keep.uid")).alias("kept"),
        "text_sha256",
    )
