"""The corpus pipeline: quality rules, line dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet and reads again as the next stage's documents. All but the
last return the columns of documents, n_chars brought up to date.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe, line_dedup, mixing, near_copies, quality
from foliant.runtime import discard, materialize, release, scope, settle, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that the last stage's result reads.
_read: list = []


def stage(f: Stage) -> Stage:
    """A stage, at whose start the tables go that the one before read: its result has been written by then."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(_read)
        settle(spark)
        with scope() as tables:
            out = f(spark, docs, sf_dir)
        _read.extend(tables)
        return out

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the model reject go; null texts have no words and go. Repeated rows fare alike; an empty table stays empty."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.verdict_column(model)(F.coalesce("text", F.lit(""))))


@stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; a document left without a word goes.

    Null texts are empty and go. Rows that repeat a doc_id are one document and keep their lines; a null doc_id is below any other; an empty table stays empty.
    """
    out = line_dedup.deduplicate(docs, carry=[c for c in docs.columns if c != "text"])
    kept = out.where(F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")).select("row.*", F.col("kept_text").alias("text"))
    return _current(kept).select(*docs.columns)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) one row stays, that with the smallest doc_id and uid, nulls last.

    Repeated rows are copies; null texts and those without words are one group; an empty table stays empty.
    """
    return near_copies.one_of_each(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: the pieces of documents that its blocks hold, shard after shard, each shard's blocks shuffled.

    Null texts and those without words are never taken; a null source is a source of its own, the last; repeated rows are documents of their own; an empty table stays empty.
    """
    return _current(mixing.ordered_mix(docs).select("row.*")).select(*docs.columns)


@stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text of the mix, with their digest and that of the decoded text. A null text is empty and has none; an empty table gives an empty result."""
    return bpe.encode(docs)


def _current(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_lines),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: SQL can express neither the fitted model nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; a stage's table goes once the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        after = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        docs = before = after
    return docs
