"""Line deduplication against levelled sorted runs of line hashes.

The index of lines seen is a list of runs: written tables of (hash, first
document), in buckets sorted by the hash, each on a level. A new batch is
merged with the runs: keys found there belong to an earlier document, the
others become a run of level 0. ``FANOUT`` runs of a level are compacted into
one of the next, so that a batch meets about log(batches) runs.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.text import ascii_lower, whole
from foliant.runtime import configured, materialize, remove_path, scratch_path, track

MIN_KEY, BATCHES, FANOUT = 10, 4, 3
WHITE = " \t\n\x0b\x0c\r"
_HASH = ["h1", "h2"]


def line_hash(line: Column) -> Column:
    """128 bits of the key (ends stripped, A-Z lowered) as a struct; null for keys under ``MIN_KEY`` code points."""
    key = ascii_lower(F.btrim(line, F.lit(WHITE)))
    return F.when(F.length(key) >= MIN_KEY, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")))


class LineRuns:
    """The levelled runs. ``add`` takes (h1, h2, owner, shared) of a batch and returns the keys with their owners.

    A run is a table of a fixed number of buckets by the hash, one sorted file
    each, so that a batch, once dealt to the buckets, merges with all runs
    without moving or sorting them again.
    """

    def __init__(self, spark: SparkSession, owner: str, fanout: int = FANOUT):
        self.spark, self.owner, self.fanout, self.levels = spark, owner, fanout, []
        self.paths: dict[str, str] = {}
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def add(self, keys: DataFrame) -> DataFrame:
        keys = keys.withColumns({"before": F.lit(None).cast(self.owner), "seen": F.lit(False)})
        for run in [r for level in self.levels for r in level]:  # a key is in one run at most
            old = self.spark.table(run).select(*_HASH, F.col("owner").alias("_owner"), F.lit(True).alias("_there"))
            keys = keys.join(old.hint("merge"), _HASH, "left")
            keys = keys.select(*_HASH, "owner", "shared", F.coalesce("before", "_owner").alias("before"), (F.col("seen") | F.coalesce("_there", F.lit(False))).alias("seen"))
        found = keys.select(*_HASH, F.when(F.col("seen"), F.col("before")).otherwise(F.col("owner")).alias("owner"), (F.col("seen") | F.col("shared")).alias("shared"), "seen")
        with configured(self.spark, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true"):  # each bucket is one sorted file
            met = materialize(found, "line-keys")
        self._push(0, met.where("NOT seen").select(*_HASH, "owner"))
        return met

    def _write(self, run: DataFrame) -> str:
        name, path = f"foliant_run_{uuid.uuid4().hex}", scratch_path(self.spark, "line-run")
        dealt = run.repartition(self.buckets, *_HASH)
        track(self.spark, path)
        self.paths[name] = path
        dealt.write.bucketBy(self.buckets, *_HASH).sortBy(*_HASH).option("path", path).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_path(self.spark, self.paths.pop(name))

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self._write(run))
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._push(level + 1, reduce(DataFrame.unionByName, map(self.spark.table, old)))
            for name in old:
                self._drop(name)

    def close(self) -> None:
        """Delete all runs; the keys that ``add`` returned stay."""
        for name in list(self.paths):
            self._drop(name)
        self.levels = []


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = BATCHES, carry: list[str] | None = None) -> DataFrame:
    """One row for each row of ``docs``: uid, doc_id, text, row, n_lines, n_dropped, kept_text.

    Batches are ranges of doc_id in ascending order, so an earlier batch's
    document is always the smaller. Null texts are empty (one empty line);
    a null doc_id is below any other; rows with the same doc_id are one
    document; a doc_id that isn't a whole number makes one batch; an empty table gives an empty result. ``row`` is a struct of the
    columns of ``carry``; of other columns nothing is read.
    """
    spark = docs.sparkSession
    lines = F.split(F.col("text"), "\n", -1)
    whole_numbers = docs.schema[doc_id].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    if whole_numbers:
        owner = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    else:  # other keys have an order, but no ranges to cut it into
        owner, batches = F.struct(F.col("doc_id").isNotNull(), "doc_id"), 1
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc_id"), whole(text).alias("text"), F.struct(*(carry or [])).alias("row") if carry else F.lit(True).alias("row"))
    base = materialize(rows.withColumn("hashes", F.transform(lines, line_hash)), "lines")
    cuts = sorted(set(base.stat.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01))) if batches > 1 else []
    edges = [None, *[int(c) for c in cuts], None]
    runs, drops = LineRuns(spark, base.select(owner.alias("o")).schema["o"].dataType.simpleString()), []
    try:
        for low, high in zip(edges, edges[1:]):
            inside = F.lit(True)
            if low is not None:
                inside = inside & (owner > low)
            if high is not None:
                inside = inside & (owner <= high)
            part = base.where(inside).select("uid", owner.alias("doc"), F.posexplode("hashes").alias("pos", "h")).where("h IS NOT NULL").select("uid", "doc", "pos", "h.h1", "h.h2")
            keys = part.groupBy(*_HASH).agg(F.min("doc").alias("owner"), (F.min("doc") < F.max("doc")).alias("shared"))
            shared = runs.add(keys).where("shared").select(*_HASH, "owner")
            drops.append(part.join(shared, _HASH).where("doc <> owner").select("uid", "pos"))
    finally:  # also where a batch fails
        runs.close()
    gone = reduce(DataFrame.unionByName, drops).groupBy("uid").agg(F.collect_list("pos").alias("gone"))
    out = base.drop("hashes").join(gone, "uid", "left").withColumn("lines", lines)
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")  # by a hash set: linear in the lines
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.element_at("lines", i + 1)), "\n"))
    return out.select(
        "uid", "doc_id", "text", "row", F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept_text"),
    )
