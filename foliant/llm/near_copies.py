"""Groups of near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Texts meet by their SimHash fingerprints first, in ``simhash``'s pigeonring:
those within its four bits are compared in full, and what is similar is one
group from the start. So most copies are found, but not all: at 0.8 fingerprints
differ in some ten bits.

The rest is exact, not estimated. With the shingles of all texts in one order, two sets of
that similarity share a shingle among the first ``n - ceil(0.8 n) + 1`` of
each (n distinct shingles), so those are the keys under which texts meet. Any
order will do: shingles that are common in a sample come last, others go by
hash, so that passages that many texts quote are seldom keys. Of each pair that
meets, bitmaps that hold for each slot if its number of shingles is odd are
compared first: they can't differ in more slots than the sets in shingles, so
no similar pair is lost. What is left is compared in full.

A key of a crowd of near copies isn't paired at once. In each of ``ROUNDS``
rounds its texts are compared with one of them only and what is linked becomes
one group; at last all pairs under a key that are still in different groups are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from foliant.llm import simhash
from foliant.llm.memory import give_back
from foliant.llm.simhash import components
from foliant.llm.text import slices, whole
from foliant.llm.words import shingle_sets
from foliant.runtime import bucketed, configured, discard, materialize, numbered, settle

SHINGLE, SEED, ROUNDS = 5, 42, 3
#: Similarity as a fraction of whole numbers, so that the bounds are exact.
OVER, UNDER = 4, 5
#: Slots of the bitmaps that rule pairs out in the last round.
SLOTS = 512
#: Shingles found this often in one text of ``SAMPLE`` come last; more than ``MOST_COMMON`` aren't sent to the executors. Neither changes a result.
COMMON, SAMPLE, MOST_COMMON = 8, 16, 50_000


def shingles(texts: pd.Series) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    for part in slices(pd.DataFrame({"t": texts}), "t"):
        yield from shingle_sets(part["t"].tolist(), SHINGLE)


@F.pandas_udf(ArrayType(LongType()))
def shingles_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(list(shingles(texts)))
    give_back()


def common_shingles(docs: DataFrame, text: str) -> np.ndarray:
    """Hashes, ascending, of shingles that many texts of a sample hold."""
    sample = docs.select(whole(text).alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(SAMPLE)) == 0)
    counts = sample.select(F.explode(shingles_udf("t")).alias("s")).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    return np.array(sorted(r["s"] for r in counts.orderBy(F.desc("n"), "s").limit(MOST_COMMON).collect()), np.int64)


def _similar(a: Column, b: Column) -> Column:
    """If sets of sizes ``a`` and ``b`` can be similar enough."""
    return (F.least(a, b) * UNDER >= F.greatest(a, b) * OVER) & (F.least(a, b) > 0)


def _within_reach(n: Column, i: Column, m: Column, j: Column) -> Column:
    """If sets of sizes n and m that share their elements number i and j (in the common order) can be similar enough.

    What they share besides stands before both, or after both.
    """
    shared = F.least(i, j) + 1 + F.least(n - i, m - j) - 1
    return shared * (UNDER + OVER) >= (n + m) * OVER


def parity(s: np.ndarray, slots: int | None = None) -> bytes:
    """For each of ``slots``, or at least 2 n (a power of 2), if it holds an odd number of the n shingles."""
    slots = slots or max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount(s.view(np.uint64) & np.uint64(slots - 1), minlength=slots) & 1, bitorder="little").tobytes()


def _near(x: list[str], y: list[str], both: Column) -> Column:
    """If short bitmaps of two sets, in columns of whole numbers, let them be similar enough; ``both`` is how many shingles they have in all."""
    apart = reduce(Column.__add__, [F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in zip(x, y)])
    return apart * (UNDER + OVER) <= both * (UNDER - OVER)


@F.pandas_udf(LongType())
def slots_apart(x: pd.Series, y: pd.Series) -> pd.Series:
    """In how many slots two bitmaps differ, the longer one folded to the length of the other."""
    out = []
    for a, b in zip(x, y):
        a, b = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
        while len(b) > len(a):
            b = b[: len(b) // 2] ^ b[len(b) // 2 :]
        out.append(int(np.bitwise_count(a ^ b).sum()))
    return pd.Series(out, dtype="int64")


def similar_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets (node, n, set, bits) are similar enough. Of sets in buckets by node none is moved."""

    def beside(pairs: DataFrame, *columns: str) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(sets.select(F.col("node").alias(side), *[F.col(c).alias(c + side) for c in columns]).hint("merge"), side)
        return pairs

    apart = slots_apart("bitsa", "bitsb") * (UNDER + OVER)
    both = F.size(F.array_intersect("seta", "setb"))
    either = F.col("na") + F.col("nb") - both
    with configured(pairs.sparkSession, "spark.sql.legacy.bucketedTableScan.outputOrdering", "true"):  # a bucket in one file is sorted
        close = materialize(beside(pairs, "n", "bits").where(apart <= (F.col("na") + F.col("nb")) * (UNDER - OVER)).select("a", "b"), "near-close")
        found = materialize(beside(close, "n", "set").where(both * UNDER >= either * OVER).select("a", "b"), "near-edges")
    discard(close)
    return found


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, fp) that equal or linked fingerprints make: for each fingerprint its smallest node with the others, and with those of the links."""
    nodes = materialize(nodes, "near-nodes")
    heads = materialize(nodes.groupBy("fp").agg(F.min("node").alias("head")), "near-fingerprints")
    apart = simhash.links(heads, contracted=False)
    met = apart
    for side, head in (("a", "x"), ("b", "y")):
        met = met.join(heads.toDF(side, head).hint("merge"), side)
    same = nodes.join(heads.hint("merge"), "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    pairs = materialize(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(same), "near-alike")
    for done in (apart, heads, nodes):
        discard(done)
    return pairs


def links(keys: DataFrame, sets: DataFrame, alike: DataFrame | None = None) -> DataFrame | None:
    """node, root (the smallest node of its group) of the nodes that have a link, from keys (key, node, n) and sets (node, n, set, bits, short).

    Pairs (a, b) of ``alike`` are compared first; ``keys`` and ``alike`` are
    discarded. Each round looks only at keys whose nodes are still in several groups.
    """
    spark, edges, labels, tried = keys.sparkSession, [], None, []
    if alike is not None:
        tried.append(alike)
        edges.append(similar_pairs(alike, sets))
        if not edges[0].isEmpty():
            labels = components(edges[0])
    xs, ys = ([f"{c}{i}" for i in range(SLOTS // 64)] for c in "xy")
    for number in range(ROUNDS + 1):
        placed = keys.select("key", "node", "n", "pos", F.col("node").alias("label"))
        if labels is not None:
            placed = keys.join(labels.hint("merge"), "node", "left").select("key", "node", "n", "pos", F.coalesce("root", "node").alias("label"))
        mixed = placed.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.min_by(F.struct("node", "n", "pos", "label"), F.struct(F.xxhash64("node", F.lit(number)), "node")).alias("p")).where("l <> h")
        met = materialize(placed.join(mixed.select("key", "p.node", "p.n", "p.pos", "p.label").toDF("key", "q", "m", "at", "other").hint("merge"), "key"), "near-met")
        discard(keys)
        settle(spark)
        keys = met
        if number == ROUNDS:
            short = [F.get("short", F.lit(i)).alias(f"x{i}") for i in range(SLOTS // 64)]
            rest = met.select("key", "node", "n", "pos", "label").join(sets.select("node", *short).hint("merge"), "node").select("key", "node", "n", "pos", "label", *xs)
            met = rest.join(rest.toDF("key", "q", "m", "at", "other", *ys).hint("merge"), "key")
        may = (F.col("label") != F.col("other")) & _similar(F.col("n"), F.col("m")) & _within_reach(*map(F.col, ("n", "pos", "m", "at")))
        if number == ROUNDS:
            may = (F.col("node") < F.col("q")) & may & _near(xs, ys, F.col("n") + F.col("m"))
        pairs = met.where(may).select(F.least("node", "q").alias("a"), F.greatest("node", "q").alias("b")).distinct()
        for before in tried:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "near-pairs")
        tried.append(pairs)
        if pairs.isEmpty():  # this round's; others under a key may not have been compared yet
            continue
        edges.append(similar_pairs(pairs, sets))
        if labels is not None:
            discard(labels)
        labels = components(reduce(DataFrame.unionByName, edges))
        settle(spark)
        if keys.isEmpty():
            break
    for done in (keys, *tried, *edges):
        discard(done)
    return labels


def near_groups(rows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """uid, doc_id, root (a uid that names its group, whatever its doc_ids) for each of ``rows`` (with a uid that stays the same).

    Of rows with equal sets the one with the smallest uid stands for all, as a node.
    Null texts and those without words form one group; of other columns nothing is read.
    """
    spark = rows.sparkSession
    common = spark.sparkContext.broadcast(common_shingles(rows, text))

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = np.append(common.value, np.iinfo(np.int64).max)
        for batch in batches:
            for part in slices(batch, "t", chars=1 << 20):
                found = shingle_sets(part["t"].tolist(), SHINGLE)
                out = part[["uid", "doc_id"]].copy()
                out["hash"] = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in found], np.uint64).view(np.int64)
                out["n"] = [len(s) for s in found]
                out["fp"] = [simhash.majority(s[lo : lo + 65536] for lo in range(0, len(s), 65536)) for s in found]
                last = [np.argsort(often[np.searchsorted(often, s)] == s, kind="stable") for s in found]
                out["keys"] = [s[order][: len(s) - -(-OVER * len(s) // UNDER) + 1] if len(s) else s for s, order in zip(found, last)]
                yield out
        give_back()

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch, "t", chars=1 << 20):
                found = shingle_sets(part["t"].tolist(), SHINGLE)
                yield pd.DataFrame({"node": part["node"].to_numpy(), "n": [len(s) for s in found], "set": found, "bits": [parity(s) for s in found], "short": [np.frombuffer(parity(s, SLOTS), "<i8") for s in found]})
        give_back()

    kind = rows.schema[doc_id].dataType.simpleString()
    told = rows.select("uid", F.col(doc_id).alias("doc_id"), whole(text).alias("t")).mapInPandas(marks, f"uid long, doc_id {kind}, hash long, n int, fp long, keys array<long>")
    told = materialize(told, "near-marks")
    heads = materialize(told.groupBy("hash").agg(F.min("uid").alias("node")), "near-heads")
    named = materialize(told.join(heads.hint("merge"), "hash").select("uid", "doc_id", "node"), "near-named")
    first = told.withColumnRenamed("uid", "node").join(heads.select("node").hint("merge"), "node", "left_semi")
    alike = fingerprint_pairs(first.select("node", "fp"))
    settle(spark)
    met = materialize(first.select("node", "n", F.posexplode("keys").alias("pos", "key")), "near-keys-all")
    for done in (told, heads):
        discard(done)
    settle(spark)
    busy = met.groupBy("key").agg(F.count("*").alias("met")).where("met > 1").select("key")
    keys = materialize(met.join(busy.hint("merge"), "key", "left_semi").select("key", "node", "n", "pos"), "near-keys")
    discard(met)
    settle(spark)
    wanted = rows.withColumnRenamed("uid", "node").join(keys.select("node").distinct().hint("merge"), "node").select("node", whole(text).alias("t"))
    sets = bucketed(wanted.mapInPandas(sets_of, "node long, n int, set array<long>, bits binary, short array<long>"), "node", "near-sets")
    settle(spark)
    found = links(keys, sets, alike)
    discard(sets)
    if found is None:
        return named.withColumnRenamed("node", "root")
    return named.join(found.hint("merge"), "node", "left").select("uid", "doc_id", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each group of near copies one row of ``docs``: that with the smallest doc_id and uid, nulls last.

    Null texts and those without words are one group; exact copies and repeated
    rows are copies like any other; an empty table gives an empty result.
    """
    rows = numbered(docs, "near-rows")
    flat = rows.select("uid", F.col("row")[doc_id].alias("doc_id"), F.col("row")[text].alias("text"))
    groups = near_groups(flat)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "uid")).alias("first"))
    stay = materialize(first.select("first.uid"), "near-stay")
    settle(docs.sparkSession)
    return rows.join(stay.hint("merge"), "uid", "left_semi").select("row.*")
