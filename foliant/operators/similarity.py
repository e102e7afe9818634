"""Similarity join of sets: all pairs of a left and a right set whose Jaccard similarity reaches a threshold.

Equal sets are one class on each side. The members of all sets have one order,
rare ones first. Two similar sets share a member among the first few of each
(prefix filter), where "few" follows from the threshold; sizes too far apart
and first shared members too far behind (length and place filters) rule pairs out
before the sets themselves are compared. No pair is missed, none is made up.

Where the right side is small it is sent to all tasks as an index (member: the
classes that hold it). A left set is then compared where it is read: how many
members it shares with each class is counted over its members. Left sets
aren't written or shuffled, only what is found is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from foliant.functions.text import let
from foliant.runtime import broadcast_if_small, materialize


def classes(df: DataFrame, key: str, members: Column) -> DataFrame:
    """key, class, members: rows of equal sets have one class, the digest of their members; empty and null sets go. Written."""

    def named(m: Column) -> Column:  # one text for one set
        told = F.concat_ws("", F.transform(m, lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)))
        return F.struct(F.sha2(told, 256).alias("class"), m.alias("members"))

    made = df.select(key, let(F.array_sort(F.array_distinct(members)), named).alias("set"))
    return materialize(made.select(key, "set.*"), "sets").where(F.size("members") > 0)


def ranked(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """class, n, members: each set's members from rare to common."""
    met = sets.select("class", F.explode("members").alias("m")).join(counts, "m")
    rows = met.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("often", "m"))).alias("x"))
    return rows.select("class", F.size("x").alias("n"), F.transform("x", lambda p: p["m"]).alias("members"))


def prefixes(sets: DataFrame, over: int, under: int) -> DataFrame:
    """class, n, place, m: the first members of each set, one of which each set similar to it holds among its own first ones."""
    n = F.col("n")
    many = n - F.ceil(n * over / under).cast("int") + 1
    return sets.select("class", "n", F.posexplode(F.slice("members", F.lit(1), many)).alias("place", "m"))


def similar(left: DataFrame, right: DataFrame, over: int, under: int) -> DataFrame:
    """left_class, right_class, shared, either: pairs of classes (class, members) that share at least ``over``/``under`` of their union.

    The fraction is of whole numbers, so that the bounds are exact.
    """
    sides = [side.select("class", "members").dropDuplicates(["class"]) for side in (left, right)]
    every = sides[0].unionByName(sides[1]).dropDuplicates(["class"])
    counts = materialize(every.select(F.explode("members").alias("m")).groupBy("m").agg(F.count("*").alias("often")), "member-counts")
    a, b = (materialize(ranked(side, counts), "ranked-sets") for side in sides)
    p = prefixes(a, over, under).toDF("left_class", "n", "i", "m")
    q = prefixes(b, over, under).toDF("right_class", "k", "j", "m")
    n, k, i, j = map(F.col, ("n", "k", "i", "j"))
    sizes = (F.least(n, k) * under >= F.greatest(n, k) * over)
    # what they share is this member, and what both have after it, or before it
    reach = F.least(i, j) + 1 + F.least(n - i, k - j) - 1
    met = p.join(q, "m").where(sizes & (reach * (over + under) >= (n + k) * over)).select("left_class", "right_class").distinct()
    met = met.join(a.select(F.col("class").alias("left_class"), F.col("members").alias("x")), "left_class")
    met = met.join(b.select(F.col("class").alias("right_class"), F.col("members").alias("y")), "right_class")
    shared = F.size(F.array_intersect("x", "y"))
    pairs = met.select("left_class", "right_class", shared.alias("shared"), (F.size("x") + F.size("y") - shared).alias("either"))
    return pairs.where(F.col("shared") * under >= F.col("either") * over)


#: Right sides of up to so many classes and members of these are sent to all tasks; larger ones are joined by shuffles.
FEW_CLASSES, FEW_MEMBERS = 20_000, 2_000_000
_SHARED = StructType([StructField(name, IntegerType()) for name in ("class", "shared", "either")])


class Index:
    """The classes that hold each member, as one array of classes and where each member's part of it lies."""

    def __init__(self, sets: list[list[str]]):
        names, counts = np.unique([m for s in sets for m in s], return_counts=True)
        self.number = {m: i for i, m in enumerate(names.tolist())}
        self.size = np.array([len(s) for s in sets], np.int64)
        self.start = np.append(0, np.cumsum(counts))
        members = np.array([self.number[m] for s in sets for m in s], np.int64)
        self.classes = np.repeat(np.arange(len(sets)), self.size)[np.argsort(members, kind="stable")]

    def similar(self, members: list[str], over: int, under: int) -> Iterator[tuple[int, int, int]]:
        """(class, shared, either) of the classes that are similar enough to a set."""
        known = [self.number[m] for m in members if m in self.number]
        if len(known) * under < len(members) * over:  # no class can share enough
            return
        shared = np.bincount(np.concatenate([self.classes[self.start[i] : self.start[i + 1]] for i in known]), minlength=len(self.size))
        either = self.size + len(members) - shared
        for c in np.flatnonzero(shared * under >= either * over):
            yield int(c), int(shared[c]), int(either[c])


def _beside(left: DataFrame, left_key: str, members: Column, right: DataFrame, over: int, under: int) -> DataFrame:
    """left_key, right_class, shared, either: ``similar`` of left rows and a small table of right classes (right_class, members)."""
    spark = left.sparkSession
    listed = right.toArrow()  # at most FEW_CLASSES rows
    index = spark.sparkContext.broadcast(Index(listed["members"].to_pylist()))

    def compare(sets: pa.Array) -> pa.Array:
        rows, ends = [], [0]
        for s in sets.to_pylist():
            rows.extend(index.value.similar(list(set(s)), over, under) if s else ())
            ends.append(len(rows))
        columns = zip(*rows) if rows else [()] * 3
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], names=_SHARED.names))

    found = left.select(left_key, F.explode(F.arrow_udf(compare, ArrayType(_SHARED))(F.array_distinct(members))).alias("x"))
    names = spark.createDataFrame(list(enumerate(listed["right_class"].to_pylist())), "class int, right_class string")
    return found.select(left_key, "x.*").join(F.broadcast(names), "class").drop("class")


def similarity_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_set: Column, right_set: Column, over: int = 4, under: int = 5) -> DataFrame:
    """left_key, right_key, similarity: all pairs of rows whose sets have a Jaccard similarity of ``over``/``under`` or more.

    Null and empty sets are similar to none; repeated rows and keys give a
    pair each; nulls within a set are left out.
    """
    clean = lambda s: F.filter(s, lambda m: m.isNotNull())
    y = classes(right, right_key, clean(right_set))
    few = y.select(F.col("class").alias("right_class"), "members").dropDuplicates(["right_class"])
    size = few.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("members")), F.lit(0)).alias("m")).first()
    if size["n"] <= FEW_CLASSES and size["m"] <= FEW_MEMBERS:
        pairs = _beside(left, left_key, clean(left_set), few, over, under)
        rows = pairs.join(broadcast_if_small(y.select(right_key, F.col("class").alias("right_class")), FEW_CLASSES), "right_class")
        return rows.select(left_key, right_key, (F.col("shared") / F.col("either")).alias("similarity"))
    x = classes(left, left_key, clean(left_set))
    pairs = similar(x, y, over, under)
    rows = pairs.join(x.select(left_key, F.col("class").alias("left_class")), "left_class").join(y.select(right_key, F.col("class").alias("right_class")), "right_class")
    return rows.select(left_key, right_key, (F.col("shared") / F.col("either")).alias("similarity"))
