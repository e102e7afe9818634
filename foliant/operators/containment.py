"""Containment join: which keys of a table are held by which texts.

A text that holds a key holds its substrings of three characters. Of these the
one that fewest texts hold is the key's anchor; texts meet a key under its
anchor only, and what meets is compared in full. Shorter keys are their own anchors.

Keys that fit in a task are sent to all tasks. Anchors are then chosen anew for
each slice of the texts, by what that slice holds, so texts are read once and
only what is found is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from foliant.functions.text import grams
from foliant.runtime import broadcast_if_small, materialize

GRAM = 3
#: Anchors up to so many are sent to all tasks that cut texts; more are joined by a shuffle.
FEW_ANCHORS = 50_000

#: Keys of up to so many rows and characters are sent to all tasks; more meet the texts in joins.
FEW_KEYS, FEW_CHARACTERS = 200_000, 8_000_000
#: Characters of texts that are looked at together.
SLICE = 1 << 20


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def _grams(codes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The substrings of n characters as numbers, and whose they are; none goes over the end of a text."""
    at = np.flatnonzero(owner[: max(len(owner) - n + 1, 0)] == owner[n - 1 :])
    return sum(codes[at + j] << (21 * (n - 1 - j)) for j in range(n)), owner[at]


class Keys:
    """Distinct keys, by the length of their grams: the keys, the sorted grams, each key's grams and where they start."""

    def __init__(self, keys: list[str]):
        self.sized, self.longest = [], max(map(len, keys), default=0)
        for n in range(1, GRAM + 1):
            some = [k for k in keys if len(k) == n or (n == GRAM and len(k) > n)]
            if some:
                grams, owner = _grams(_codes(some), np.repeat(np.arange(len(some)), list(map(len, some))), n)
                known, flat = np.unique(grams, return_inverse=True)
                self.sized.append((n, some, known, flat, np.searchsorted(owner, np.arange(len(some)))))

    def held(self, texts: list[str]) -> list[list[str]]:
        """The keys that each text holds."""
        found: list[dict] = [{} for _ in texts]
        for part in _slices(texts, self.longest):
            owner = np.repeat([i for i, _ in part], [len(t) for _, t in part])
            codes = _codes([t for _, t in part])
            for n, keys, known, flat, start in self.sized:
                grams, of = _grams(codes, owner, n)
                place = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                hit = known[place] == grams
                met = np.unique(place[hit] * len(texts) + of[hit])  # by gram, then text
                gram, of = np.divmod(met, len(texts))
                ends = np.searchsorted(gram, np.arange(len(known) + 1))
                rarest = np.minimum.reduceat(np.diff(ends)[flat] << 32 | flat, start)
                for k in np.flatnonzero(rarest >> 32):
                    g = rarest[k] & 0xFFFFFFFF
                    for i in of[ends[g] : ends[g + 1]].tolist():
                        if keys[k] in texts[i]:
                            found[i][keys[k]] = None
        return [list(f) for f in found]


def _slices(texts: list[str], longest: int) -> Iterator[list[tuple[int, str]]]:
    """Texts (number, text) of about SLICE characters together; a longer one in pieces that share as much as the longest key has."""
    part, size = [], 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE:
            yield part
            part, size = [], 0
        if len(t) > SLICE:
            for at in range(0, len(t), SLICE):
                yield [(i, t[at : at + SLICE + longest])]
            continue
        part.append((i, t))
        size += len(t)
    if part:
        yield part


def _sought(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """_id, _key: what rows (_id, _text) hold of a small table of keys."""
    known = rows.sparkSession.sparkContext.broadcast(Keys([r["_key"] for r in keys.collect()]))  # at most FEW_KEYS rows

    def held(texts: pa.Array) -> pa.Array:
        return pa.array(known.value.held([t or "" for t in texts.to_pylist()]), pa.list_(pa.string()))

    return rows.select("_id", F.explode(F.arrow_udf(held, ArrayType(StringType()))("_text")).alias("_key"))


def contained(texts: DataFrame, keys: DataFrame, text_id: str, text: str, key: str) -> DataFrame:
    """text_id, key: a row for each row of ``texts`` and each distinct key that its text holds.

    ``text_id`` tells the rows of ``texts`` apart. Null texts hold nothing, null and empty keys
    are held by none; repeated keys count once.
    """
    wanted = materialize(keys.select(F.col(key).alias("_key")).where(F.length("_key") > 0).distinct(), "wanted-keys")
    rows = texts.select(F.col(text_id).alias("_id"), F.col(text).alias("_text")).where("_text IS NOT NULL")
    size = wanted.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("_key")), F.lit(0)).alias("m")).first()
    if size["n"] <= FEW_KEYS and size["m"] <= FEW_CHARACTERS:
        return _sought(rows, wanted).select(F.col("_id").alias(text_id), F.col("_key").alias(key)).distinct()
    short = [r["n"] for r in wanted.where(F.length("_key") < GRAM).select(F.length("_key").alias("n")).distinct().collect()]  # at most GRAM - 1 rows
    sizes = [*sorted(short), GRAM]
    of_key = F.explode(F.when(F.length("_key") < GRAM, F.array("_key")).otherwise(grams(F.col("_key"), GRAM))).alias("gram")
    candidates = materialize(wanted.select("_key", of_key), "key-grams")
    some = candidates.select("gram").distinct()
    cut = rows.select("_id", F.explode(F.concat(*[grams(F.col("_text"), n) for n in sizes])).alias("gram"))
    met = cut.join(broadcast_if_small(some, FEW_ANCHORS), "gram")
    often = met.groupBy("gram").agg(F.count("*").alias("often"))
    anchors = candidates.join(often, "gram", "left").groupBy("_key").agg(F.min_by("gram", F.struct(F.coalesce("often", F.lit(0)), "gram")).alias("gram"))
    anchors = materialize(anchors, "key-anchors")
    pairs = cut.join(broadcast_if_small(anchors, FEW_ANCHORS), "gram").select("_id", "_key")
    found = rows.join(pairs, "_id").where(F.col("_text").contains(F.col("_key")))
    return found.select(F.col("_id").alias(text_id), F.col("_key").alias(key)).distinct()


def held_either_way(left: DataFrame, right: DataFrame, left_text: str, right_text: str) -> DataFrame:
    """left_text, right_text: distinct texts of which one holds the other."""
    a = left.select(F.col(left_text).alias("a"), F.col(left_text).alias("b")).distinct()
    b = right.select(F.col(right_text).alias("a"), F.col(right_text).alias("b")).distinct()
    there = contained(a, b.select(F.col("a").alias("key")), "a", "b", "key").toDF(left_text, right_text)
    back = contained(b, a.select(F.col("a").alias("key")), "a", "b", "key").toDF(right_text, left_text)
    return there.unionByName(back.select(left_text, right_text)).distinct()
