"""SimHash near-duplicates with pigeonring filtering.

A fingerprint's 64 bits form a ring of five segments. If two fingerprints
differ in at most four bits, then from some segment on every chain of l
consecutive segments differs in at most 4l/5 bits: none in the first, at most
one in the first two, two in three, three in four. The first two segments make
the lookup key: a fingerprint is filed under (segment, next segment) and looks
under that key and those with one bit of the second flipped. Longer chains
then prune before the full Hamming check.

Under a key all links among its fingerprints are found at once, and each is
then linked with the smallest one that it reaches there: as many edges as
fingerprints, not as pairs. Keys that many fingerprints look under come from
groups of near copies and aren't gathered: two fingerprints differ in at most
four bits exactly if some value is within two bits of both, so each emits the
values within two bits and is linked with the smallest that emits the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from foliant.llm.text import WORD, whole
from foliant.runtime import discard, materialize

SHINGLE, BITS, SEED = 4, 4, 42
#: Low bit and width of the segments of the ring.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Keys looked under by more fingerprints than this are linked by midpoints, others by pairs.
CROWD = 64
_UPPER = {c: c + 32 for c in range(65, 91)}


def simhash(text: str, size: int = SHINGLE) -> int:
    """The fingerprint of one text as a signed 64-bit number; counts are held for blocks of shingles."""
    words = re.findall(WORD, text.translate(_UPPER))
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    return majority(np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + size]), SEED) for i in range(a, min(n, a + 65536))], "<u8") for a in range(0, n, 65536))


def majority(blocks: Iterable[np.ndarray]) -> int:
    """The fingerprint of 64-bit hashes, given in blocks, as a signed number: a bit is 1 if set in over half of them."""
    ones, n = np.zeros(64, np.int64), 0
    for block in blocks:
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(block)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def simhash_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([simhash(t) for t in texts], dtype="int64")


def _segment(fp: Column, i: int) -> Column:
    low, width = SEGMENTS[i % 5]
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def lookups(nodes: DataFrame) -> DataFrame:
    """key, fp, filed: the keys that each fingerprint is filed under (``filed``) or looks under."""
    fp, keys = F.col("fp"), []
    for i in range(5):
        pair = _segment(fp, i) * 8192 + _segment(fp, i + 1)
        own = pair + F.lit(i << 40)
        keys.append(F.struct(own.alias("key"), F.lit(True).alias("filed")))
        keys += [F.struct(own.bitwiseXOR(F.lit(1 << b).cast("long")).alias("key"), F.lit(False).alias("filed")) for b in range(SEGMENTS[(i + 1) % 5][1])]
    return nodes.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.key", "fp", "k.filed")


def chain_holds(x: np.ndarray) -> np.ndarray:
    """For differences ``x`` (unsigned), if some chain of segments keeps its budgets at every length."""
    diff = [np.bitwise_count((x >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int8) for low, width in SEGMENTS]
    some = np.zeros(x.shape, bool)
    for i in range(5):
        total, chain = np.zeros(x.shape, np.int8), np.ones(x.shape, bool)
        for length in range(1, 5):
            total = total + diff[(i + length - 1) % 5]
            chain &= total <= length * BITS // 5
        some |= chain
    return some


def stars(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): each of the distinct ``values`` b with the smallest a that links among ``values`` reach from it, if not itself."""
    fps = np.sort(values)
    x = fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :]
    near = chain_holds(x)
    near[near] = np.bitwise_count(x[near]) <= BITS
    root = np.arange(len(fps))
    while True:
        low = np.where(near, root[None, :], len(fps)).min(1)
        low = low[low]
        if (low == root).all():
            break
        root = low
    moved = root != np.arange(len(fps))
    return fps[root[moved]], fps[moved]


def key_edges(hits: DataFrame) -> DataFrame:
    """a, b from ``fps``, the at most ``CROWD`` fingerprints of a key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [stars(np.asarray(fps, np.int64)) for fps in batch["fps"]]
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                yield pd.DataFrame({"a": a, "b": b}).drop_duplicates()

    return hits.select("fps").mapInPandas(run, "a long, b long")


@F.pandas_udf(ArrayType(LongType()))
def midpoints(fps: pd.Series) -> pd.Series:
    """All values within two bits."""
    one = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
    i, j = np.triu_indices(64, 1)
    masks = np.concatenate([[np.uint64(0)], one, one[i] | one[j]]).astype(np.uint64).view(np.int64)
    return pd.Series([np.bitwise_xor(masks, np.int64(f)) for f in fps])


def links(nodes: DataFrame, contracted: bool = True) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly those which links of ``BITS`` bits connect; ``contracted``: as stars, of any number of links."""
    looks = lookups(nodes.repartition(max(1, nodes.sparkSession.sparkContext.defaultParallelism), "fp"))
    busy = looks.groupBy("key").agg(F.count("*").alias("n"), F.max("filed").alias("any")).where("n > 1 AND any").select("key", "n")
    hits = materialize(looks.join(busy.hint("merge"), "key"), "simhash-hits")
    few = hits.where(F.col("n") <= CROWD).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    pairs = key_edges(few)
    mids = hits.where(F.col("n") > CROWD).select("fp").distinct().select("fp", F.explode(midpoints("fp")).alias("mid"))
    heads = mids.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("mid", "a")
    crowd = mids.join(heads.hint("merge"), "mid").where("fp <> a").select("a", F.col("fp").alias("b"))
    found = pairs.unionByName(crowd)
    edges = materialize(contract(found) if contracted else found.distinct(), "simhash-edges")
    discard(hits)
    return edges


#: Edges that a task contracts at a time.
_CHUNK = 1 << 20


def contract(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the same nodes: of each chunk of a task's edges, stars around the smallest node of each group."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for batch in chain(batches, [None]):
            if batch is not None and len(batch):
                held.append(batch.to_numpy(np.int64))
                rows += len(batch)
            if rows and (batch is None or rows >= _CHUNK):
                nodes, at = np.unique(np.concatenate(held), return_inverse=True)
                x, y = at.reshape(-1, 2).T
                held, rows, low = [], 0, np.arange(len(nodes))
                while (low[x] != low[y]).any():
                    least = np.minimum(low[x], low[y])
                    for side in (low[x], low[y], x, y):
                        np.minimum.at(low, side, least)
                    low = low[low]
                low = _settled(low)
                moved = low != np.arange(len(nodes))
                yield pd.DataFrame({"a": nodes[low[moved]], "b": nodes[moved]})

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInPandas(local, "a long, b long")


def _settled(low: np.ndarray) -> np.ndarray:
    while (low[low] != low).any():
        low = low[low]
    return low


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest connected node) for every node of ``edges`` (a, b); each round is a written table.

    Edges are contracted within tasks first. Each round takes the smallest
    label beside a node, then the label of that label. Joins are merge joins,
    whose hot keys are split while running: no side of them has a key twice.
    """
    stars = contract(edges)
    both = materialize(stars.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        beside = both.join(labels.select(F.col("node").alias("b"), "root").hint("merge"), "b").groupBy("a").agg(F.min("root").alias("m"))
        lower = labels.join(beside.withColumnRenamed("a", "node").hint("merge"), "node").select("node", F.least("root", "m").alias("next"), F.col("root").alias("old"))
        lower, changes = materialize(lower, "labels-low"), Observation()
        jump = lower.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = lower.join(jump.hint("merge"), "next").select("node", F.least("next", "far").alias("root"), "old")
        new = materialize(new.observe(changes, F.count_if(F.col("root") != F.col("old")).alias("n")), "labels")
        discard(lower)
        discard(labels)
        labels = new.select("node", "root")
        labels.__dict__["_foliant_path"] = new.__dict__["_foliant_path"]
        if not changes.get.get("n"):
            discard(both)
            return labels


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row for each row of ``docs``: uid, doc_id, row, fingerprint (hex), component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint zero and are linked like any other.
    A null doc_id counts only where a component has no other. An empty table
    gives an empty result. ``row`` is a struct of the columns of ``carry``; of
    other columns nothing is read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc_id"), simhash_udf(whole(text)).alias("fp"), F.struct(*carry).alias("row") if carry else F.lit(True).alias("row"))
    rows = materialize(rows, "simhash")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    edges = links(nodes)
    roots = components(edges)
    placed = nodes.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(placed.join(least.hint("merge"), "root").select("fp", "component_id"), "simhash-named")
    for done in (edges, roots, nodes):
        discard(done)
    return rows.join(named.hint("merge"), "fp").select("uid", "doc_id", "row", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
