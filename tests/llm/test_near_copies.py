"""The near-dedup stage of the pipeline against brute force over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import near_copies, simhash
from foliant.runtime import bucketed, discard, materialize


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept(rows):
    """uids that stay: of each group linked at similarity 0.8 the smallest doc_id."""
    grams, root = [sets(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(map(min, groups.values()))


@pytest.mark.parametrize("rounds", [0, 3])
def test_near_dedup_equals_brute_force(spark, monkeypatch, rounds):
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    rng = np.random.default_rng(5)
    texts = []
    for b in range(12):
        base = [f"b{b}w{rng.integers(400)}" for _ in range(rng.integers(60, 300))]
        texts.append(" ".join(base))
        for _ in range(8):
            copy = list(base)
            for at in rng.choice(len(copy), max(1, int(len(copy) * rng.choice([0.005, 0.01, 0.02, 0.03, 0.06]))), replace=False):
                copy[at] = f"edit{rng.integers(10**6)}"
            texts.append(" ".join(copy))
    texts += ["a few words", "A few words", "the shared passage of words " * 3 + "x", texts[0]]
    rows = [(int(d), t) for d, t in zip(rng.permutation(len(texts)), texts)]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r["doc_id"] for r in out) == kept(rows) and len(out) < len(rows)


def test_one_row_stays_of_each_group_whatever_its_ids(spark):
    one, two, three, four = (" ".join(f"{p}{i}" for i in range(40)) for p in "abcd")
    rows = [(None, one), (None, two), (1, three), (1, four), (None, three), (7, three), (5, two + " end")]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, out), key=str) == sorted([(None, one), (5, two + " end"), (1, three), (1, four)], key=str)


def test_a_round_without_pairs_is_not_the_last(spark):
    """Under one key a long text, which is similar to none, and two copies, whichever is compared with the others first."""
    copies = [np.arange(10), np.arange(10), np.arange(100)]
    for nodes in [(1, 2, 3), (4, 9, 5), (20, 30, 10), (7, 8, 100)]:
        rows = [(node, len(s), s.tolist(), bytearray(near_copies.parity(s)), np.frombuffer(near_copies.parity(s, near_copies.SLOTS), "<i8").tolist()) for node, s in zip(nodes, copies)]
        sets_ = materialize(spark.createDataFrame(rows, "node long, n int, set array<long>, bits binary, short array<long>"), "sets")
        keys = materialize(spark.createDataFrame([(7, node, len(s), 0) for node, s in zip(nodes, copies)], "key long, node long, n int, pos int"), "keys")
        found = near_copies.links(keys, sets_)
        assert {(r["node"], r["root"]) for r in found.collect()} == {(nodes[0], nodes[0]), (nodes[1], nodes[0])}


def test_near_copies_meet_by_fingerprints(spark, monkeypatch):
    """Without the rounds over shared shingles, just what fingerprints link (by brute force) and is similar becomes a group."""
    monkeypatch.setattr(near_copies, "ROUNDS", -1)
    rng, texts = np.random.default_rng(8), []
    for b in range(6):
        base = [f"b{b}w{i}" for i in range(300)]
        for _ in range(5):
            copy = list(base)
            for at in rng.choice(len(copy), int(rng.integers(1, 4)), replace=False):
                copy[at] = f"edit{rng.integers(10**6)}"
            texts.append(" ".join(copy))
    found = near_copies.shingle_sets(texts, near_copies.SHINGLE)
    fps = [simhash.majority([s]) for s in found]
    near = {(i, j) for i in range(len(texts)) for j in range(i) if ((fps[i] ^ fps[j]) % 2**64).bit_count() <= simhash.BITS}
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    assert 6 <= len(set(root)) < len(texts)
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "").collect()
    assert sorted(r["doc_id"] for r in out) == sorted(set(root))


def test_fingerprints_alone_make_no_link(spark):
    """Pairs that fingerprints suggest are compared in full."""
    sets_ = [np.arange(10), np.arange(11), np.arange(100)]
    rows = [(node, len(s), s.tolist(), bytearray(near_copies.parity(s)), np.frombuffer(near_copies.parity(s, near_copies.SLOTS), "<i8").tolist()) for node, s in enumerate(sets_)]
    sets_ = materialize(spark.createDataFrame(rows, "node long, n int, set array<long>, bits binary, short array<long>"), "sets")
    keys = materialize(spark.createDataFrame([], "key long, node long, n int, pos int"), "keys")
    alike = materialize(spark.createDataFrame([(0, 1), (0, 2)], "a long, b long"), "alike")
    assert {(r["node"], r["root"]) for r in near_copies.links(keys, sets_, alike).collect()} == {(0, 0), (1, 0)}


def test_sets_in_buckets_are_not_moved(spark):
    """What is written in buckets is joined without an exchange of its own, gives the same rows, and goes with its table."""
    rows = spark.range(1000).select(F.col("id").alias("node"), (F.col("id") * 7).alias("n"))
    kept = bucketed(rows, "node", "buckets")
    out = spark.range(500).withColumnRenamed("id", "a").join(kept.select(F.col("node").alias("a"), "n").hint("merge"), "a")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and out.count() == 500 and {r["n"] - 7 * r["a"] for r in out.collect()} == {0}
    discard(kept)
    assert not [t for t in spark.catalog.listTables() if t.name == kept.__dict__["_foliant_table"]]
