"""Running values of documents of any size against windows over whole documents."""

import random

from pyspark.sql import functions as F

from foliant.operators import align, blocks, roles
from foliant.operators.scan import running

def kinds():
    return {"s": ("sum", F.col("n")), "a": ("any", F.col("n") > 7), "l": ("last", F.col("t")), "b": ("before", F.col("t")), "f": ("after", F.col("t"))}


def test_cells_equal_windows(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, 3]), p * rng.choice([1, 1, 40]) - 50, rng.choice([None, *range(9)]), rng.choice([None, "x", "y", str(p)])) for p in range(600)]
    rows = list({(r[0], r[1]): r for r in rows}.values()) + [(4, None, 1, "z"), (4, 0, 2, None)]
    df = spark.createDataFrame(rows, "k int, p long, n int, t string")
    want = sorted(map(str, running(df, "k", "p", kinds(), None).collect()))
    for bits in (0, 2, 5, 16):
        assert sorted(map(str, running(df, "k", "p", kinds(), bits).collect())) == want
    assert running(df.limit(0), "k", "p", kinds()).collect() == []


def test_lines_of_long_documents(spark):
    lines = ["→ A,", "b", "Titre", "c.", "« d", "* e", "Trad. f", "→ G", "Page 3:", "H i"]
    rng = random.Random(3)
    rows = [(d, i, rng.choice(lines)) for d in range(3) for i in range(400)]
    df = spark.createDataFrame(rows, "d int, p long, t string")
    short, long = (sorted(map(str, blocks.merge_references(df, "d", "p", "t", bits).collect())) for bits in (None, 3))
    assert short == long
    arrow, on = F.col("t").startswith("→"), F.length("t") < 5
    assert sorted(map(str, roles.reference_runs(df, "d", "p", arrow, on, bits=3).collect())) == sorted(map(str, roles.reference_runs(df, "d", "p", arrow, on).collect()))


def test_one_document_of_ten_million_lines(spark):
    df = spark.range(10_000_000).select(F.lit("one").alias("d"), F.col("id").alias("p"))
    out = running(df, "d", "p", {"s": ("sum", (F.col("p") % 10 == 0).cast("long")), "b": ("before", F.col("p")), "l": ("last", F.when(F.col("p") % 1000 == 0, F.col("p")))})
    wrong = (F.col("s") != F.floor(F.col("p") / 10) + 1) | (F.col("l") != F.col("p") - F.col("p") % 1000) | ~F.col("b").eqNullSafe(F.when(F.col("p") > 0, F.col("p") - 1))
    assert out.agg(F.count("*").alias("n"), F.count_if(wrong).alias("wrong")).first() == (10_000_000, 0)


def test_alignment_of_many_blocks(spark):
    n = 20_000
    left = spark.range(n).select(F.lit("d").alias("doc"), F.col("id").alias("pos"), F.concat(F.lit("bloc numero "), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    right = left.where("pos % 3 <> 0")
    rows = align.greedy_align(left, right).select("left_pos", "right_pos").collect()
    assert len(rows) == n
    assert {r[0]: r[1] for r in rows} == {i: i if i % 3 else None for i in range(n)}
