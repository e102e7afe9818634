"""Joins between tables of texts against brute force."""

import random

from pyspark.sql import functions as F

from foliant.operators import search, similarity
from foliant.operators.containment import contained, held_either_way
from foliant.operators.similarity import similarity_join


def random_sets(rng, n):
    sets = [[rng.choice("abcdefghijklmno") for _ in range(rng.randint(0, 9))] for _ in range(n)]
    return [(i, s) for i, s in enumerate(sets)] + [(n, None), (n + 1, ["a", None, "b"]), (0, sets[0])]


def test_similar_sets(spark):
    rng = random.Random(8)
    left, right = random_sets(rng, 120), random_sets(rng, 80)
    frames = [spark.createDataFrame(x, f"{k} int, {k}s array<string>") for x, k in ((left, "l"), (right, "r"))]
    for over, under in ((1, 2), (4, 5), (1, 1), (1, 10)):
        out = similarity_join(*frames, "l", "r", F.col("ls"), F.col("rs"), over, under).collect()
        want = []
        for i, a in left:
            for j, b in right:
                x, y = {m for m in a or [] if m}, {m for m in b or [] if m}
                if x and y and len(x & y) * under >= len(x | y) * over:
                    want.append((i, j, round(len(x & y) / len(x | y), 9)))
        assert sorted((r[0], r[1], round(r[2], 9)) for r in out) == sorted(want)
    assert similarity_join(frames[0].limit(0), frames[1], "l", "r", F.col("ls"), F.col("rs")).collect() == []


def test_members_that_hold_separators_stay_apart(spark):
    df = spark.createDataFrame([(1, ["a:b", "c"]), (2, ["a", "b", "c"]), (3, ["1:a1:b"]), (4, ["a", "b"])], "k int, s array<string>")
    right = df.select(F.col("k").alias("r"), "s")
    assert sorted(tuple(x)[:2] for x in similarity_join(df, right, "k", "r", F.col("s"), F.col("s"), 1, 1).collect()) == [(i, i) for i in (1, 2, 3, 4)]


def test_contained_keys(spark):
    rng = random.Random(9)
    texts = [(i, "".join(rng.choice("abé ") for _ in range(rng.randint(0, 40)))) for i in range(200)] + [(200, None), (201, "zz" * 5000 + "key")]
    keys = [("".join(rng.choice("abé ") for _ in range(rng.randint(0, 6))),) for _ in range(80)] + [(None,), ("key",), ("key",), ("a",), ("absent",)]
    t, k = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(keys, "key string")
    want = {(i, key) for i, x in texts for (key,) in keys if x and key and key in x}
    for few in (100_000, 0):
        from foliant.operators import containment

        before, containment.FEW_ANCHORS = containment.FEW_ANCHORS, few
        got = [tuple(r) for r in contained(t, k, "id", "text", "key").collect()]
        containment.FEW_ANCHORS = before
        assert len(got) == len(set(got)) and set(got) == want
    assert contained(t, k.limit(0), "id", "text", "key").collect() == [] and contained(t.limit(0), k, "id", "text", "key").collect() == []


def test_held_either_way(spark):
    left = ["la liberté", "art", "", None, "le bonheur"]
    right = ["liberté", "l'art du bonheur", "le bonheur", "x"]
    got = held_either_way(*(spark.createDataFrame([(x,) for x in xs], f"{c} string") for xs, c in ((left, "a"), (right, "b"))), "a", "b").collect()
    assert {tuple(r) for r in got} == {(a, b) for a in left for b in right if a and b and (a in b or b in a)}


def test_many_queries_find_what_each_finds(spark):
    texts = spark.createDataFrame(
        [(1, "La liberté de l’esprit", "Kant", ["L'État"]), (12, "esprit libre", None, []), (21, "Nature et liberté", "Élie", None), (121, None, "esprit", ["La liberté"]), (3, "", "", ["La nature"])],
        "id long, title string, author string, notions array<string>",
    )
    asked = ["liberté", "liberte ESPRIT", '"de l\'esprit"', "la", "12", "1", "nature état", "d'état kant", "", None, "  ", "xyz", "nature\tliberté", "liberte liberté"]
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "q int, query string")
    fields, lists = [F.col("title"), F.col("author")], [F.col("notions")]
    got = {tuple(r) for r in search.search_many(texts, queries, "id", fields, "q", "query", lists).collect()}
    want = {(i, r["id"]) for i, q in enumerate(asked) if (q or "").strip() for r in search.search(texts, q, fields, lists, F.col("id")).collect()}
    assert got == want


def test_a_small_right_side_writes_no_left_sets(spark, monkeypatch):
    rng = random.Random(11)
    left = spark.createDataFrame(random_sets(rng, 90), "l int, ls array<string>")
    right = spark.createDataFrame(random_sets(rng, 60), "r int, rs array<string>")
    written, real = [], similarity.materialize
    monkeypatch.setattr(similarity, "materialize", lambda df, name: written.append(name) or real(df, name))
    rows = lambda: sorted(tuple(x) for x in similarity_join(left, right, "l", "r", F.col("ls"), F.col("rs"), 1, 2).collect())
    few = rows()
    assert written == ["sets"] and few
    monkeypatch.setattr(similarity, "FEW_CLASSES", 1)
    assert rows() == few and len(written) > 2


def test_broadcast_keys_find_what_joins_find(spark, monkeypatch):
    from foliant.operators import containment

    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("ab𝄞é") for _ in range(n))
    texts = [(i, word(rng.randint(0, 40))) for i in range(60)] + [(60, None), (61, word(5000))]
    keys = [(word(rng.randint(1, 7)),) for _ in range(80)] + [(texts[61][1][900:1500],), (None,), ("",), ("absent",)]
    want = sorted((i, k) for i, t in texts for k in {k for (k,) in keys if k} if t and k in t)
    frames = spark.createDataFrame(texts, "i int, t string"), spark.createDataFrame(keys, "k string")
    rows = lambda: sorted(map(tuple, contained(*frames, "i", "t", "k").collect()))
    monkeypatch.setattr(containment, "SLICE", 64)
    written, real = [], containment.materialize
    monkeypatch.setattr(containment, "materialize", lambda df, name: written.append(name) or real(df, name))
    assert rows() == want and written == ["wanted-keys"]
    monkeypatch.setattr(containment, "FEW_KEYS", 1)
    assert rows() == want and len(written) > 2


def test_a_term_of_all_queries_makes_no_row_for_each_query_and_text(spark):
    texts = spark.createDataFrame([(i, f"the name{i}x of it" if i % 3 else None) for i in range(300)], "i int, t string")
    queries = spark.createDataFrame([(q, f"name{q}x the") for q in range(400)] + [(400, "the"), (None, "the name7x"), (None, "the name7x")], "q int, query string")
    found = search.search_many(texts, queries, "i", [F.col("t")], "q", "query")
    got = found.collect()
    assert sorted((-1 if r[0] is None else r[0], r[1]) for r in got) == sorted([(-1, 7)] + [(q, q) for q in range(300) if q % 3] + [(400, i) for i in range(300) if i % 3])
