"""The shards of the mix: quotas of the splitting tree, texts of the pieces and their order."""

from collections import Counter, defaultdict

import corpus_pipeline
from foliant.llm import mixing
from foliant.runtime import materialize

SF = "/root/testdata/sf0.001"


def test_shards_meet_the_quotas_disjointly(spark):
    sizes = mixing.document_sizes(spark.read.parquet(f"{SF}/documents.parquet"))
    plan = mixing.mixing_plan(sizes)
    shard, words = defaultdict(set), Counter()
    for r in mixing.draw_blocks(sizes, plan).collect():
        shard[r["ord"], r["block"]].add(r["shard"])
        words[r["ord"], r["block"]] += r["word_to"] - r["word_from"]
    assert all(len(s) == 1 for s in shard.values())
    blocks = Counter((o, s) for (o, _), at in shard.items() for s in at)
    for p in plan.collect():
        assert [blocks[p["ord"], s] for s in range(mixing.SHARDS)] == [b - a for a, b in zip([0, *p["cuts"]], p["cuts"])]
        assert {b for o, b in shard if o == p["ord"]} == set(range(p["quota"]))
        assert all(words[p["ord"], b] == mixing.BLOCK_WORDS for b in range(p["quota"] - 1))


def test_the_mix_is_its_drawn_blocks_in_shard_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = mixing.mixed_texts(docs).select("row.*", *mixing.ORDER).collect()
    ordered = sorted(pieces, key=lambda r: [r[c] for c in mixing.ORDER])
    got = materialize(corpus_pipeline.mix_sources(spark, docs, SF), "test-mix").collect()
    assert [(r["doc_id"], r["text"]) for r in got] == [(r["doc_id"], r["text"]) for r in ordered]
    assert len({r["shard"] for r in pieces}) == mixing.SHARDS
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text"] in text[r["doc_id"]] for r in pieces)
    words, chars = Counter(), Counter()
    for r in pieces:
        words[r["doc_id"]] += len(r["text"].split())
        chars[r["doc_id"]] += len(r["text"])
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(docs).collect()}
    assert all(words[d] == n for d, (n, _) in taken.items())
    assert all(chars[d] == n // size * len(text[d]) for d, (n, size) in taken.items() if size and n % size == 0)
