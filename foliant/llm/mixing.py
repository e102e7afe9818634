"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (DataFrame operations only).

The documents of a source, permuted by a hash, form one stream of words that
is repeated as often as its target asks. The stream is cut into blocks of
equal size, which gives each source an exact quota of blocks. A binary tree
over the output shards splits the quotas: each node draws from a multivariate
hypergeometric distribution how many blocks of each source go to its left
half. A source's blocks are dealt to its shards in a permuted order, disjoint
by construction, and each shard shuffles its blocks locally by a hash.

Positions in a stream are prefix sums over about sqrt(n) buckets of a source,
so that no window ever holds a whole source. What is joined to documents is
one row a source, broadcast only if there are few.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.text import WORD, whole
from foliant.runtime import broadcast_if_small, materialize, numbered

WEIGHTS, SHARE, MOST_COPIES = (5, 2, 1), 1.5, 2
BLOCK_WORDS, SHARDS, SEED = 1024, 16, 42
#: More sources than this aren't broadcast but joined by a shuffle.
BROADCAST_SOURCES = 20_000
ORDER = ("shard", "key", "ord", "block", "at")
#: Blocks of the ordered mix that a task writes, at least and at most: some 25 to 400 MB of text.
BLOCKS_A_TASK = (1 << 12, 1 << 16)
#: Primes, one of which at least doesn't divide a quota below 2^61, and is then coprime to it.
_STEPS = (2_147_483_629, 2_147_483_587)


def document_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """uid, doc_id, source, size (number of words) for each row; written once, so that texts are read once."""
    size = F.regexp_count(whole(text), F.lit(WORD)).cast("long")
    return materialize(
        docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size")), "sizes"
    )


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """ord, source, n_docs, source_size, target: one row a source.

    Sources in order of code points, null last, weigh ``weights`` in turn and
    share ``share`` times all words. A target stops at ``most`` times its
    source's size; the excess is shared anew by weight until none is above,
    which is to find the level at which targets min(cap, level * weight) add up.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("ord") % len(weights) + 1).cast("int"))
    per = per.withColumn("ord", F.row_number().over(order) - 1).withColumn("weight", weight)
    per = per.withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "ord")
    everything = Window.partitionBy()
    below = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (share * F.sum("source_size").over(everything) - below) / rest
    per = per.withColumn("level", level)
    stop = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "ord", "level"))).over(everything)["level"]
    target = F.coalesce(F.least("cap", stop * F.col("weight")), F.col("cap"))
    return per.select("ord", "source", "n_docs", "source_size", target.alias("target"))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which the plan then holds and computes once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _log_gamma(x: Column) -> Column:
    """log Gamma(x) for x >= 1: Stirling's series at x + 8, brought back by a product."""

    def at(x: Column) -> Column:
        y = x + 8
        series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - (1 / 360 - 1 / 1260 / (y * y)) / (y * y)) / y
        product = x
        for i in range(1, 8):
            product = product * (x + i)
        return series - F.log(product)

    return _let(x, at)


def _log_choose(n: Column, k: Column) -> Column:
    return _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1)


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """The value of a hypergeometric variable at the uniform ``u``: how many of ``good`` among ``drawn`` of ``total``.

    Inversion of the distribution, walked from 12 standard deviations below
    the mean to 12 above: it takes some 24 * sd steps, not as many as ``good``.
    """
    one = F.lit(1.0)

    def spread(v: Column) -> Column:
        n, k, m = v["n"], v["k"], v["m"]
        mean = m * k / F.greatest(n, one)
        sd = F.sqrt(F.greatest(F.lit(0.0), mean * (n - k) * (n - m)) / F.greatest(n * (n - 1), one))
        low, high = F.greatest(F.lit(0.0), m - (n - k)), F.least(k, m)
        return F.struct(n.alias("n"), k.alias("k"), m.alias("m"), mean.alias("mean"), sd.alias("sd"), low.alias("low"), high.alias("high"))

    def bounds(v: Column) -> Column:
        a = F.greatest(v["low"], F.floor(v["mean"] - 12 * v["sd"] - 2).cast("double"))
        b = F.least(v["high"], F.ceil(v["mean"] + 12 * v["sd"] + 2).cast("double"))
        return F.struct(*[v[c].alias(c) for c in ("n", "k", "m", "low", "high")], a.alias("a"), b.alias("b"))

    def walk(v: Column) -> Column:
        n, k, m, a, b = (v[c] for c in "nkmab")

        def step(acc: Column, i: Column) -> Column:
            x = i.cast("double")
            found = F.when(acc["found"] >= 0, acc["found"]).when(acc["cum"] + acc["p"] >= u, x).otherwise(F.lit(-1.0))
            grown = acc["p"] * (k - x) * (m - x) / F.greatest((x + 1) * (n - k - m + x + 1), one)
            return F.struct((acc["cum"] + acc["p"]).alias("cum"), grown.alias("p"), found.alias("found"))

        p = F.exp(_log_choose(k, a) + _log_choose(n - k, m - a) - _log_choose(n, m))
        start = F.struct(F.lit(0.0).alias("cum"), p.alias("p"), F.lit(-1.0).alias("found"))
        walked = F.aggregate(F.sequence(a.cast("long"), b.cast("long")), start, step, lambda acc: F.when(acc["found"] >= 0, acc["found"]).otherwise(b))
        return F.when(v["low"] >= v["high"], v["low"]).otherwise(walked).cast("long")

    given = F.struct(total.cast("double").alias("n"), good.cast("double").alias("k"), drawn.cast("double").alias("m"))
    return _let(_let(_let(given, spread), bounds), walk)


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """ord and ``cuts``, a source's running block quotas after each shard, from ``ord`` (0, 1, ...) and ``quota``.

    The tree's work is one row of quotas a node; each level is one projection.
    """
    nodes = quotas.agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "quota"))), lambda x: x["quota"]).alias("q"))
    nodes = nodes.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "q")
    for _ in range(max(0, math.ceil(math.log2(shards)))):
        half = F.floor((F.col("hi") - F.col("lo")) / 2).cast("int")
        total = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x)
        nodes = nodes.withColumn("mid", F.col("lo") + half).withColumn("total", total)
        nodes = nodes.withColumn("take", F.floor(F.col("total") * half / (F.col("hi") - F.col("lo"))).cast("long"))

        def draw(acc: Column, k: Column) -> Column:
            h = F.xxhash64(F.lit(seed), F.col("lo"), F.col("hi"), acc["i"])
            u = (F.pmod(h, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
            return _let(
                hypergeometric(acc["n"], k, acc["m"], u),
                lambda x: F.struct((acc["i"] + 1).alias("i"), (acc["n"] - k).alias("n"), (acc["m"] - x).alias("m"), F.array_append(acc["out"], x).alias("out")),
            )

        start = F.struct(F.lit(0).alias("i"), F.col("total").alias("n"), F.col("take").alias("m"), F.array().cast("array<bigint>").alias("out"))
        left = F.when(half > 0, F.aggregate("q", start, draw)["out"])
        nodes = nodes.select("lo", "mid", "hi", "q", F.explode(F.array(left)).alias("left"))
        both = F.when(
            half > 0,
            F.array(
                F.struct(F.col("lo"), F.col("mid").alias("hi"), F.col("left").alias("q")),
                F.struct(F.col("mid").alias("lo"), F.col("hi"), F.zip_with("q", "left", lambda a, b: a - b).alias("q")),
            ),
        ).otherwise(F.array(F.struct("lo", "hi", "q")))
        nodes = nodes.select(F.explode(both).alias("n")).select("n.lo", "n.hi", "n.q")
    leaves = nodes.select(F.col("lo").alias("shard"), F.posexplode("q").alias("ord", "blocks"))
    listed = leaves.groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("shard", "blocks"))).alias("s"))
    zero = F.array().cast("array<bigint>")
    cuts = F.aggregate("s", zero, lambda acc, x: F.array_append(acc, x["blocks"] + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))))
    return listed.select("ord", cuts.alias("cuts"))


def mixing_plan(sizes: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED, **targets) -> DataFrame:
    """One row a source: its target, quota of words and blocks, and its cuts among the shards; written once."""
    per = source_targets(sizes, **targets).withColumn("words", F.round("target").cast("long"))
    per = materialize(per.withColumn("quota", F.ceil(F.col("words") / block_words).cast("long")), "targets")
    return materialize(per.join(split_quotas(per.select("ord", "quota"), shards, seed), "ord"), "plan")


def draw_blocks(sizes: DataFrame, plan: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The pieces of the mix: uid, copy, word_from, word_to (within the document), ord, block, at, shard, key.

    ``at`` is the piece's first word in its block. ``ORDER`` is the order of
    the written mix: shards, in each its blocks by ``key``, in these their
    pieces. A document gives at most two copies, and the one at the quota's
    edge is cut at a word.
    """
    plan = broadcast_if_small(plan.withColumnRenamed("source", "plan_source"), BROADCAST_SOURCES)
    h = F.xxhash64(F.lit(seed), "doc_id", "size")
    placed = (
        sizes.join(plan, sizes["source"].eqNullSafe(plan["plan_source"]))
        .where("size > 0 AND quota > 0")
        .select("uid", "size", "ord", "n_docs", "source_size", "words", "quota", "cuts", h.alias("h"))
        .withColumn("bucket", F.pmod("h", F.ceil(F.sqrt("n_docs")).cast("long")))
    )
    sums = placed.groupBy("ord", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = F.sum("bucket_size").over(Window.partitionBy("ord").orderBy("bucket")) - F.col("bucket_size")
    offsets = sums.select(F.col("ord").alias("o_ord"), F.col("bucket").alias("o_bucket"), before.alias("offset"))
    inside = F.sum("size").over(Window.partitionBy("ord", "bucket").orderBy("h", "size", "uid").rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("inside", inside - F.col("size"))
    placed = placed.join(offsets, (F.col("ord") == F.col("o_ord")) & (F.col("bucket") == F.col("o_bucket")))
    placed = placed.withColumn("start", F.col("offset") + F.col("inside"))
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.floor((F.col("words") - 1) / F.col("source_size")).cast("int"))))
    copies = copies.withColumn("lo", F.col("start") + F.col("copy") * F.col("source_size"))
    copies = copies.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("words"))).where("lo < hi")
    first, last = F.floor(F.col("lo") / block_words), F.floor((F.col("hi") - 1) / block_words)
    pieces = copies.withColumn("block", F.explode(F.sequence(first, last)))
    lo, hi = F.greatest("lo", F.col("block") * block_words), F.least(F.col("hi"), (F.col("block") + 1) * block_words)
    shift = F.pmod(F.xxhash64(F.lit(seed + 1), "ord"), F.col("quota"))
    step = F.pmod(F.when(F.col("quota") % _STEPS[0] != 0, F.lit(_STEPS[0])).otherwise(F.lit(_STEPS[1])), F.col("quota"))
    wide = lambda c: c.cast("decimal(19,0)")
    product = F.when(F.col("quota") < 1 << 31, step * F.col("block")).otherwise(F.pmod(wide(step) * wide(F.col("block")), wide(F.col("quota"))).cast("long"))
    dealt = (product % F.col("quota") + shift) % F.col("quota")
    shard = F.size(F.filter("cuts", lambda c: c <= dealt))
    return pieces.select(
        "uid", "copy", (lo - F.col("lo")).alias("word_from"), (hi - F.col("lo")).alias("word_to"), "ord", "block",
        (lo - F.col("block") * block_words).alias("at"), shard.alias("shard"), F.xxhash64(F.lit(seed + 2), "ord", "block").alias("key"),
    )


def mixed_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: ``row`` of ``docs`` for each piece drawn, its text cut to the piece, and the columns of ``ORDER``.

    Pieces end where documents and blocks do; those of a whole copy make up
    its text. Sorted by ``ORDER`` they are the shards, shuffled, one after
    another. Nulls, repeated rows and empty tables as in ``mix``.
    """
    return _mixed(docs, doc_id, text, source)[0]


def ordered_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``mixed_texts`` in their order: the partitions, in theirs, are the shards, each cut by ranges of its keys.

    Keys are hashes, so equal ranges of them hold about as many blocks each and
    need no sample. There are about four partitions a core, within the bounds
    of ``BLOCKS_A_TASK``.
    """
    pieces, blocks = _mixed(docs, doc_id, text, source)
    low, high = BLOCKS_A_TASK
    size = min(high, max(low, blocks // (4 * docs.sparkSession.sparkContext.defaultParallelism)))
    parts = max(1, -(-blocks // size))
    part = F.floor((F.col("shard") + (F.col("key") / 2.0**64 + 0.5)) / SHARDS * parts).cast("int")
    return pieces.repartitionById(parts, F.least(F.greatest(part, F.lit(0)), F.lit(parts - 1))).sortWithinPartitions(*ORDER)


def _mixed(docs: DataFrame, doc_id: str, text: str, source: str) -> tuple[DataFrame, int]:
    """The pieces of the mix, and how many blocks it has."""
    kept = numbered(docs, "mix-rows")
    flat = kept.select("uid", F.col("row")[doc_id].alias("doc_id"), F.col("row")[text].alias("text"), F.col("row")[source].alias("source"))
    size = F.regexp_count(whole("text"), F.lit(WORD)).cast("long")
    sizes = materialize(flat.select("uid", "doc_id", "source", size.alias("size")), "sizes")
    plan = mixing_plan(sizes)
    pieces = draw_blocks(sizes, plan).join(sizes.select("uid", "size"), "uid")
    drawn = pieces.groupBy("uid").agg(F.collect_list(F.struct("word_from", "word_to", (F.col("word_to") == F.col("size")).alias("ends"), *ORDER)).alias("pieces"))
    words = F.regexp_extract_all(F.col("row")[text], F.lit(rf"[\x20\x09-\x0D]*{WORD}|[\x20\x09-\x0D]+\z"), F.lit(0))

    def cut(words: Column) -> Column:
        """Pieces with their texts; that which ends a document has the blanks after its last word."""
        def one(p: Column) -> Column:
            some = F.slice(words, (p["word_from"] + 1).cast("int"), (p["word_to"] - p["word_from"] + p["ends"].cast("long")).cast("int"))
            return F.struct(F.array_join(some, "").alias("text"), *[p[c].alias(c) for c in ORDER])

        return F.transform("pieces", one)

    out = kept.join(materialize(drawn, "mix-drawn").hint("merge"), "uid").select("row", F.explode(_let(words, cut)).alias("p"))
    out = out.select(F.col("row").withField(text, F.col("p.text")).alias("row"), *[F.col(f"p.{c}").alias(c) for c in ORDER])
    return out, plan.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken (words in the blocks that shards draw, copies counted), shards (that draw some).

    Null texts have size 0 and are never taken; null sources form one source,
    the last. A source without words has target 0. Repeated rows are separate
    documents. An empty table gives an empty result. Reruns agree: where a
    document lies in its source's stream depends on doc_id and size alone, and
    rows equal in both are interchangeable.
    """
    sizes = document_sizes(docs, doc_id, text, source)
    plan = mixing_plan(sizes)
    words = F.sum(F.col("word_to") - F.col("word_from")).alias("taken")
    taken = draw_blocks(sizes, plan).groupBy("uid").agg(words, F.sort_array(F.collect_set("shard")).alias("shards"))
    small = broadcast_if_small(plan.select(F.col("source").alias("plan_source"), "source_size", "target"), BROADCAST_SOURCES)
    return (
        sizes.join(taken, "uid", "left")
        .join(small, sizes["source"].eqNullSafe(small["plan_source"]))
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("shards", F.array().cast("array<int>")).alias("shards"))
    )
