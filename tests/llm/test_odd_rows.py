"""Values on odd rows for each operator, stages on odd and empty tables, and plain versions of what the queries add to their base."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import bpe, exact_dedup, language, line_dedup, lm, lm_model, mixing, near_copies, quality, queries, secrets, simhash
from foliant.llm.text import words_of
from foliant.llm.words import Words, hashes, shingle_sets
from foliant.runtime import materialize
from test_operators import ODD, SCHEMA, SF, sha

EMPTY = hashlib.sha256(b"").hexdigest()


def by_id(rows, *columns):
    return sorted((tuple(r[c] for c in ("doc_id", *columns)) for r in rows), key=str)


def test_values_on_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    texts = {id(r): r[1] or "" for r in ODD}
    sizes = [(r[0], len(re.findall(r"[^\x20\x09-\x0D]+", texts[id(r)]))) for r in ODD]
    mixed = mixing.mix(df).collect()
    assert sorted(((r["doc_id"], r["size"]) for r in mixed), key=str) == sorted(sizes, key=str)
    assert all(r["taken"] <= 2 * r["size"] and (r["size"] == 0) <= (r["taken"] == 0 and r["shards"] == []) for r in mixed)
    assert {r["spans"] for r in secrets.find_secrets(df).collect()} == {""}
    model = quality.QualityModel(None)
    assert by_id(quality.score_quality(df, model).collect(), "n_words", "base_failed", "kept") == sorted([(1, 0, True, False), (2, 0, True, False), (3, 120, True, False), (3, 120, True, False), (None, 9, True, False), (4, 14, True, False), (5, 30000, False, True)], key=str)
    assert {(r["lang_pred"], r["score"]) for r in language.identify(df, language.LanguageModel({})).collect()} == {("und", 0.0)}
    told = bpe.encode(df).collect()
    assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"]) == (0, EMPTY, EMPTY, []) for r in told if r["doc_id"] in (1, 2))
    marks = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    assert {(1, "0" * 16, 1), (2, "0" * 16, 1)} <= marks and sum(d == 3 for d, _, _ in marks) == 1
    lines = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.deduplicate(df).collect()}
    assert lines[None] == (3, 0, ODD[4][1]) and lines[4] == (2, 1, ODD[5][1].split("\n")[0]) and lines[1] == lines[2] == (1, 0, "")
    exact = by_id(exact_dedup.exact_groups(df).collect(), "keep_id", "group_size", "kept")
    assert exact[:2] == [(1, 2, 2, False), (2, 2, 2, True)] and sorted(e[3] for e in exact if e[0] == 3) == [False, True] and (None, None, 1, True) in exact


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, name):
    f = dict(corpus_pipeline.STAGES)[name]
    df = spark.createDataFrame([*ODD, (6, " \n\t", "en", "a", 1, None, None, None)], SCHEMA)
    out = materialize(f(spark, df, SF), "test-stage")
    assert f(spark, df.limit(0), SF).collect() == []
    got = out.collect()
    if name != "encode":
        assert out.columns == df.columns
    ids = sorted((r["doc_id"] for r in got), key=str)
    if name == "line_dedup":
        assert ids == [3, 3, 4, 5, None] and all(r["n_chars"] == len(r["text"]) for r in got)
    if name == "near_dedup":
        assert ids == [1, 3, 4, 5, None]  # texts without words are one group
    if name == "encode":
        assert ids == [1, 2, 3, 3, 4, 5, 6, None]
    if name == "mix_sources":
        assert all(r["text"].split() for r in got)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    for f in (queries.op1_lm, queries.op2_mixing, queries.op5_quality, queries.op6_language, queries.op8_simhash, queries.op9_line_dedup, queries.op10_exact_dedup):
        assert f(spark, str(tmp_path)).collect() == []


def test_words_in_arrays_are_words():
    texts = [None, "", "A b\x85c\x1cd  é\n", "x" * 70 + " \t", " ", "Ünï \x00 z"]
    words = Words.of(texts)
    places = np.arange(len(words.hash))
    split = [[*words_of(t), b""] for t in texts]
    assert words.word(places) == [w for s in split for w in s] and words.owner.tolist() == [i for i, s in enumerate(split) for _ in s]
    assert words.at.tolist() == [j for s in split for j in range(len(s))]
    assert (hashes([w for s in split for w in s]) == words.hash).all() and len(set(words.hash.tolist())) == len({w for s in split for w in s})
    grams = shingle_sets(["a b c d e f", "A b c d e f", "a b", "a b c d e", None], 5)
    assert [len(g) for g in grams] == [2, 2, 1, 1, 0] and (grams[0] == grams[1]).all() and grams[3][0] in grams[0]


def plain_scores(docs, held, table, mixer, spell):
    """The model's scores by loops over words and bits, from its counts and starting weights."""
    words = {d: [*words_of(t), b""] for d, t in docs.items()}
    c = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    total, unknown = sum(c.values()), (sum(n == 1 for n in c.values()) + 0.5) / (sum(c.values()) + 1.0)
    logit = lambda p: math.log(p) - math.log1p(-p)
    sigmoid = lambda x: 1 / (1 + math.exp(-min(30, max(-30, x))))
    spelt = {}
    out = {}
    for d, ws in words.items():
        h = hashes(ws)
        code = [int(x) >> 32 for x in h]
        ctx = [int(x) for x in lm_model.contexts(h)]
        seen, run, score, last = [Counter() for _ in range(4)], 0, 0.0, {}
        hits, weights, grads, n_bits = [Counter() for _ in range(4)], mixer.weights.copy(), None, 0
        grads = np.zeros_like(weights)
        for t, w in enumerate(ws):
            ahead = worth = age = 0
            for k in range(lm_model.AHEAD):
                if t - k >= 2 and ctx[t - k] >> (64 - lm_model.ANCHOR_BITS) == 0:
                    slot = ctx[t - k] >> (64 - lm_model.ANCHOR_BITS - lm_model.SLOT_BITS)
                    if table.n[slot] > 0 and int(table.check[slot]) == ctx[t - k] and table.ahead[slot, k]:
                        ahead, worth, age = int(table.ahead[slot, k]), min(int(math.log2(max(int(table.n[slot]), 1))), 7), k
                        break
            own, before = (code[last[ctx[t]]], last[ctx[t]]) if t >= 2 and ctx[t] in last else (0, -1)
            told = False
            for kind, guess in ((0, ahead), (1, own if own != ahead else 0)):
                if not guess or told:
                    continue
                gap = min(int(math.log2(max(t - before, 1))), 15)
                r = min(run, 7)
                contexts = [worth * 16 + age * 2 + (own == ahead) if kind == 0 else 128 + gap, kind * 512 + r * 8 + (age if kind == 0 else 0),
                            kind * 512 + ((guess * int(lm_model._P1)) % 2**64 >> 55), kind * 512 + (worth if kind == 0 else (ahead > 0) * 8) * 8 + min(r, 3)]
                x = [logit((hits[k][q] + lm_model.STRENGTH * mixer.chance[k, q]) / (seen[k][q] + lm_model.STRENGTH)) for k, q in enumerate(contexts)]
                gate, hit = kind * 4 + min(r, 3), guess == code[t]
                p = sigmoid(sum(a * b for a, b in zip(x, weights[gate])))
                score += math.log10(min(1, max(1e-9, p if hit else 1 - p)))
                grads[gate] += lm_model.RATE * (hit - p) * np.array(x)
                n_bits += 1
                if n_bits % lm_model.BLOCK == 0:
                    weights, grads = weights + grads, np.zeros_like(weights)
                for k, q in enumerate(contexts):
                    seen[k][q] += 1
                    hits[k][q] += hit
                told = hit
            run = run + 1 if told else 0
            if t >= 2:
                last[ctx[t]] = t
            if not told:
                if c[w]:
                    score += math.log10(1 - unknown) + math.log10(c[w] / total)
                else:
                    if w not in spelt:
                        spelt[w] = plain_spelling(w, spell)
                    score += math.log10(unknown) + spelt[w]
        out[d] = score
    return out


def plain_spelling(word, spell):
    """log10 probability of a word, bit by bit."""
    near, total, wrap = 0, 0.0, 2**64
    p1, p2, p3 = (int(x) for x in (lm_model._P1, lm_model._P2, lm_model._P3))
    for byte in [*word, 0]:
        for j in range(8):
            node, bit = (1 << j) | (byte >> (8 - j)), byte >> (7 - j) & 1
            x, level = [], []
            for i, k in enumerate(lm_model.ORDERS):
                key = (((near & ((1 << 8 * k) - 1)) * p1 + i) * p2 + node * p3) % wrap
                key = (key ^ key >> 29) * p1 % wrap
                n = spell.counts[(key >> (64 - lm_model.SPELL_BITS)) + (i << lm_model.SPELL_BITS)]
                x.append(math.log(n[bit] + 0.3) - math.log(n[1 - bit] + 0.3))
                level.append(sum(n.sum() > b for b in (0.5, 4.5, 40.5)))
            total += math.log10(1 / (1 + math.exp(-min(30, max(-30, sum(a * b for a, b in zip(x, spell.weights[level[-1] * 4 + level[-2]])))))))
        near = ((near << 8) | byte) & (2**32 - 1)
    return total


def test_lm_score_equals_a_plain_version(spark, monkeypatch):
    made = {}
    for name in ("continuations", "fit_mixer", "speller"):
        monkeypatch.setattr(lm, name, lambda *a, f=getattr(lm, name), n=name: made.setdefault(n, f(*a)))
    got = {r["doc_id"]: r for r in queries.op1_lm(spark, SF).collect()}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in docs}
    table = made["continuations"]
    seen = Counter()
    for d, t in docs.items():
        if not held[d]:
            w = Words.of([t])
            _, ctx, ahead = lm_model.anchors(w.hash, w.at)
            seen.update((int(c), tuple(a)) for c, a in zip(ctx, ahead.tolist()))
    for (c, a), n in seen.items():
        slot = c >> (64 - lm_model.ANCHOR_BITS - lm_model.SLOT_BITS)
        assert table.n[slot] > n or (table.n[slot] == n and int(table.check[slot]) >= c)
    want = plain_scores(docs, held, table, made["fit_mixer"], made["speller"])
    assert all(got[d]["score"] == pytest.approx(want[d], rel=1e-9, abs=1e-9) for d in docs)


def test_lm_mixer_is_fitted_on_all_training_texts(spark):
    """The match bits of every training text count, those of held-out texts don't, and the weights lower the loss over all of them."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 12, 60)) for _ in range(2500)]
    rows = spark.createDataFrame([(t, i % 5 == 1) for i, t in enumerate(texts)], "text string, held_out boolean")
    table = spark.sparkContext.broadcast(lm.continuations(rows))
    n, hits = np.zeros((2, lm_model.PREDICTORS, lm_model.SLOTS))
    bits = []
    for t in (t for i, t in enumerate(texts) if i % 5 != 1):
        w = Words.of([t])
        bits.append(lm_model.match_bits(w.hash, w.owner, w.at, table.value, True)[0])
        for k in range(lm_model.PREDICTORS):
            np.add.at(n[k], bits[-1].ctx[:, k], 1)
            np.add.at(hits[k], bits[-1].ctx[:, k], bits[-1].hit)
    want = lm_model.Mixer.counted(n, hits)
    got = lm.fit_mixer(rows, table)
    assert n[0].sum() > 2000 and np.allclose(got.chance, want.chance, rtol=1e-12)
    assert sum(got.slopes(b)[:, 0] for b in bits).sum() < sum(want.slopes(b)[:, 0] for b in bits).sum()


def test_lm_speller_reads_equal_bytes_after_equal_bytes_once(spark):
    """The speller's counts and weights are those of all bytes of all types, from the distinct bytes with the four before them."""
    rng = np.random.default_rng(5)
    parts = ["an", "th", "ou", "é", "er", "st", "li", "qu", "ä.", "\U0001f600"]
    words = sorted({"".join(parts[i] for i in rng.integers(0, 10, rng.integers(1, 7))).encode() for _ in range(3000)} | {b"x", b"\0", b"0" * 500})
    types = spark.createDataFrame([(bytearray(w), i % 7 or 1) for i, w in enumerate(words)] + [(bytearray(), 9), (bytearray(b"held"), 0)], "word binary, c long").repartition(3)
    plain = Counter((tuple(w[max(0, i - 4) : i]), b) for w in words for i, b in enumerate([*w, 0]))
    got = {r["gram"]: r["n"] for r in lm.grams(types.where("c > 0 AND word <> X''")).collect()}
    want = Counter()
    for (before, byte), n in plain.items():
        want[sum(b << 8 * k for k, b in enumerate([byte, *reversed(before)]))] += n
    assert got == want and 10 * len(got) < sum(map(len, words))

    counts, wrap = np.zeros((len(lm_model.ORDERS) << lm_model.SPELL_BITS, 2), np.int64), 2**64
    p1, p2, p3 = (int(x) for x in (lm_model._P1, lm_model._P2, lm_model._P3))
    seen = []  # slots, bit and number of each bit that some word is spelt by
    for (before, byte), times in plain.items():
        near = sum(b << 8 * k for k, b in enumerate(reversed(before)))
        for j in range(8):
            node, bit, slots = (1 << j) | (byte >> (8 - j)), byte >> (7 - j) & 1, []
            for i, k in enumerate(lm_model.ORDERS):
                key = (((near & ((1 << 8 * k) - 1)) * p1 + i) * p2 + node * p3) % wrap
                slots.append(((key ^ key >> 29) * p1 % wrap >> (64 - lm_model.SPELL_BITS)) + (i << lm_model.SPELL_BITS))
                counts[slots[-1], bit] += times
            seen.append((slots, bit, times))

    def measured(weights):
        x, gates = [], []
        for slots, bit, times in seen:
            right, wrong = [max(counts[s, bit] - 1, 0) for s in slots], [counts[s, 1 - bit] for s in slots]
            level = [sum(a + b > c for c in (0.5, 4.5, 40.5)) for a, b in zip(right, wrong)]
            x += [[math.log(a + 0.3) - math.log(b + 0.3) for a, b in zip(right, wrong)]] * times
            gates += [level[-1] * 4 + level[-2]] * times
        return lm_model.slopes(np.array(x), np.ones(len(x)), np.array(gates), weights)

    spell = lm.speller(types)
    assert (spell.counts == counts).all()
    assert np.allclose(spell.weights, lm_model.fitted(lm_model.Speller(counts).weights, measured), rtol=1e-9)
    assert np.allclose(spell.score(words)[::10], [plain_spelling(w, spell) for w in words[::10]], rtol=1e-9)


def test_lm_beats_the_base_on_held_out_texts(spark):
    rows = [r for r in queries.op1_lm(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    words = "the and of one " * 40
    df = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3), (2, words), (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (4, "kappa iota theta eta zeta epsilon delta gamma beta alpha")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(df, F.col("doc_id") > 2).collect()}
    assert got[3] >= got[4]  # order counts


def test_secret_links_equal_all_pairs(spark):
    key = "aB3" + "x" * 36 + "Z"
    near, far = "client_id=abc123 ", "pad " * 120
    texts = [near + key, key, near + far + key, near + "password: hunter22", near, "https://host/path " + near + key, "https://host/path " + near, far + key + " " + near, near + "https://a.example/x secret=abcdef " + far + key, (near + key + " ") * 50]
    got = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    kinds = {**secrets.STRONG, **secrets.WEAK}

    def plain(text):
        spans = []
        for i, (kind, (pattern, role)) in enumerate(kinds.items()):
            for m in re.finditer(pattern, text):
                if kind != "assign" or len(m[2]) >= 6:
                    spans.append((m.start(), i, m.end(), kind, role))
        strong = [s for s in spans if s[3] in secrets.STRONG]
        out = list(strong)
        for s in spans:
            if s[3] in secrets.STRONG or any(a[0] < s[2] and s[0] < a[2] for a in strong):
                continue
            near_by = {o[4] for o in spans if abs(o[0] - s[0]) <= secrets.SCOPE}
            if {"id": "secret" in near_by, "secret": "id" in near_by, "endpoint": {"id", "secret"} <= near_by}[s[4]]:
                out.append(s)
        return ",".join(f"{k}:{a}:{b}" for a, _, b, k, _ in sorted(out))

    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_secrets_of_one_long_text(spark):
    text = "password: abcdef12 " * 26000  # some 500 KB, nothing but matches
    row = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    spans = ",".join(f"assign:{19 * i}:{19 * i + 18}" for i in range(26000))
    assert row["n_assign"] == 26000 and row["base_sha256"] == sha(spans) and row["spans"] == spans


def test_quality_held_out_and_kept(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 0))
    held = labels.where(F.crc32(F.col("doc_id").cast("string")) % 4 == 0).where("quality IS NOT NULL")
    scored = quality.score_quality(docs.join(held.select("doc_id"), "doc_id", "left_semi"), model)
    rows = scored.join(held, "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.1
    assert all(r["kept"] == (not r["base_failed"] and r["probability"] >= quality.THRESHOLD) for r in rows)
    texts = {r["doc_id"]: r["text"] for r in docs.limit(50).collect()}
    some = {r["doc_id"]: r["probability"] for r in quality.score_quality(docs.limit(50), model).collect()}
    assert all(some[d] == pytest.approx(model.probability(t or "")) for d, t in texts.items())


def test_languages_held_out_each(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    right: dict[str, list[bool]] = {}
    for r in queries.op6_language(spark, sf).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if r["held_out"] and r["lang_pred"] != "und" and lang[r["doc_id"]]:
            right.setdefault(lang[r["doc_id"]], []).append(r["lang_pred"] == lang[r["doc_id"]])
    assert len(right) >= 4 and all(np.mean(v) > 0.9 for v in right.values())


def test_many_languages_and_repeats(spark):
    rows = [(1, "word " * 20, "en")] * 3000 + [(i, f"autre {i} texte", f"zz-{i}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {"en": 3000}
    assert language.language_sample(df, counts).count() == 1  # equal rows count once
    chosen = language.chosen_languages([(f"l{i}", 700 - i) for i in range(700)])
    assert 30 < len(chosen) < 40 and chosen[0] == "l0"  # families of one: pairs among them within the bound
    assert len(language.chosen_languages([(c, 1) for codes in language.FAMILIES.values() for c in codes])) == sum(map(len, language.FAMILIES.values()))


def test_colliding_chunks_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "chunk_table", lambda docs, doc_id, text, f=exact_dedup.chunk_table: materialize(f(docs, doc_id, text).withColumn("chunks", F.transform("chunks", lambda c: c.withField("fp", F.lit(1).cast("long")))), "collide"))
    long = "x" * 5000
    rows = [(1, "a"), (2, "b"), (3, "A"), (4, long + "a"), (5, long + "b"), (6, long + "a"), (7, None)]
    got = by_id(exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect(), "keep_id")
    assert got == [(1, 3), (2, 2), (3, 3), (4, 6), (5, 5), (6, 6), (7, 7)]


def test_line_dedup_takes_text_keys(spark):
    df = spark.createDataFrame([("b", "a shared long line\nown"), ("a", "A shared long line"), (None, "a shared long line ")], "doc_id string, text string")
    assert by_id(line_dedup.deduplicate(df).collect(), "n_dropped") == [("a", 1), ("b", 1), (None, 0)]


def test_mix_quotas_against_a_plain_tree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = mixing.document_sizes(docs)
    per = {r["source"]: r for r in mixing.source_targets(sizes).collect()}
    size = Counter()
    for r in sizes.collect():
        size[r["source"]] += r["size"]
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, rest, left = {}, 1.5 * sum(size.values()), set(names)
    while left:  # who would get more than twice its size gets that, and the others share anew
        level = rest / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] >= 2 * size[s]}
        for s in over or left:
            target[s] = 2.0 * size[s] if over else level * weight[s]
        rest -= sum(target[s] for s in over)
        left = left - over if over else set()
    assert all(per[s]["target"] == pytest.approx(target[s]) and per[s]["source_size"] == size[s] for s in names)
    plan = mixing.mixing_plan(sizes).collect()
    assert all(p["cuts"][-1] == p["quota"] and p["cuts"] == sorted(p["cuts"]) for p in plan)
    total = [sum(p["cuts"][s] - (p["cuts"][s - 1] if s else 0) for p in plan) for s in range(mixing.SHARDS)]
    assert max(total) - min(total) <= 4  # the tree halves the blocks at each node
    where = lambda seed: {(r["ord"], r["block"]): r["shard"] for r in mixing.draw_blocks(sizes, mixing.mixing_plan(sizes, seed=seed), seed=seed).collect()}
    assert where(1) != where(2)


def test_near_copies_names_texts_without_words(spark):
    df = spark.createDataFrame([(1, None), (2, " "), (3, "a b c d e f g")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near_copies.one_of_each(df).collect()) == [1, 3]
