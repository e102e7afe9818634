"""Each query against a brute-force version, and the operators on nulls, empty texts, repeats, empty tables and clashing names."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from foliant.llm import bpe, exact_dedup, language, line_dedup, mixing, quality, queries, secrets, simhash, warc

SF = "/root/testdata/sf0.001"
WS = " \t\n\x0b\x0c\r"
UPPER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, row string, fp string"
ODD = [
    (1, None, "en", "a", None, "u", "r", "f"),
    (2, "", None, None, 0, None, None, None),
    (3, "same words " * 60, "en", "a", 1, "u", "r", "f"),
    (3, "same words " * 60, "en", "a", 1, "u", "r", "f"),
    (None, "Une ligne assez longue\nUne ligne assez longue\nfin", "fr", None, 1, "u", "r", "f"),
    (4, "\x00 zero é́ \U0001f600 <|endoftext|> it's UNE LIGNE assez longue\nUNE LIGNE assez longue ", "xx", "b", 1, "u", "r", "f"),
    (5, " ".join(f"w{i}" for i in range(30000)), "en", "b", 1, "u", "r", "f"),
]


def docs(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_odd_rows_give_one_row_each(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(3, 1), (5, 0), (None, 1), (4, None)], "doc_id long, quality int")
    results = {
        "mix": mixing.mix(df), "secrets": secrets.find_secrets(df), "quality": quality.score_quality(df, quality.fit_quality(df, labels)),
        "language": language.identify(df, language.fit_languages(df)), "bpe": bpe.encode(df), "simhash": simhash.near_duplicates(df),
        "lines": line_dedup.deduplicate(df), "exact": exact_dedup.exact_groups(df),
    }
    for name, out in results.items():
        assert len(out.collect()) == len(rows), name


def test_stages_on_odd_rows_keep_the_columns(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    for stage in (corpus_pipeline.drop_lines, corpus_pipeline.near_dedup, corpus_pipeline.mix_sources):
        out = stage(spark, df, SF)
        assert out.columns == df.columns
        out.collect()
        assert stage(spark, df.limit(0), SF).collect() == []


def test_bpe_equals_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = docs(spark) + [{"doc_id": -i, "text": r[1]} for i, r in enumerate(ODD, 1)] + [{"doc_id": -99, "text": "aaaaaaa bananananas xxxxxx ... !!!!??? 12345 naïve ﬁ Å ǅ İstanbul 漢字かな ''''s"}]
    got = {r["doc_id"]: r for r in bpe.encode(spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")).collect()}
    for r in rows:
        ids = own.encode(r["text"] or "", add_special_tokens=False).ids
        assert got[r["doc_id"]]["ids"] == ids
        assert got[r["doc_id"]]["decoded_sha256"] == sha(own.decode(ids, skip_special_tokens=False))


def test_bpe_verification_agrees_with_merging():
    coder = bpe.load(bpe._resolve("word_bpe_49k.json"))
    rng = np.random.default_rng(1)
    usable = np.array(sorted(i for t, i in coder.usable.items() if not t.endswith("</w>")))
    a, b = rng.choice(usable, 3000), rng.choice(usable, 3000)
    plain = [coder.tokens[x] + coder.tokens[y] for x, y in zip(a, b)]

    def merged(s):
        ids = [coder.vocab[c] for c in s]
        while True:
            best = min(((coder.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in coder.merges), default=None)
            if best is None:
                return ids
            i = best[1]
            ids[i : i + 2] = [coder.merges[ids[i], ids[i + 1]][1]]

    expect = [merged(s) == [x, y] for s, x, y in zip(plain, a, b)]
    assert coder.compatible(a, b).tolist() == expect


def test_simhash_equals_brute_force(spark):
    rows, fps = docs(spark), {}
    for r in rows:
        words = WORD.findall((r["text"] or "").translate(UPPER))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        fps[r["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {d: d for d in fps}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op8_simhash(spark, SF).collect()}
    assert got == {d: (f"{fps[d]:016x}", find(d)) for d in ids}


@pytest.mark.parametrize("crowd", [2, 64])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(3)
    fps = set(map(int, rng.integers(-(1 << 63), (1 << 63) - 1, 20)))
    for f in list(fps):
        for _ in range(12):
            g = f & (2**64 - 1)
            for b in rng.choice(64, rng.integers(1, 9), replace=False):
                g ^= 1 << int(b)
            fps.add(g - (1 << 64) if g >> 63 else g)
    fps = sorted(fps)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert {f: got.get(f, f) for f in fps} == {f: find(f) for f in fps}


def test_quality_measures(spark):
    got = {r["doc_id"]: r for r in queries.op5_quality(spark, SF).collect()}
    for r in docs(spark):
        t = r["text"] or ""
        words = WORD.findall(t)
        at = defaultdict(list)
        for i in range(len(words) - 2):
            at[tuple(words[i : i + 3])].append(i)
        covered = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        expect = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        g = got[r["doc_id"]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == expect
        failed = expect[0] < 50 or 100 * expect[4] > 50 * expect[0]
        assert g["base_failed"] == failed and not (failed and g["kept"])


def test_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.1"
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(label[r["doc_id"]], r["kept"], r["base_failed"]) for r in queries.op5_quality(spark, sf).collect() if r["doc_id"] in label]
    good, bad = [k for q, k, b in got if q == 1 and not b], [k for q, k, b in got if q == 0]
    print("kept of good", np.mean(good), "kept of bad", np.mean(bad))
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.3


def test_language_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in docs(spark)}
    rows = [r for r in queries.op6_language(spark, SF).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in rows]) > 0.93


def test_secret_base_spans(spark):
    kinds = {
        "assign": re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+"),
    }
    ok = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    got = {r["doc_id"]: r for r in queries.op3_secrets(spark, SF).collect()}
    for r in docs(spark):
        spans = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(kinds.items()) for m in p.finditer(r["text"] or "") if ok[k](m))
        listed = [f"{k}:{a}:{b}" for a, _, b, k in spans]
        g = got[r["doc_id"]]
        assert g["base_sha256"] == sha(",".join(listed)) and set(listed) <= set(g["spans"].split(",") if g["spans"] else [])


def test_mix_meets_targets(spark):
    rows = queries.op2_mixing(spark, SF).collect()
    taken, target = defaultdict(int), {}
    source = {r["doc_id"]: r["source"] for r in docs(spark)}
    for r in rows:
        assert r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op2_mixing(spark, SF).collect()))


def test_line_runs_over_many_batches(spark):
    df = spark.createDataFrame([(i, f"shared line {i % 7}\nown line number {i}\nshort") for i in range(40)], "doc_id long, text string")
    one, many = (sorted((r["doc_id"], r["kept_text"]) for r in line_dedup.deduplicate(df, batches=n).collect()) for n in (1, 9))
    assert one == many
    assert one[3][1] == "shared line 3\nown line number 3\nshort" and one[10][1] == "own line number 10\nshort"


def test_warc_round_trip_of_odd_pages(spark):
    big = "x" * 1500
    rows = [(1, "http://a/é", None), (2, None, ""), (3, "u\r\nX: y", big), (4, "u", big), (5, "u", "é" * 10), (6, "u", "é" * 10), (None, "u", big)]
    got = {r["page_id"]: tuple(r)[1:] for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    assert got[3] == (1500, hashlib.sha1(big.encode()).hexdigest(), "revisit", 4) and got[4][2:] == ("response", None)
    assert got[None][2:] == ("revisit", 4) and got[5] == (20, hashlib.sha1(("é" * 10).encode()).hexdigest(), "response", None) and got[1][0] == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_warc_reader_rejects_damage():
    record = warc.make_record(1, "u", b"p" * 50, hashlib.sha1(b"p" * 50).hexdigest(), 50, None)
    archive = next(warc.make_archive(iter([record] * 3)))
    assert len(list(warc.read_records(archive))) == 3
    for bad in (archive[:-5], archive[4:], archive + b"tail"):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_records(bad))
    with pytest.raises(warc.ArchiveError):
        warc.parse_record(record[:-1])


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_lm_base_equals_brute_force(spark):
    from collections import Counter
    from math import log10

    tokens = {r["doc_id"]: WORD.findall((r["text"] or "").translate(UPPER)) + [None] for r in docs(spark)}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in tokens}
    c = Counter(t for d, ts in tokens.items() if not held[d] for t in ts)
    n, v = sum(c.values()), len(c)
    gains = []
    for r in queries.op1_lm(spark, SF).collect():
        ts = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ts), sum(t in c for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), rel=1e-9)
        assert r["score"] < 0
        gains.append((r["held_out"], r["score"] / r["base_score"], r["bits_per_byte"]))
    print("score / base, bits per byte, held out:", np.mean([g[1:] for g in gains if g[0]], axis=0), "learned:", np.mean([g[1:] for g in gains if not g[0]], axis=0))


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_lm_odd_rows(spark, rows):
    from pyspark.sql import functions as F

    from foliant.llm import lm

    df = spark.createDataFrame(rows, SCHEMA)
    assert len(lm.score_texts(df, F.col("doc_id") > 3).collect()) == len(rows)
