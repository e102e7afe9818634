"""The queries op1 to op13 with production parameters, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe, divergence, exact_dedup, factors, language, line_dedup, lm, mixing, periodic, quality, secrets, simhash, warc
from foliant.llm.text import WORD, whole
from foliant.runtime import table


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 1)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language.fit_languages(docs.where(~held_out).select("doc_id", "text", "lang"))
    return language.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), with_ids=False)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = factors.fit_factors(docs.where(~held_out), table(spark, sf_dir, "labels"), metadata=["n_chars"])
    scored = factors.score_factors(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def planted(doc_id: Column, text: Column) -> Column:
    """op13's text: in one of ten documents, by the checksum of doc_id, words repeat with a period that the checksum gives."""
    h = F.crc32(doc_id.cast("string"))
    words, g = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), (h - h % 10) / 10
    n = F.size(words)
    start = (g % F.greatest(n, F.lit(1))).cast("int")
    period = (1 + F.floor((n - start) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, start + 1, period), F.ceil((n - start) / period).cast("int")))
    again = F.array_join(F.concat(F.slice(words, F.lit(1), start), F.slice(tail, F.lit(1), n - start)), " ")
    return F.when((h % 10 == 0) & (n > 0), again).otherwise(text)


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), whole("text")).alias("text"))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    out = periodic.periodic_runs(docs, with_text=False).select("*", best.alias("best"))
    length, period = -F.col("best.less"), F.col("best.period")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), "collapsed_sha256",
    )


QUERIES = {f.__name__: f for f in (op1_lm, op2_mixing, op3_secrets, op4_warc, op5_quality, op6_language, op7_bpe, op8_simhash, op9_line_dedup, op10_exact_dedup, op11_factors, op12_divergence, op13_periodic)}

ORACLE_SQL = {
    "op12_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
             w AS (SELECT row, lang, source, translate(unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
             kept AS (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
             grp AS (SELECT DISTINCT lang, source FROM d),
             cnt AS (SELECT lang, source, term, count(*) AS c FROM w GROUP BY lang, source, term),
             cell AS (SELECT g.lang, g.source, k.term, coalesce(cnt.c, 0) AS c, k.c AS all_c
                      FROM grp g JOIN kept k USING (lang) LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = k.term),
             p AS (SELECT lang, source, term, c,
                          (1 + 1000000000::HUGEINT * (c + 2) // (sum(c) OVER g + 2 * count(*) OVER g))::BIGINT AS p,
                          (1 + 1000000000::HUGEINT * (all_c + 2) // (sum(all_c) OVER g + 2 * count(*) OVER g))::BIGINT AS q
                   FROM cell WINDOW g AS (PARTITION BY lang, source)),
             pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
                       FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
                       LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
                                  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
                       ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
             parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
                       UNION ALL
                       SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q)
        SELECT lang, source, part, item, value::BIGINT AS value,
               row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank
        FROM parts QUALIFY part = 'pair' OR rank <= 10
    """,
    "op9_line_dedup": r"""
        WITH l AS (SELECT doc_id, pos, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
                   FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                                generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
             d AS (SELECT *, length(k) >= 10 AND doc_id <> min(doc_id) OVER (PARTITION BY k) AS gone FROM l)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM d GROUP BY doc_id
    """,
    "op4_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
             g AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS newest FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> newest THEN newest END AS refers_to
        FROM g
    """,
    "op10_exact_dedup": """
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY norm)
    """,
}
