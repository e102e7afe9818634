"""Named queries of joins between tables of texts, and of running values along documents that no task could hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import blocks, roles, scan, search
from foliant.operators.containment import contained, held_either_way
from foliant.operators.similarity import similarity_join
from foliant.plans.catalog import LINES, query, sql_fold, sql_key
from foliant.runtime import table

_GRAMS = "list_distinct(list_transform(range(1, greatest(length(k) - 1, 1)), lambda i: substr(k, i, 3)))"
_SENTENCES = lambda key, t: f"""SELECT {key}, n, {_GRAMS} AS s FROM (SELECT {key}, n, {sql_key('x')} AS k
    FROM (SELECT {key}, unnest(p) AS x, generate_subscripts(p, 1) - 1 AS n FROM (SELECT {key}, string_split_regex(text, '[.!?\\n]+') AS p FROM {t} WHERE text IS NOT NULL)))"""  # noqa: E731


@query(
    f"""WITH l AS (SELECT doc_id, n AS sentence, unnest(s) AS g, len(s) AS size FROM ({_SENTENCES('doc_id', 'documents')})),
         r AS (SELECT item_id, n AS item_sentence, unnest(s) AS g, len(s) AS size FROM ({_SENTENCES('item_id', 'benchmark')})),
         m AS (SELECT doc_id, sentence, item_id, item_sentence, count(*) AS shared, min(l.size) + min(r.size) - count(*) AS either FROM l JOIN r USING (g) GROUP BY ALL)
        SELECT doc_id, sentence, item_id, item_sentence, round(shared / either, 6) AS similarity FROM m WHERE 5 * shared >= 3 * either"""
)
def similar_passages(spark, sf_dir):
    """Sentences of documents and of benchmark texts whose trigrams have a similarity of 0.6 or more."""

    def sentences(name, key):
        rows = table(spark, sf_dir, name).where("text IS NOT NULL").select(key, F.posexplode(F.split("text", "[.!?\\n]+", -1)).alias("n", "x"))
        return rows.select(F.struct(F.col(key).alias("of"), F.col("n").cast("long").alias("n")).alias(f"{key}_at"), T.trigrams(T.match_key(F.col("x"))).alias("grams"))

    left, right = sentences("documents", "doc_id"), sentences("benchmark", "item_id")
    out = similarity_join(left, right, "doc_id_at", "item_id_at", F.col("grams"), F.col("grams"), 3, 5)
    place = lambda key, n: [F.col(f"{key}_at.of").alias(key), F.col(f"{key}_at.n").alias(n)]
    return out.select(*place("doc_id", "sentence"), *place("item_id", "item_sentence"), F.round("similarity", 6).alias("similarity"))


@query(
    f"""WITH k AS (SELECT DISTINCT unnest(list_concat([p_name], string_split(p_name, ' '))) AS name FROM part)
        SELECT doc_id, name FROM (SELECT doc_id, {sql_fold('text')} AS t FROM documents) JOIN k ON contains(t, name)"""
)
def names_in_texts(spark, sf_dir):
    """Part names, and their words, that documents hold."""
    names = table(spark, sf_dir, "part").select(F.explode(F.concat(F.array("p_name"), F.split("p_name", " "))).alias("name"))
    texts = table(spark, sf_dir, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))
    return contained(texts, names, "doc_id", "folded", "name")


@query(
    """SELECT DISTINCT a.p_type AS part_type, lower(c.c_mktsegment) AS segment FROM (SELECT DISTINCT lower(substr(p_type, 1, 4)) AS p_type FROM part UNION SELECT lower(c_mktsegment) || ' x' FROM customer) a
       JOIN (SELECT DISTINCT c_mktsegment FROM customer) c ON contains(a.p_type, lower(c.c_mktsegment)) OR contains(lower(c.c_mktsegment), a.p_type)"""
)
def names_either_way(spark, sf_dir):
    """Segments and type names of which one holds the other."""
    segments = table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("segment"))
    types = table(spark, sf_dir, "part").select(F.lower(F.substring("p_type", 1, 4)).alias("part_type")).unionByName(segments.select(F.concat("segment", F.lit(" x")).alias("part_type")))
    return held_either_way(types, segments, "part_type", "segment")


@query(
    f"""WITH q AS (SELECT DISTINCT p_name || ' ' || p_type AS query, list_distinct([t FOR t IN list_concat(string_split(lower(p_name), ' '), string_split(lower(p_type), ' ')) IF length(t) > 1]) AS terms FROM part
                   UNION ALL SELECT DISTINCT '"' || p_name || '" the', [lower(p_name), 'the'] FROM part
                   UNION ALL SELECT DISTINCT 'the ' || r_name, ['the', lower(r_name)] FROM region),
             d AS (SELECT doc_id, {sql_fold("coalesce(text, '')")} AS t, {sql_fold("coalesce(source, '')")} AS s FROM documents)
        SELECT query, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM q JOIN d ON len(list_filter(terms, lambda x: NOT contains(t, x) AND NOT contains(s, x))) = 0 GROUP BY query
        UNION ALL SELECT query, count(*), min(doc_id), max(doc_id) FROM (SELECT DISTINCT p_size::VARCHAR AS query FROM part) JOIN documents ON contains(doc_id::VARCHAR, query) GROUP BY query"""
)
def search_many_queries(spark, sf_dir):
    """What a table of queries finds: names of parts with their types, as a phrase with a word, regions, and sizes as ids."""
    part = table(spark, sf_dir, "part")
    asked = [F.concat_ws(" ", "p_name", "p_type"), F.concat(F.lit('"'), "p_name", F.lit('" the')), F.col("p_size").cast("string")]
    asked = [part.select(x.alias("query")) for x in asked] + [table(spark, sf_dir, "region").select(F.concat(F.lit("the "), "r_name").alias("query"))]
    queries = asked[0].union(asked[1]).union(asked[2]).union(asked[3]).distinct()
    found = search.search_many(table(spark, sf_dir, "documents"), queries.withColumn("id", F.col("query")), "doc_id", [F.col("text"), F.col("source")], "id", "query")
    return found.groupBy(F.col("id").alias("query")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


#: All lines of a source, one after another, as one document.
_SOURCE_LINES = f"SELECT coalesce(source, '') AS source, doc_id * 1048576 + pos AS place, line FROM ({LINES}) l JOIN documents USING (doc_id)"


def _source_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    lines = blocks.lines_of(docs.select(F.struct("doc_id", F.coalesce("source", F.lit("")).alias("source")).alias("k"), "text"), "k", "text")
    return lines.select("k.source", (F.col("k.doc_id") * 1048576 + F.col("pos")).alias("place"), "line")


@query(
    f"""SELECT source, place, (sum((length(line) < 40)::INT) OVER w)::BIGINT AS block, bool_or(length(line) > 900) OVER w AS in_body, lag(length(line)) OVER (PARTITION BY source ORDER BY place) AS before,
               lead(length(line)) OVER (PARTITION BY source ORDER BY place) AS after, last_value(CASE WHEN contains(line, '!') THEN place END IGNORE NULLS) OVER w AS shouted
        FROM ({_SOURCE_LINES}) WINDOW w AS (PARTITION BY source ORDER BY place ROWS UNBOUNDED PRECEDING)"""
)
def source_line_scan(spark, sf_dir):
    n = F.length("line")
    values = {
        "block": ("sum", (n < 40).cast("long")), "in_body": ("any", n > 900), "before": ("before", n.cast("long")), "after": ("after", n.cast("long")),
        "shouted": ("last", F.when(F.col("line").contains("!"), F.col("place"))),
    }
    return scan.running(_source_lines(spark, sf_dir), "source", "place", values).drop("line")


@query(
    f"""WITH RECURSIVE t AS (SELECT source, place, row_number() OVER (PARTITION BY source ORDER BY place) AS i, starts_with(line, 'E') AS arrow, length(line) < 400 AS goes_on FROM ({_SOURCE_LINES})),
         r AS (SELECT source, i, place, arrow AS ref FROM t WHERE i = 1
               UNION ALL SELECT t.source, t.i, t.place, t.arrow OR (r.ref AND t.goes_on) FROM r JOIN t ON t.source = r.source AND t.i = r.i + 1)
       SELECT source, place, ref AS is_reference FROM r"""
)
def source_reference_runs(spark, sf_dir):
    rows = _source_lines(spark, sf_dir)
    out = roles.reference_runs(rows, "source", "place", F.col("line").startswith("E"), F.length("line") < 400, bits=scan.CELL_BITS)
    return out.select("source", "place", "is_reference")
