"""Named queries over the Parquet tables, with DuckDB SQL that gives the same rows: searches, functions, catalogs, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import fixed
from foliant.functions import records as R
from foliant.functions import text as T
from foliant.operators import blocks, catalog, search, spans
from foliant.runtime import table

QUERIES, ORACLE_SQL = {}, {}
SPACE = T.SPACE
_Q = "chr(39)"


def sql_fold(x: str) -> str:
    """The search fold of an SQL expression."""
    return rf"regexp_replace(translate(translate(lower({x}), '’', {_Q}), '{T.ACCENTED}', '{T.PLAIN}'), '[\x{{300}}-\x{{36F}}]', '', 'g')"


def sql_trim(x: str, space: str = SPACE) -> str:
    return f"regexp_replace({x}, '^{space}+|{space}+$', '', 'g')"


def sql_key(x: str, spell_ae: bool = True) -> str:
    """The match key of an SQL expression."""
    spelt = f"replace(lower({x}), 'œ', 'oe')"
    if spell_ae:
        spelt = f"replace({spelt}, 'æ', 'ae')"
    return f"regexp_replace({spelt}, '[^a-z0-9]', '', 'g')"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_FOLD = sql_fold("coalesce(text, '')")
_STRIP = rf"regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{SPACE}+', ' ', 'g'), '^ | $', '', 'g')"
LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL"
_NOTIONS = sql_list(fixed.NOTIONS)


def query(sql: str | None):
    """Registers a function of (spark, sf_dir) under its name; ``sql`` is None where SQL can't express it."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def texts_of(documents):
    """A catalog of documents: two notions each, by their ids."""
    names = F.array(*map(F.lit, fixed.NOTIONS))
    notions = F.array(*[F.element_at(names, (F.pmod(x, F.lit(17)) + 1).cast("int")) for x in (F.col("doc_id"), F.floor(F.col("doc_id") / 17))])
    empty, text = F.lit(""), F.coalesce("text", F.lit(""))
    return documents.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("d"), "doc_id").alias("filename"), F.col("source").alias("author"), F.coalesce("lang", empty).alias("themes"), F.lit(None).cast("string").alias("suffix"),
        empty.alias("title"), text.alias("thesis"), empty.alias("summary"), notions.alias("notions"),
    )


_TEXTS = f"""SELECT doc_id AS id, source, coalesce(lang, '') AS themes, coalesce(text, '') AS thesis,
    [({_NOTIONS})[(doc_id % 17 + 1)::INT], ({_NOTIONS})[(doc_id // 17 % 17 + 1)::INT]] AS notions FROM documents"""


def _held(term: str) -> str:
    fields = " OR ".join(f"contains({sql_fold(c)}, '{term}')" for c in ("thesis", "themes", "coalesce(source, '')"))
    return f"({fields} OR len(list_filter(notions, lambda n: contains({sql_fold('n')}, '{term}'))) > 0)"


@query(
    f"""WITH hit AS (SELECT id, source, len(list_filter(notions, lambda n: n IN ('Le bonheur', 'La conscience', 'L''inconscient', 'La raison', 'La religion'))) AS score
                     FROM ({_TEXTS}) WHERE {_held('er')} AND {_held('on')})
        SELECT id AS doc_id, source, score::BIGINT AS score, row_number() OVER w AS position, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id
        FROM hit WINDOW w AS (PARTITION BY source ORDER BY score DESC, id)"""
)
def search_and_rank(spark, sf_dir):
    found = search.search_texts(texts_of(table(spark, sf_dir, "documents")), '"er" la on')
    ranked = search.navigate_large(found.select("author", "score", "id"), "author", [F.desc("score"), "id"], "id")
    return ranked.select(F.col("id").alias("doc_id"), F.col("author").alias("source"), "score", "position", "prev_id", "next_id")


@query("SELECT doc_id, source, n_chars FROM documents WHERE contains(doc_id::VARCHAR, '12')")
def search_numeric_id(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), "12", [], text_id=F.col("doc_id")).select("doc_id", "source", "n_chars")


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE contains(lower(p_type), 'ring') OR contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring')")
def search_exact_phrase(spark, sf_dir):
    return search.search(table(spark, sf_dir, "part"), '"ring"', [F.col("p_name"), F.col("p_brand"), F.col("p_type")]).select("p_partkey", "p_name", "p_brand", "p_type")


@query("SELECT count(*) AS n, count(*) || ' texte' || CASE WHEN count(*) > 1 THEN 's' ELSE '' END || ' trouvé' || CASE WHEN count(*) > 1 THEN 's' ELSE '' END AS label, count(*) = 1 AS opens FROM documents")
def search_empty_count(spark, sf_dir):
    return catalog.result_count(search.search_texts(texts_of(table(spark, sf_dir, "documents")), " "))


@query("SELECT doc_id AS id, 'd' || doc_id AS filename FROM documents WHERE doc_id = 7")
def find_by_id(spark, sf_dir):
    return search.find_id(texts_of(table(spark, sf_dir, "documents")), 7).select("id", "filename")


@query(f"SELECT id, source AS author, '' AS heading, array_to_string(notions, ' | ') AS tags, 'pdf/d' || id || '.pdf' AS pdf FROM ({_TEXTS})")
def result_cards(spark, sf_dir):
    return catalog.cards(texts_of(table(spark, sf_dir, "documents"))).select("id", "author", "heading", "tags", "pdf")


@query(f"SELECT doc_id, md5({_FOLD}) AS folded FROM documents")
def fold_accents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.fold(F.coalesce("text", F.lit("")))).alias("folded"))


@query(f"SELECT doc_id, md5({sql_key('text')}) AS match_key, md5({sql_key('text', False)}) AS catalog_key FROM documents")
def match_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.match_key(F.col("text"))).alias("match_key"), F.md5(T.match_key(F.col("text"), spell_ae=False)).alias("catalog_key"))


@query(f"SELECT page_id, {_STRIP} AS plain FROM pages")
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("plain"))


@query(rf"SELECT doc_id, md5(regexp_replace(text, '({T.LETTER_DIGIT})' || {_Q}, '\1’', 'g')) AS typeset FROM documents")
def typography_apostrophe(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.apostrophes(F.col("text"))).alias("typeset"))


_QUOTES = rf"""regexp_replace(regexp_replace(regexp_replace(text, '"([^"]+)"', '«{T.NBSP}\1{T.NBSP}»', 'g'), '«{SPACE}*', '«{T.NBSP}', 'g'), '{SPACE}*»', '{T.NBSP}»', 'g')"""


@query(f"SELECT doc_id, md5({_QUOTES}) AS typeset FROM documents")
def typography_quotes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.quotes(F.col("text"))).alias("typeset"))


_PUNCT = rf"regexp_replace(text, '({T.LETTER_DIGIT}){SPACE}*;+{SPACE}*', '\1{T.NBSP}; ', 'g')"
_PUNCT = rf"regexp_replace(regexp_replace({_PUNCT}, '({T.LETTER_DIGIT}){SPACE}*(!+)', '\1{T.NBSP}\2', 'g'), '({T.LETTER_DIGIT}){SPACE}*(\?+)', '\1{T.NBSP}\2', 'g')"


@query(f"SELECT doc_id, md5({_PUNCT}) AS typeset FROM documents")
def typography_punct(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.spaced_punctuation(F.col("text"), keep_entities=False)).alias("typeset"))


@query(None)
def typography_full(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.typography(F.col("html"))).alias("typeset"))


@query("SELECT p_partkey, upper(p_name[1]) || lower(p_name[2:]) || ' de Kant XIV' AS title FROM part")
def sentence_case(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.sentence_case(F.upper(F.concat("p_name", F.lit(" de kant xiv")))).alias("title"))


_CAPITALS = "array_to_string(list_transform(list_filter(list_transform(string_split({0}, '{1}'), lambda p: trim(p)), lambda p: p <> ''), lambda p: upper(p[1]) || p[2:]), ' – ')"


@query(f"SELECT p_partkey, {_CAPITALS.format('slashed', '/')} AS by_slash, CASE WHEN p_partkey IN (170, 261, 322, 582) THEN {_CAPITALS.format('comma', ',')} ELSE comma END AS by_comma FROM (SELECT p_partkey, replace(p_name, ' ', ' / ') AS slashed, replace(p_name, ' ', ', ') AS comma FROM part)")
def title_separators(spark, sf_dir):
    made = lambda mark: T.title_separators(F.replace("p_name", F.lit(" "), F.lit(mark)), F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", made(" / ").alias("by_slash"), made(", ").alias("by_comma"))


@query(rf"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '({T.LETTER}){T.PY_SPACE}*[''’]{T.PY_SPACE}*({T.LETTER})', '\1’\2', 'g'), '({T.LETTER}){T.PY_SPACE}*-{T.PY_SPACE}*({T.LETTER})', '\1-\2', 'g')) AS tight FROM documents")
def tighten_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.tighten(F.col("text"))).alias("tight"))


_CLEAN = rf"regexp_replace(regexp_replace(html, '{T.PY_SPACE}*//+{T.PY_SPACE}*([A-ZÀ-Ÿ«])', ' \1', 'g'), '{T.PY_SPACE}*/+{T.PY_SPACE}*([A-ZÀ-Ÿ«])', ' \1', 'g')"
_CLEAN = rf"regexp_replace(regexp_replace({_CLEAN}, '[ \t\x{{A0}}\x{{202F}}]+', ' ', 'g'), '<p>{T.PY_SPACE}*</p>', '', 'g')"


@query(f"SELECT page_id, md5({sql_trim(_CLEAN, T.PY_SPACE)}) AS clean FROM pages")
def clean_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.clean_html(F.col("html"))).alias("clean"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'DE_' || p_brand WHEN p_partkey % 3 = 1 THEN p_brand ELSE 'INCONNU' END AS author, replace(p_name, ' ', ' / ') AS themes,
              CASE p_size % 4 WHEN 0 THEN 'Version Courte' WHEN 1 THEN 'Version Complète' WHEN 2 THEN 'Introduction' END AS suffix FROM part"""
)
def split_name_author_theme(spark, sf_dir):
    third, version = F.col("p_partkey") % 3, F.col("p_size") % 4
    first = F.when(third == 0, F.concat(F.lit("DE_"), "p_brand")).when(third == 1, F.concat(F.lit("EN.UNIV._"), "p_brand")).otherwise("")
    ending = F.when(version == 0, "_Court").when(version == 1, "_complet").when(version == 2, "_Intro").otherwise("")
    name = R.split_name(F.concat(first, F.lit("_"), F.replace("p_name", F.lit(" "), F.lit(" & ")), ending))
    named = table(spark, sf_dir, "part").select("p_partkey", name.alias("n"))
    return named.select("p_partkey", "n.author", R.display_themes(T.without_version(F.col("n.themes"))).alias("themes"), T.version_suffix(F.col("n.themes")).alias("suffix"))


@query("SELECT p_partkey, p_name AS title, p_type AS thesis, p_brand AS summary, replace('Titre: ' || p_name || '. Thèse: ' || p_type || '. Résumé: ' || p_brand || '.', '..', '.') AS analysis FROM part")
def parse_analysis(spark, sf_dir):
    made = R.analysis_column(F.col("p_name"), F.col("p_type"), F.col("p_brand"))
    read = table(spark, sf_dir, "part").select("p_partkey", made.alias("analysis"))
    return read.select("p_partkey", "analysis", R.parse_analysis(F.col("analysis"), F.lit("")).alias("a")).select("p_partkey", "analysis", "a.*")


@query(
    """SELECT n_nationkey::BIGINT AS id, CASE n_nationkey + 380 WHEN 383 THEN 'BIBLE – LOCKE – DDHC 1789' ELSE
              CASE n_nationkey % 3 WHEN 0 THEN 'PLINE l’Ancien' WHEN 1 THEN 'André GIDE' ELSE n_name END END AS author FROM nation"""
)
def lookup_authors(spark, sf_dir):
    k = F.col("n_nationkey")
    raw = F.when(k % 3 == 0, "Pline l'ancien").when(k % 3 == 1, "Gidé").otherwise(F.col("n_name"))
    return table(spark, sf_dir, "nation").select(k.cast("long").alias("id"), R.display_author(raw, k + 380).alias("author"))


@query(
    f"""WITH w AS (SELECT n, unnest([n, upper(n), replace(n, {_Q}, '’'), n || ' ']) AS said FROM (SELECT unnest({_NOTIONS}) AS n))
        SELECT r_regionkey::BIGINT AS k, said, n AS official FROM w, region WHERE r_regionkey < 2"""
)
def official_notions(spark, sf_dir):
    n = lambda x: F.array(x, F.upper(x), F.replace(x, F.lit("'"), F.lit("’")), F.concat(x, F.lit(" ")))
    said = F.explode(F.flatten(F.transform(F.array(*map(F.lit, fixed.NOTIONS)), n)))
    words = table(spark, sf_dir, "region").where("r_regionkey < 2").select(F.col("r_regionkey").cast("long").alias("k"), said.alias("said"))
    return words.select("k", "said", R.official_notion(F.col("said")).alias("official"))


@query(
    """SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '' THEN 999 ELSE left(o_orderpriority, 1)::BIGINT END AS id, 999::BIGINT AS no_id, o_orderkey AS file_number, o_orderkey AS route FROM orders"""
)
def leading_numbers(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", T.leading_id(F.col("o_orderpriority")).alias("id"), T.leading_id(F.concat(F.lit(" 0"), F.lit("x"))).alias("no_id"),
        T.file_number(F.concat(key, F.lit(".NAME_Theme"))).alias("file_number"), T.route_id(F.concat(F.lit("#text-"), key)).alias("route"),
    )


@query("SELECT d.doc_id, coalesce(l.quality, -1)::BIGINT AS quality, coalesce(l.toxic, -1)::BIGINT AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def lookup_left_coalesce(spark, sf_dir):
    found = catalog.lookup(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), key="doc_id", values={"quality": -1, "toxic": -1})
    return found.select("doc_id", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic"))


@query("SELECT d.doc_id, d.source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def semi_existing(spark, sf_dir):
    return catalog.existing(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_unmatched(spark, sf_dir):
    return catalog.unmatched(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT p_partkey, t.term FROM part, (VALUES ('ring'), ('small'), ('promo')) t(term) WHERE contains(lower(p_type), t.term)")
def theta_contains(spark, sf_dir):
    return catalog.holding(table(spark, sf_dir, "part"), F.lower("p_type"), ("ring", "small", "promo")).select("p_partkey", "term")


_SEED_KEY = sql_key("p_brand", False) + " || '/' || regexp_replace(" + sql_key("p_name", False) + ", '(c|court|complet|introduction|intro)$', '')"


@query(
    f"""WITH f AS (SELECT p_partkey, p_size, p_name, {_SEED_KEY} AS k, p_partkey || '.' || p_brand || '_' || p_name AS filename FROM part),
             s AS (SELECT k, arg_max(p_name, p_partkey) AS title FROM f WHERE p_size < 20 GROUP BY k),
             g AS (SELECT k, arg_min(p_name, (p_partkey, filename)) AS title FROM f WHERE p_size >= 35 GROUP BY k)
        SELECT p_partkey AS id, filename, CASE WHEN s.k IS NOT NULL THEN 'seed' WHEN g.k IS NOT NULL THEN 'generated' ELSE 'failed' END AS origin,
               coalesce('seed ' || s.title, 'made ' || g.title, replace(p_name, ' ', '')) AS title
        FROM f LEFT JOIN s USING (k) LEFT JOIN g USING (k)"""
)
def seed_join(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    name = F.concat(F.col("p_partkey").cast("string"), F.lit("."), "p_brand", F.lit("_"), "p_name")
    card = lambda said: [F.concat(F.lit(said), "p_name").alias("title"), F.lit("t").alias("thesis"), F.lit("s").alias("summary"), F.array(F.lit("L'art")).alias("notions")]
    keyed = part.where("p_size < 20").select("p_partkey", R.seed_key(F.col("p_brand"), F.col("p_name")).alias("k"), F.struct(*card("seed ")).alias("c"))
    seeds = keyed.groupBy("k").agg(F.max_by("c", "p_partkey").alias("c")).select("k.*", "c.*")
    made = catalog.seeded(part.select(name.alias("filename")), seeds, part.where("p_size >= 35").select(name.alias("filename"), *card("made ")))
    return made.select("id", "filename", "origin", "title")


@query(
    f"""WITH n AS (SELECT doc_id, coalesce(source, '') AS name, coalesce(text, '') AS text, list_transform(range(0, 6), lambda i: ({_NOTIONS})[((doc_id + i) % 17 + 1)::INT])[1:5] AS five FROM documents),
             g AS (SELECT *, contains({sql_key('name', False)}, 'latechnique') OR contains({sql_key('text', False)}, 'latechnique') AS told FROM n)
        SELECT doc_id, array_to_string(CASE WHEN told THEN five ELSE list_filter(five, lambda x: x <> 'La technique') END, ', ') AS notions FROM g"""
)
def notion_limit5_guard(spark, sf_dir):
    names = F.array(*map(F.lit, fixed.NOTIONS))
    six = F.array(*[F.element_at(names, (F.pmod(F.col("doc_id") + i, F.lit(17)) + 1).cast("int")) for i in range(6)])
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(R.final_notions(six, F.coalesce("source", F.lit("")), text, F.lit("")), ", ").alias("notions"))


@query(
    """WITH first AS (SELECT c_nationkey, min(c_custkey) AS k FROM customer GROUP BY c_nationkey)
       SELECT c.c_custkey AS pos, 'N' || c.c_nationkey AS filename, CASE WHEN f.k IS NOT NULL AND c.c_nationkey < 5 THEN 'second of ' || c.c_nationkey ELSE c.c_name END AS title
       FROM customer c LEFT JOIN first f ON f.k = c.c_custkey
       UNION ALL SELECT 4611686018427387904 + 200 + n_nationkey, 'M' || n_nationkey, 'only ' || n_nationkey FROM nation"""
)
def upsert_rows(spark, sf_dir):
    return catalog.upsert(*upserted(spark, sf_dir), "filename")


def upserted(spark, sf_dir):
    """Customers as catalog rows, and changes of some and additions."""
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.concat(F.lit("N"), "c_nationkey").alias("filename"), F.col("c_name").alias("title"))
    nation = table(spark, sf_dir, "nation").withColumn("n", F.col("n_nationkey").cast("long"))
    changes = lambda rows, at, key, said: rows.select((F.col("n") + at).alias("pos"), F.concat(F.lit(key), "n").alias("filename"), F.concat(F.lit(said), "n").alias("title"))
    some = nation.where("n < 5").join(base.select("filename").distinct(), F.concat(F.lit("N"), "n") == F.col("filename"), "left_semi")
    return base, changes(some, 0, "N", "first of ").unionByName(changes(some, 100, "N", "second of ")).unionByName(changes(nation, 200, "M", "only "))


@query(
    """SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN
       (SELECT min(c_custkey) FROM customer WHERE c_custkey::VARCHAR = 'building' OR lower(c_mktsegment) = 'building')"""
)
def delete_first_match(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").withColumn("id", F.col("c_custkey"))
    return catalog.delete_first(customer, catalog.named("building", "id", "c_mktsegment"), "c_custkey").select("c_custkey", "c_name")


_NEXT = "coalesce(max(CASE WHEN c_custkey >= 50 AND c_custkey < 100 THEN c_custkey END) + 1, 50)"


@query(f"SELECT {_NEXT}::BIGINT AS next_id, {_NEXT} >= 100 AS overflow FROM customer")
def next_id(spark, sf_dir):
    return catalog.next_id(table(spark, sf_dir, "customer"), "c_custkey")


_PAGE_LINE = f"regexp_matches(line, '^{T.PY_SPACE}*(?:[0-9]+{T.PY_SPACE}*/{T.PY_SPACE}*[0-9]+|(?i:page){T.PY_SPACE}+[0-9]+|[0-9]+){T.PY_SPACE}*$')"


@query(f"SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT {_PAGE_LINE}) AS n_kept FROM ({LINES}) GROUP BY doc_id")
def page_lines_filter(spark, sf_dir):
    lines = blocks.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text")
    return lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(~T.page_number_line(F.col("line"))).alias("n_kept"))


@query(
    """SELECT user_id, arg_max(event_type, (w, -first)) AS dominant FROM
       (SELECT user_id, event_type, sum(length(props)) AS w, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY user_id"""
)
def dominant_value(spark, sf_dir):
    return spans.dominant(table(spark, sf_dir, "events"), "user_id", F.col("event_type"), F.length("props"), ["event_id"], "none")


@query(
    """WITH g AS (SELECT item_id, list_distinct(list_transform(range(1, greatest(length(text) - 1, 1)), lambda i: substr(text, i, 3))) AS s FROM benchmark)
       SELECT a.item_id, b.item_id AS next_item, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS similarity
       FROM g a JOIN g b ON b.item_id = a.item_id + 1 WHERE len(a.s) + len(b.s) > 0"""
)
def trigram_jaccard(spark, sf_dir):
    grams = table(spark, sf_dir, "benchmark").select("item_id", T.trigrams(F.col("text")).alias("s"))
    after = grams.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("next_item"), F.col("s").alias("t"))
    both = grams.join(after, "item_id").where(F.size("s") + F.size("t") > 0)
    return both.select("item_id", "next_item", F.round(T.jaccard(F.col("s"), F.col("t")), 6).alias("similarity"))


@query(
    """SELECT o_custkey, o_orderkey, row_number() OVER w AS position, lag(o_orderkey) OVER w AS prev_id, lead(o_orderkey) OVER w AS next_id, count(*) OVER (PARTITION BY o_custkey) AS total,
              lag(o_orderkey) OVER w IS NOT NULL AS has_prev, lead(o_orderkey) OVER w IS NOT NULL AS has_next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"""
)
def prev_next_nav(spark, sf_dir):
    return search.navigate(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"], "o_orderkey")


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id < 9) + 1 AS position, (SELECT max(doc_id) FROM documents WHERE doc_id < 9) AS prev_id, (SELECT min(doc_id) FROM documents WHERE doc_id > 9) AS next_id")
def neighbours_of(spark, sf_dir):
    return search.neighbours(table(spark, sf_dir, "documents"), [F.col("doc_id")], "doc_id", 9)


@query("SELECT doc_id, source FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 20")
def topn_sample(spark, sf_dir):
    return catalog.sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 20)


@query("SELECT p_partkey, array_to_string(list_slice(string_split(p_name, ' '), 1, 5), ', ') AS first_words FROM part")
def limit_five(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.slice(F.split("p_name", " "), 1, 5), ", ").alias("first_words"))
