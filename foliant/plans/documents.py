"""Named queries in document order: blocks, roles, references, alignment, anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import fixed
from foliant.functions import text as T
from foliant.operators import align, blocks, roles
from foliant.plans.catalog import LINES, ORACLE_SQL, QUERIES, query, sql_key, sql_trim
from foliant.runtime import table
from foliant.sources import sinks

__all__ = ["ORACLE_SQL", "QUERIES"]


@query("SELECT conv_id, turn, (count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::BIGINT AS block FROM conversations")
def block_split_running_sum(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("role") == "user").alias("starts"))
    return blocks.split_blocks(turns, "conv_id", "turn", F.col("starts")).select("conv_id", "turn", "block")


@query("SELECT conv_id, turn, coalesce(bool_or(length(text) > 150) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), false) AS in_body FROM conversations")
def sticky_body(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return blocks.sticky(turns, "conv_id", "turn", F.col("n") > 150, "in_body").select("conv_id", "turn", "in_body")


@query(
    f"""WITH l AS ({LINES}),
         m AS (SELECT *, pos = 0 OR NOT coalesce(regexp_matches(line, '^[a-z(]') OR regexp_matches(lag(line) OVER (PARTITION BY doc_id ORDER BY pos), '[,;:-]$'), false) AS new FROM l),
         b AS (SELECT *, (count(*) FILTER (new) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))::BIGINT AS block FROM m)
        SELECT doc_id, block, count(*) AS n_lines, string_agg(line, ' ' ORDER BY pos) AS merged FROM b GROUP BY doc_id, block"""
)
def merge_continuation_lines(spark, sf_dir):
    return blocks.merge_lines(blocks.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "pos", "line")


@query(
    rf"""WITH l AS (SELECT *, regexp_replace(regexp_replace(line, '<[^>]+>', '', 'g'), '^[\s\x{{A0}}\x{{202F}}]+|[\s\x{{A0}}\x{{202F}}]+$', '', 'g') AS c FROM ({LINES})),
         m AS (SELECT *, starts_with(c, '→') AS arrow, starts_with(c, '→') OR regexp_matches(c, '^(?:[«→*]|N\.B\.)') OR NOT (
                   coalesce(regexp_matches(lag(c) OVER (PARTITION BY doc_id ORDER BY pos), '[,;:-]$'), false) OR regexp_matches(c, '^[\p{{Ll}}(\[]') OR regexp_matches(c, '(?i)^(Trad\.|Traduction)')
                   OR NOT (length(c) < 75 AND NOT regexp_matches(c, '[.!?»]$') AND regexp_matches(c, '^[A-ZÀ-Ÿ]')
                           AND NOT regexp_matches(c, '(?i)^(Trad\.|Traduction|Tome|Vol\.|Ed\.|Éd\.|p\.|Page|Chapitre|col\.)'))) AS new FROM l),
         s AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS seg FROM m),
         b AS (SELECT *, CASE WHEN arg_min(arrow, pos) OVER (PARTITION BY doc_id, seg) THEN min(pos) OVER (PARTITION BY doc_id, seg) ELSE pos END AS block,
                      CASE WHEN arrow THEN regexp_replace(line, '^(<b><i>|<b>|<i>)?→(</i></b>|</b>|</i>)?', '→') ELSE line END AS t FROM s)
        SELECT doc_id, block, count(*) AS n_lines, string_agg(t, chr(10) ORDER BY pos) AS merged FROM b GROUP BY doc_id, block"""
)
def merge_reference_lines(spark, sf_dir):
    return blocks.merge_references(blocks.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "pos", "line")


#: The state machine itself: an arrow starts a reference, short lines go on with one.
@query(
    """WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, turn, contains(text, '?') AS arrow, length(text) < 200 AS goes_on FROM conversations),
         r AS (SELECT conv_id, i, turn, arrow AS ref FROM t WHERE i = 1
               UNION ALL SELECT t.conv_id, t.i, t.turn, t.arrow OR (r.ref AND t.goes_on) FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1)
       SELECT conv_id, turn, ref AS is_reference FROM r"""
)
def reference_runs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    out = roles.reference_runs(turns, "conv_id", "turn", F.col("text").contains("?"), F.length("text") < 200)
    return out.select("conv_id", "turn", "is_reference")


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_TEXT = "plain"
for _name, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", T.NBSP), ("&rarr;", "→"), ("&#8594;", "→"), ("&amp;", "&")):
    _TEXT = f"replace({_TEXT}, {_q(_name)}, {_q(_char)})"
#: Patterns of the tests, as SQL has them.
_BLANK = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_ARROW = rf"^(?:{_BLANK})*(?:[→🡪🡺\x{{2190}}-\x{{21FF}}\x{{2B00}}-\x{{2BFF}}\x{{1F800}}-\x{{1F8FF}}]|&rarr;|&#8594;)"
_ROMAN, _AUDIT_ROMAN = "(?i)^[ivxlcdm]+(?:[^A-Za-z0-9_]|$)", r"(?i)^[ivxlcdm]+(?:[^\p{L}\p{N}_]|$)"
_CENTURY = rf"(?i)^[i|vxlcdm]+(?:e|ème|°|er)?{_BLANK}+(?:siècle|s(?:[^A-Za-z0-9_]|$))"
_LINE = rf"^l(?:\.(?:{_BLANK}|[0-9]|$)|{_BLANK}+[0-9]|{_BLANK}+[ivxlcdm])"
_LAST = lambda names: f"coalesce(list_max([j FOR j IN range(1, len(st) + 1) IF st[j].n IN ({names})]), 0)"


def blocks_sql(pages: str = "SELECT page_id, html FROM pages") -> str:
    """The leaf blocks of html as a walk over its tags with a stack of open containers."""
    return rf"""
    toks AS (SELECT page_id, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM (SELECT page_id,
                 regexp_extract_all(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|</?[a-z](?:[^>"'']|"[^"]*"|''[^'']*'')*>|[^<]+|<', 0) AS x FROM ({pages}))),
    named AS (SELECT page_id, i, t, lower(regexp_extract(t, '^<(/?[A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM toks),
    alone AS (SELECT page_id, i, lead(tag) OVER (PARTITION BY page_id ORDER BY i) AS after FROM named WHERE tag <> ''),
    tags AS (SELECT page_id, i, tag, ltrim(tag, '/') AS name, starts_with(tag, '/') AS closing, regexp_matches(t, '(?is)^<li\s(?:[^>]*\s)?id\s*=\s*["'']?footnote') AS item,
                    regexp_matches(t, '(?is)^<[a-z][^>]*\sclass\s*=\s*(?:"(?:[^"]*\s)?footnotes(?:\s[^"]*)?"|''(?:[^'']*\s)?footnotes(?:\s[^'']*)?''|footnotes[\s>])') AS noted,
                    lead(i) OVER o AS until, lead(tag) OVER o AS bound, row_number() OVER o AS k
             FROM named WHERE regexp_matches(tag, '^/?(?:p|h[1-6]|table|ul|ol|li|div|section|aside|footer|article|address|blockquote|body|center|dd|details|dialog|dl|dt|fieldset|figcaption|figure|form|header|hr|html|main|menu|nav|pre|summary|tbody|td|tfoot|th|thead|tr)$')
             WINDOW o AS (PARTITION BY page_id ORDER BY i)),
    opened AS (SELECT page_id, 0::BIGINT AS k, []::STRUCT(n VARCHAR, place BIGINT, note BOOLEAN)[] AS st FROM ({pages})
               UNION ALL
               SELECT page_id, k, CASE WHEN name NOT IN ('table', 'ul', 'ol', 'li', 'div', 'section', 'aside', 'footer', 'article') THEN st
                                       WHEN name = 'li' THEN list_concat(CASE WHEN li > lst AND li > tab THEN st[1:li - 1] ELSE st END, CASE WHEN closing THEN [] ELSE [{{'n': name, 'place': i, 'note': item OR noted}}] END)
                                       WHEN NOT closing THEN list_concat(st, [{{'n': name, 'place': i, 'note': noted}}])
                                       WHEN own > tab OR (name = 'table' AND tab > 0) THEN st[1:own - 1] ELSE st END
               FROM (SELECT w.st, t.*, {_LAST("'li'")} AS li, {_LAST("'ul', 'ol'")} AS lst, {_LAST("'table'")} AS tab, {_LAST("t.name")} AS own
                     FROM opened w JOIN tags t ON t.page_id = w.page_id AND t.k = w.k + 1)),
    within AS (SELECT t.page_id, t.i, t.tag, t.until, t.bound, t.item, len([s FOR s IN st IF s.n IN ('table', 'ul', 'ol', 'li')]) > 0 AS box, len([s FOR s IN st IF s.note]) > 0 AS noted, [s.place FOR s IN st IF s.n = 'ol'] AS lists
               FROM tags t JOIN opened w ON w.page_id = t.page_id AND w.k = t.k),
    held AS (SELECT DISTINCT page_id, unnest(lists) AS place FROM within WHERE item),
    found AS (SELECT w.page_id, w.i, w.tag, w.box, w.noted OR EXISTS (SELECT 1 FROM held h WHERE h.page_id = w.page_id AND list_contains(w.lists, h.place)) AS notes,
                     CASE WHEN w.bound = '/' || w.tag THEN a.after ELSE w.bound END AS nt, w.until
              FROM within w LEFT JOIN alone a ON a.page_id = w.page_id AND a.i = w.until WHERE regexp_matches(w.tag, '^(?:p|h[1-6])$')),
    b0 AS (SELECT f.page_id, f.i, f.tag, f.box, f.notes, f.nt, coalesce(string_agg(n.t, '' ORDER BY n.i), '') AS inner_html, coalesce(string_agg(n.t, '' ORDER BY n.i) FILTER (NOT regexp_matches(n.t, '(?s)^<.')), '') AS plain
           FROM found f LEFT JOIN named n ON n.page_id = f.page_id AND n.i > f.i AND n.i < coalesce(f.until, 1000000000) GROUP BY ALL),
    b AS (SELECT page_id, row_number() OVER o - 1 AS pos, box, notes, CASE WHEN starts_with(nt, '/') THEN NULL ELSE nt END AS nt, tag, inner_html, {sql_trim(_TEXT)} AS text, count(*) OVER (PARTITION BY page_id) - 1 AS last
          FROM b0 WINDOW o AS (PARTITION BY page_id ORDER BY i))"""


def _sql_edges(x: str) -> str:
    return sql_trim(f"regexp_replace({x}, {_q(f'^{T.EDGES}+|{T.EDGES}+$')}, '', 'g')")


def _sql_starts(x: str, words) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {_q(w)})" for w in words) + ")"


def _sql_capitals(x: str) -> str:
    return f"({x} = upper({x}) AND regexp_matches({x}, '[A-ZÀ-Ÿ]'))"


def _sql_strong(t: str) -> str:
    opens = rf"<{t}(?:\s[^>]*)?>"
    return rf"(regexp_matches(inner_html, '(?is)^\s*{opens}.*</{t}\s*>\s*$') AND len(regexp_extract_all(inner_html, '(?i){opens}')) = 1)"


_AFTER = f"regexp_replace(text, {_q(f'^(?:{T.EDGES}|[+~≈-])+')}, '')"
_GOES_ON = f"""(left({_AFTER}, 1) = lower(left({_AFTER}, 1)) AND left({_AFTER}, 1) <> upper(left({_AFTER}, 1)) OR {_sql_starts(f'lower({_AFTER})', fixed.REFERENCE_WORDS + fixed.PUBLISHERS)}
    OR regexp_matches({_AFTER}, '^[0-9]{{4}}') OR regexp_matches({_AFTER}, {_q(_CENTURY)}) OR regexp_matches({_AFTER}, {_q(_ROMAN)}) OR regexp_matches(lower({_AFTER}), {_q(_LINE)})
    OR starts_with({sql_trim('inner_html')}, '<em>'))"""
_TITLE = _sql_edges(sql_trim(f"regexp_replace(text, {_q(rf'(?i){T.SPACE}*[\[(][0-9]+[a-f]?[\])]{T.SPACE}*$')}, '')"))
_TITLE_LIKE = f"(regexp_matches({_TITLE}, '^[a-zA-Z0-9À-ÿŒœ]') AND length({_TITLE}) <= 100 AND NOT regexp_matches({_TITLE}, '[.!?;:]$') AND NOT {_sql_starts(f'lower({_TITLE})', fixed.TITLE_EXCLUDES)})"
_BARE = _sql_edges("text")
_NAME = r"^(?:[\p{L}’'-]|" + T.SPACE + ")+$"


def _reader_sql(pages: str = "SELECT page_id, html FROM pages") -> str:
    return rf"""WITH RECURSIVE {blocks_sql(pages)},
    live AS (SELECT *, ((starts_with(text, '[') AND ends_with(text, ']')) OR (starts_with(text, '(') AND ends_with(text, ')'))) AS direction, {_sql_strong('strong')} OR {_sql_strong('b')} AS strong,
                    row_number() OVER (PARTITION BY page_id ORDER BY pos) AS i FROM b WHERE NOT notes AND NOT box AND text <> ''),
    said AS (SELECT *, NOT direction AND length({_BARE}) BETWEEN 1 AND 34 AND NOT strong AND {_sql_capitals(_BARE)} AND regexp_matches({_BARE}, {_q(_NAME)}) AS speaker FROM live),
    facts AS (SELECT *, regexp_matches(text, {_q(_ARROW)}) AS arrow, {_GOES_ON} AS goes_on, regexp_matches(text, {_q(f'^{_BLANK}*«')}) OR length(text) > 150 OR speaker OR direction AS starts,
                     tag <> 'p' OR strong OR ({_TITLE_LIKE} AND pos <> last AND coalesce(nt NOT IN ('ol', 'ul'), true)) AS heading FROM said),
    walk AS (SELECT page_id, i, starts AS body, NOT speaker AND NOT direction AND arrow AS ref, ends_with(text, ',') AS comma FROM facts WHERE i = 1
             UNION ALL SELECT f.page_id, f.i, w.body OR f.starts, NOT f.speaker AND NOT f.direction AND (f.arrow OR (w.ref AND (w.comma OR f.goes_on))), ends_with(f.text, ',')
             FROM walk w JOIN facts f ON f.page_id = w.page_id AND f.i = w.i + 1),
    told AS (SELECT f.*, CASE WHEN speaker THEN 'dialogue-speaker' WHEN direction THEN 'dialogue-direction' WHEN ref THEN 'reference' WHEN NOT body THEN 'title' WHEN heading THEN 'subheading' ELSE 'paragraph' END AS role
             FROM facts f JOIN walk w USING (page_id, i))
    SELECT page_id, pos, text, role, role = 'subheading' AND {_sql_capitals(_BARE)} AND length({_BARE}) < 50 AS centered FROM told
    UNION ALL SELECT page_id, pos, text, 'simple', false FROM b WHERE NOT notes AND box"""


@query(_reader_sql())
def html_block_roles(spark, sf_dir):
    return roles.roles(roles.html_blocks(table(spark, sf_dir, "pages"), "page_id"), "page_id")


#: Html that a line (?) turns into, by its number: lists, tables and sections within each other, items and paragraphs without end tags, notes.
_NESTED = (
    "<h2>?</h2>", "<ul><li><p>?</p><ol><li>one<p>?</p></li><li>two</ol><p>?</p></li></ul>", "<p>?</p>",
    "<table><tr><td><table><tr><td><p>?</p></td></tr></table><p>?</p></td></tr></table>", "<p>?",
    '<ol><li><ol><li id="footnote-1"><p>?</p></li></ol><p>?</p></li></ol>', "<p>?</p><ol><li>one</ol>",
    '<div class="x footnotes"><p>?</p><div><p>?</p></div></div></ul>',
)
_NESTED_SQL = f"""SELECT doc_id AS page_id, string_agg(replace([{', '.join(map(_q, _NESTED))}][pos % {len(_NESTED)} + 1], '?', regexp_replace(line, '[<>&]', '', 'g')), '' ORDER BY pos) AS html FROM ({LINES}) GROUP BY doc_id"""


@query(_reader_sql(_NESTED_SQL).replace("SELECT page_id, pos, text, role,", "SELECT page_id AS doc_id, pos, text, role,"))
def nested_block_roles(spark, sf_dir):
    """The lines of documents as bodies of nested containers."""
    forms = F.array(*map(F.lit, _NESTED))
    line = lambda x, i: F.replace(F.element_at(forms, (i % len(_NESTED) + 1).cast("int")), F.lit("?"), F.regexp_replace(x, "[<>&]", ""))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    bodies = docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), line), "").alias("html"))
    return roles.roles(roles.html_blocks(bodies, "doc_id"), "doc_id")


_AUDIT_GOES_ON = _GOES_ON.replace(_q(_ROMAN), _q(_AUDIT_ROMAN)).replace(_q(_CENTURY), _q(rf"(?i)^[ivxlcdm]+(?:e|ème|°|er)?{T.PY_SPACE}+(?:siècle|s(?:[^\p{{L}}\p{{N}}_]|$))"))
_AUDIT_GOES_ON = _AUDIT_GOES_ON.replace(f"starts_with({sql_trim('inner_html')}, '<em>')", f"regexp_matches({sql_trim('inner_html')}, '^<(?:em|i)[ >]')")


def audit_sql(pages: str = "SELECT page_id, html FROM pages") -> str:
    """Blocks as the audit sees them: page_id, pos, text, role, has_bold, has_italic."""
    return rf"""WITH RECURSIVE {blocks_sql(pages)},
    live AS (SELECT *, {_sql_strong('strong')} OR {_sql_strong('b')} AS strong, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS i FROM b WHERE NOT notes AND NOT box AND text <> ''),
    facts AS (SELECT *, regexp_matches(text, {_q(_ARROW)}) AS arrow, {_AUDIT_GOES_ON} AS goes_on, tag <> 'p' OR strong OR ({_TITLE_LIKE} AND coalesce(nt NOT IN ('ol', 'ul'), true)) AS heading,
                     text = upper(text) AND regexp_matches(text, '\p{{Lu}}') AS capitals FROM live),
    walk AS (SELECT page_id, i, arrow AS after, heading AND NOT arrow AS found, CASE WHEN arrow THEN 'reference' WHEN heading THEN 'title' ELSE 'paragraph' END AS role FROM facts WHERE i = 1
             UNION ALL SELECT f.page_id, f.i, f.arrow OR (w.after AND f.goes_on), w.found OR (f.heading AND NOT (f.arrow OR (w.after AND f.goes_on))),
                    CASE WHEN f.arrow OR (w.after AND f.goes_on) THEN 'reference' WHEN f.heading THEN CASE WHEN NOT w.found OR w.after OR f.capitals THEN 'title' ELSE 'subheading' END ELSE 'paragraph' END
             FROM walk w JOIN facts f ON f.page_id = w.page_id AND f.i = w.i + 1)
    SELECT page_id, pos, text, role, regexp_matches(inner_html, '(?i)<(?:b|strong)[ >]') AS has_bold, regexp_matches(inner_html, '(?i)<(?:i|em)[ >]') AS has_italic FROM facts JOIN walk USING (page_id, i)
    UNION ALL SELECT page_id, pos, text, 'simple', regexp_matches(inner_html, '(?i)<(?:b|strong)[ >]'), regexp_matches(inner_html, '(?i)<(?:i|em)[ >]') FROM b WHERE NOT notes AND box"""


@query(f"SELECT page_id, pos, role, has_bold, has_italic FROM ({audit_sql()})")
def audit_block_roles(spark, sf_dir):
    return roles.audit_roles(roles.html_blocks(table(spark, sf_dir, "pages"), "page_id"), "page_id").select("page_id", "pos", "role", "has_bold", "has_italic")


def _sides(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), "role", "text")
    return turns, turns.where("role = 'assistant'")


_GRAMS = "list_distinct(list_transform(range(1, greatest(length(k) - 1, 1)), lambda i: substr(k, i, 3)))"
_SCORE = """CASE WHEN l.k = r.k THEN 1.0 WHEN contains(l.k, r.k) OR contains(r.k, l.k) THEN least(length(l.k), length(r.k)) / greatest(length(l.k), length(r.k))::DOUBLE
    WHEN len(l.g) > 0 AND len(r.g) > 0 THEN len(list_intersect(l.g, r.g)) / len(list_distinct(list_concat(l.g, r.g)))::DOUBLE ELSE 0.0 END"""


def greedy_sql(left: str, right: str) -> str:
    """The walk of left blocks (doc, pos, text) along right blocks, as common tables; ``met`` has doc, left_pos, right_pos, score."""
    return f"""l AS (SELECT doc, pos, k, {_GRAMS} AS g, row_number() OVER (PARTITION BY doc ORDER BY pos) AS i FROM (SELECT doc, pos, {sql_key("coalesce(text, '')")} AS k FROM ({left})) WHERE k <> ''),
         r AS (SELECT doc, pos, k, {_GRAMS} AS g, row_number() OVER (PARTITION BY doc ORDER BY pos) AS j FROM (SELECT doc, pos, {sql_key("coalesce(text, '')")} AS k FROM ({right}))),
         s AS (SELECT l.doc, l.i, l.pos AS left_pos, r.j, r.pos AS right_pos, {_SCORE} AS score FROM l JOIN r USING (doc)),
         w AS (SELECT DISTINCT doc, 0::BIGINT AS i, 0::BIGINT AS reached, NULL::BIGINT AS right_pos, 0.0::DOUBLE AS score FROM l
               UNION ALL SELECT w.doc, w.i + 1, CASE WHEN max(s.score) > 0.4 THEN arg_max(s.j, (s.score, -s.j)) ELSE w.reached END,
                                CASE WHEN max(s.score) > 0.4 THEN arg_max(s.right_pos, (s.score, -s.j)) END, coalesce(max(s.score), 0.0)
               FROM w JOIN l ON l.doc = w.doc AND l.i = w.i + 1 LEFT JOIN s ON s.doc = w.doc AND s.i = w.i + 1 AND s.j > w.reached AND s.j <= w.reached + 6 GROUP BY w.doc, w.i, w.reached),
         met AS (SELECT w.doc, l.pos AS left_pos, w.right_pos, w.score FROM w JOIN l ON l.doc = w.doc AND l.i = w.i)"""


_TURNS = "SELECT conv_id AS doc, turn AS pos, text FROM conversations"
_ANSWERS = f"{_TURNS} WHERE role = 'assistant'"


@query(f"WITH RECURSIVE {greedy_sql(_TURNS, _ANSWERS)} SELECT doc, left_pos, right_pos, round(score, 6) AS score FROM met")
def greedy_align(spark, sf_dir):
    return align.greedy_align(*_sides(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"WITH RECURSIVE {greedy_sql(_TURNS, _ANSWERS)} SELECT doc, left_pos AS pos, length(text) AS n FROM met JOIN ({_TURNS}) t ON t.doc = met.doc AND t.pos = left_pos WHERE right_pos IS NULL".replace("SELECT doc, left_pos AS pos, length", "SELECT met.doc, left_pos AS pos, length"))
def unmatched_turns(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return align.unmatched_left(align.greedy_align(left, right), left).select("doc", "pos", F.length("text").cast("long").alias("n"))


_LEAKS = f"{_ANSWERS} UNION ALL SELECT DISTINCT conv_id, 1000, '3 / ' || conv_id FROM conversations"


@query(
    rf"""WITH RECURSIVE {greedy_sql(_TURNS, _LEAKS)},
         a AS (SELECT met.doc, left_pos, right_pos, length(text) > 10 AS long, contains(text, '!') AS bold, contains(text, '?') AS italic, length(text) < 60 AS title FROM met JOIN ({_TURNS}) t ON t.doc = met.doc AND t.pos = left_pos),
         x AS (SELECT h.doc, h.pos, h.text FROM ({_LEAKS}) h ANTI JOIN a ON a.doc = h.doc AND a.right_pos = h.pos),
         f AS (SELECT 'missing_html_block' AS type FROM a WHERE right_pos IS NULL
               UNION ALL SELECT 'role_mismatch' FROM a WHERE right_pos IS NOT NULL AND title
               UNION ALL SELECT 'indent_mismatch' FROM a WHERE right_pos IS NOT NULL AND NOT title AND left_pos % 2 = 1
               UNION ALL SELECT 'style_mismatch_bold' FROM a WHERE right_pos IS NOT NULL AND bold AND long
               UNION ALL SELECT 'style_mismatch_italic' FROM a WHERE right_pos IS NOT NULL AND italic AND long
               UNION ALL SELECT CASE WHEN regexp_matches(text, '^[0-9]+ / [0-9]+$') THEN 'header_footer_leak' ELSE 'extra_html_block' END FROM x
               UNION ALL SELECT 'footnotes_count_mismatch' FROM (SELECT DISTINCT doc FROM ({_ANSWERS})))
        SELECT type, count(*) AS n FROM f GROUP BY type"""
)
def audit_mismatches(spark, sf_dir):
    """Turns as page blocks, assistant turns and page numbers as html blocks: counts by type."""
    left, right = _sides(spark, sf_dir)
    role = F.when(F.length("text") < 60, "title").otherwise("paragraph")
    marks = [(F.col("pos") % 2 == 0).alias("has_indent"), F.col("text").contains("!").alias("has_bold"), F.col("text").contains("?").alias("has_italic")]
    pages = left.select("doc", "pos", "text", role.alias("role"), *marks)
    leaks = left.select("doc", F.lit(1000).cast("long").alias("pos"), F.concat(F.lit("3 / "), "doc").alias("text")).distinct()
    html = right.select("doc", "pos", "text").unionByName(leaks).select("*", F.lit("paragraph").alias("role"), F.lit(False).alias("has_bold"), F.lit(False).alias("has_italic"))
    return sinks.type_counts(align.mismatches(pages, html, right.select("doc"))).select("type", "n")


_ANOMALY_ROWS = " UNION ALL ".join(f"SELECT page_id, '{name}' AS type, unnest(regexp_extract_all(regexp_replace(html, '{blocks.HIDDEN}', '', 'g'), {_q(rule)}, 0)) AS found FROM pages" for name, rule in blocks.ANOMALIES.items())


def _styled(spark, sf_dir):
    """Documents as bodies of which some have styles and empty paragraphs."""
    line = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.concat(F.when(i % 3 == 1, '<p style="margin:0">').otherwise("<p>"), F.regexp_replace(x, "[<>&]", ""), F.lit("</p>")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.array_join(line, "").alias("html"))


_EMPTY = rf"regexp_matches(line, '^(?:\s|\x{{A0}})*$')"


@query(
    f"""WITH l AS (SELECT doc_id, regexp_replace(line, '[<>&]', '', 'g') AS line, pos FROM ({LINES})),
             a AS (SELECT 'd' || doc_id AS page, 'inline_style' AS type FROM l WHERE pos % 3 = 1 UNION ALL SELECT 'd' || doc_id, 'empty_element' FROM l WHERE {_EMPTY}
                   UNION ALL SELECT 'p' || page_id, type FROM ({_ANOMALY_ROWS}))
        SELECT type, count(*) AS n, count(DISTINCT page) AS n_pages FROM a GROUP BY type"""
)
def anomaly_counts(spark, sf_dir):
    """Of pages, and of documents as bodies with styles."""
    styled = _styled(spark, sf_dir).join(table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc")).distinct(), "doc", "left_semi")
    bodies = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("page"), "html").unionByName(styled.select(F.concat(F.lit("d"), "doc").alias("page"), "html"))
    return blocks.anomalies(bodies, "page", "html").groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("page").alias("n_pages"))


@query(
    f"""WITH l AS (SELECT doc_id, regexp_replace(line, '[<>&]', '', 'g') AS line, pos FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents)),
             a AS (SELECT doc_id, 'inline_style' AS type FROM l WHERE pos % 3 = 1 UNION ALL SELECT doc_id, 'empty_element' FROM l WHERE {_EMPTY})
        SELECT (SELECT count(*) FROM documents) AS n_files, count(DISTINCT doc_id) AS n_files_with, count(*) AS n_anomalies FROM a"""
)
def anomaly_totals(spark, sf_dir):
    bodies = _styled(spark, sf_dir)
    return align.totals(align.markup_anomalies(bodies), bodies)


@query(
    rf"""WITH l AS (SELECT doc_id::VARCHAR AS doc, regexp_replace(line, '[<>&]', '', 'g') AS line, pos FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents)),
             a AS (SELECT doc, 'inline_style' AS type, 'Styles CSS en ligne (Mammoth override)' AS about, 'Style en ligne parasite détecté sur `p` : `style="margin:0"`' AS message, '<p style="margin:0"' AS text FROM l WHERE pos % 3 = 1
                   UNION ALL SELECT doc, 'empty_element', 'Paragraphe vide ou inutile', 'Paragraphe vide `<p>` ou contenant uniquement des espaces.', left(CASE WHEN pos % 3 = 1 THEN '<p style="margin:0">' ELSE '<p>' END || line || '</p>', 80) FROM l WHERE {_EMPTY})
        SELECT unnest(['# Rapport de Diagnostic Visuel Géométrique (PDF vs HTML)', '',
                       'Ce rapport liste les écarts structurels, visuels et typographiques entre les PDF originaux de référence et le formatage final HTML.', '', '## Statistiques', '', '', '---', '',
                       '## Détail des Anomalies par Fichier', '', '### Résumé par Type de Défaut', '', '| Type d''Anomalie | Description | Nombre d''occurrences |', '| --- | --- | --- |', '', '---', '']) AS value
        UNION ALL SELECT '- **Nombre total de fichiers analysés :** ' || count(*) FROM documents
        UNION ALL SELECT unnest(['- **Fichiers avec anomalies détectées :** ' || count(DISTINCT doc), '- **Nombre total d''anomalies :** ' || count(*)]) FROM a
        UNION ALL SELECT '| `' || type || '` | ' || any_value(about) || ' | ' || count(*) || ' |' FROM a GROUP BY type
        UNION ALL SELECT unnest(['### ' || doc, '', 'Nombre d''anomalies : **' || count(*) || '**', '', '| Type | Message | Extrait / Détail |', '| --- | --- | --- |', '']) FROM a GROUP BY doc
        UNION ALL SELECT '| `' || type || '` | ' || message || ' | *' || replace(replace(text, chr(10), ' '), '|', '\|') || '* |' FROM a"""
)
def anomaly_report(spark, sf_dir):
    bodies = _styled(spark, sf_dir)
    found = align.markup_anomalies(bodies)
    return sinks.report(bodies.select("doc"), found)


@query("SELECT page_id, link, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS link FROM pages) GROUP BY ALL")
def footnote_links(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))
    return links.groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query(
    f"""WITH n AS (SELECT conv_id, turn, {sql_trim(f"regexp_replace(regexp_replace(text, '[<>&]', '', 'g'), '{T.SPACE}+', ' ', 'g')")} AS note FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)
        SELECT conv_id AS doc, turn AS number, 'footnote-ref-' || turn AS anchor, note FROM n"""
)
def footnote_pairs(spark, sf_dir):
    from foliant.operators.catalog import footnote_pairs as pairs

    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", F.col("turn").cast("string").alias("n"), "role", F.regexp_replace("text", "[<>&]", "").alias("text"))
    anchor = F.concat(F.lit('<p>x<sup><a href="#footnote-'), "n", F.lit('" id="footnote-ref-'), "n", F.lit('">['), "n", F.lit("]</a></sup></p>"))
    note = F.when(F.col("role") == "assistant", F.concat(F.lit('<ol><li id="footnote-'), "n", F.lit('"><p>'), "text", F.lit("</p></li></ol>")))
    bodies = turns.groupBy(F.col("conv_id").alias("doc")).agg(F.array_join(F.sort_array(F.collect_list(F.concat(anchor, F.coalesce(note, F.lit(""))))), "").alias("html"))
    return pairs(roles.footnote_anchors(bodies), roles.footnote_notes(bodies), "doc").select("doc", "number", "anchor", "note")
