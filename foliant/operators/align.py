"""Alignment of page blocks with html blocks, and the audit of their differences."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.folds import fold_each
from foliant.functions.text import PY_SPACE, excerpt, jaccard, let, match_key, trigrams
from foliant.operators.blocks import anomalies

#: Blocks ahead that are looked at, and the score above which one is taken.
WINDOW, THRESHOLD = 6, 0.4
_COLUMNS = ["doc", "section", "pos", "type", "message", "text", "details"]


def similarity(a: Column, b: Column, grams_a: Column, grams_b: Column) -> Column:
    """1 if keys are equal, the ratio of their lengths if one holds the other, else the Jaccard similarity of their trigrams."""
    longest = F.greatest(F.length(a), F.length(b))
    held = F.when(longest > 0, F.least(F.length(a), F.length(b)) / longest).otherwise(0.0)
    both = (F.size(grams_a) > 0) & (F.size(grams_b) > 0)
    return F.when(a == b, 1.0).when(a.contains(b) | b.contains(a), held).otherwise(F.when(both, jaccard(grams_a, grams_b)).otherwise(0.0))


def _listed(blocks: DataFrame, key: str, pos: str, told: list, name: str) -> DataFrame:
    """key, name: the blocks of a document in order, as structs of their place p and what is told of them."""
    rows = blocks.select(key, F.struct(F.col(pos).cast("long").alias("p"), *told).alias("b"))
    return rows.groupBy(key).agg(F.sort_array(F.collect_list("b")).alias(name))


def _aligned(left: Column, right: Column, keys: Callable[[Column], Column]) -> Column:
    """An array of (i, j, score): the places in the list ``left`` of blocks with a key, those in ``right`` of their matches, or null. ``keys`` tells a block's key."""
    kind = "struct<i:int,j:int,score:double>"
    ahead = F.array(*map(F.lit, range(WINDOW)))

    def keyed(blocks: Column) -> Column:
        # trigrams are made here, of one document at a time: they are too large to be shuffled
        return F.transform(blocks, lambda x, i: let(keys(x), lambda k: F.struct(i.alias("i"), k.alias("k"), trigrams(k).alias("g"))))

    def walk(right: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            # by index: a slice of a row's array would copy the whole array
            score = lambda y: F.when(y.isNotNull(), similarity(x["k"], y["k"], x["g"], y["g"]).cast("double"))
            scores = F.transform(ahead, lambda j: let(F.get(right, state["at"] + j), score))

            def place(s: Column) -> Column:
                best = F.coalesce(F.array_max(s), F.lit(0.0))
                j = F.when(best > THRESHOLD, F.array_position(s, best).cast("int") + state["at"] - 1)
                told = F.struct(x["i"].alias("i"), j.alias("j"), best.alias("score"))
                return F.struct(F.coalesce(j + 1, state["at"]).alias("at"), told.alias("told"))

            return let(scores, place)

        zero = F.struct(F.lit(0).alias("at"), F.lit(None).cast(kind).alias("told"))
        return fold_each(F.filter(keyed(left), lambda x: x["k"] != ""), zero, step, lambda state: state["told"], kind)

    return let(keyed(right), walk)


def greedy_align(left: DataFrame, right: DataFrame, key: str = "doc", pos: str = "pos", text: str = "text") -> DataFrame:
    """key, left_pos, right_pos (null: none), score: each left block, in order, with the best of the next six right blocks.

    A match moves on the place from which the next is sought; of equal scores
    the earliest wins. Left blocks without a key (no a-z or digit) give no row.
    The blocks of one document are one row while they are aligned, in time linear in their number.
    """
    told = [match_key(F.coalesce(text, F.lit(""))).alias("k")]
    both = _listed(left, key, pos, told, "l").join(_listed(right, key, pos, told, "r"), key, "left")
    l, r = F.col("l"), F.coalesce("r", F.array().cast("array<struct<p:bigint,k:string>>"))
    places = lambda x: F.struct(F.get(l, x["i"])["p"].alias("left_pos"), F.get(r, x["j"])["p"].alias("right_pos"), x["score"].alias("score"))
    pairs = F.transform(_aligned(l, r, lambda b: b["k"]), places)
    return both.select(key, F.explode(pairs).alias("x")).select(key, "x.*")


def unmatched_right(pairs: DataFrame, right: DataFrame, key: str = "doc", pos: str = "pos") -> DataFrame:
    """Right blocks that no left block was matched with."""
    taken = pairs.where("right_pos IS NOT NULL").select(key, F.col("right_pos").alias(pos))
    return right.join(taken, [key, pos], "left_anti")


def unmatched_left(pairs: DataFrame, left: DataFrame, key: str = "doc", pos: str = "pos") -> DataFrame:
    """Left blocks that were matched with none."""
    return left.join(pairs.where("right_pos IS NULL").select(key, F.col("left_pos").alias(pos)), [key, pos], "left_semi")


def _differences(a: Column, b: Column) -> list[tuple]:
    """(condition, type, message, text, details) of what may differ in a page block and the html block it was matched with, null if none."""
    met = b.isNotNull() & ~((b["role"] == "simple") & a["role"].isin("paragraph", "footnote"))
    text, short = a["text"], excerpt(a["text"], 80)
    said = F.concat(F.lit("Écart d'alignement visuel : PDF attend '"), a["role"], F.lit("' vs HTML affiche '"), b["role"], F.lit("'."))
    nothing = F.lit(None).cast("string")
    parts = [
        (b.isNull(), "missing_html_block", F.lit("Bloc présent dans le PDF mais absent du HTML (texte manquant)."), excerpt(text, 100), nothing),
        (met & (a["role"] != b["role"]), "role_mismatch", said, short, F.concat(F.lit("PDF="), a["role"], F.lit(" | HTML="), b["role"])),
        (met & (a["role"] == "paragraph") & (b["role"] == "paragraph") & ~a["has_indent"], "indent_mismatch", F.lit("Écart d'alinéa : PDF=sans retrait vs HTML=retrait."), short, nothing),
    ]
    for style, name in (("bold", "Gras"), ("italic", "Italique")):
        lacks = met & a[f"has_{style}"] & ~b[f"has_{style}"] & (F.length(text) > 10)
        parts.append((lacks, f"style_mismatch_{style}", F.lit(f"{name} manquant dans le HTML."), short, nothing))
    return parts


def _extra(text: Column) -> tuple[Column, Column, Column]:
    """type, message, text of an html block that no page block was matched with."""
    leak = text.rlike(rf"^(?:[0-9]+{PY_SPACE}*/{PY_SPACE}*[0-9]+|(?i:page){PY_SPACE}+[0-9]+)$")
    message = F.when(leak, "Fuite d'en-tête ou de pied de page visible dans le HTML.").otherwise("Bloc de texte présent en HTML mais absent du PDF.")
    return F.when(leak, "header_footer_leak").otherwise("extra_html_block"), message, F.when(leak, text).otherwise(excerpt(text, 80))


def _note_counts(a: Column, b: Column) -> tuple[Column, Column]:
    """message, text where the numbers of notes differ."""
    a, b = a.cast("string"), b.cast("string")
    return F.concat(F.lit("Écart notes : PDF a "), a, F.lit(" note(s) vs HTML a "), b, F.lit(" note(s).")), F.concat(F.lit("PDF="), a, F.lit(" | HTML="), b)


def _told(rows: DataFrame, section: int, kind, message, text: Column, details: Column | None = None) -> DataFrame:
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    nothing = F.lit(None).cast("string")
    return rows.select("doc", F.lit(section).alias("section"), F.col("pos").cast("long").alias("pos"), column(kind).alias("type"), column(message).alias("message"), text.alias("text"), (nothing if details is None else details).alias("details"))


def mismatches(page_blocks: DataFrame, html_blocks: DataFrame, html_notes: DataFrame | None = None) -> DataFrame:
    """doc, section, pos, type, message, text, details: what page blocks and html blocks (of ``audit_roles``) differ in.

    Page blocks have doc, pos, text, role, has_indent, has_bold, has_italic;
    ``html_notes`` (doc) a row for each footnote of the html. A simple html block
    for a paragraph or footnote is no mismatch, whatever its style.
    """
    pairs = greedy_align(page_blocks, html_blocks)
    a = page_blocks.select("doc", F.col("pos").alias("left_pos"), F.struct("text", "role", "has_indent", "has_bold", "has_italic").alias("a"))
    b = html_blocks.select("doc", F.col("pos").alias("right_pos"), F.struct("role", "has_bold", "has_italic").alias("b"))
    rows = pairs.join(a, ["doc", "left_pos"]).join(b, ["doc", "right_pos"], "left").withColumnRenamed("left_pos", "pos")
    parts = [_told(rows.where(found), 1, kind, message, text, details) for found, kind, message, text, details in _differences(F.col("a"), F.col("b"))]
    parts.append(_told(unmatched_right(pairs, html_blocks), 2, *_extra(F.col("text"))))
    if html_notes is not None:
        parts.append(footnote_counts(page_blocks, html_notes, html_blocks))
    return reduce(DataFrame.unionByName, parts)


def footnote_counts(page_blocks: DataFrame, html_notes: DataFrame, html_blocks: DataFrame) -> DataFrame:
    """Documents whose pages and html have different numbers of footnotes, as anomalies."""
    docs = page_blocks.select("doc").unionByName(html_blocks.select("doc")).distinct()
    n = lambda df, name: df.groupBy("doc").agg(F.count("*").alias(name))
    rows = docs.join(n(page_blocks.where("role = 'footnote'"), "a"), "doc", "left").join(n(html_notes, "b"), "doc", "left").fillna(0, ["a", "b"]).where("a <> b").withColumn("pos", F.lit(0))
    return _told(rows, 3, "footnotes_count_mismatch", *_note_counts(F.col("a"), F.col("b")))


def mismatches_by_document(page_blocks: DataFrame, html_blocks: DataFrame, html_notes: DataFrame) -> DataFrame:
    """``mismatches`` of blocks whose places occur once in a document, each told while all blocks of its document are one row.

    Blocks are read and shuffled once, or not at all where they lie by document.
    """
    l = _listed(page_blocks.where("doc IS NOT NULL"), "doc", "pos", ["text", "role", "has_indent", "has_bold", "has_italic"], "l")
    r = _listed(html_blocks, "doc", "pos", ["text", "role", "has_bold", "has_italic"], "r")
    # numbers of notes meet both sides before these meet: what a full join gives doesn't lie by document any more
    notes = html_notes.groupBy("doc").agg(F.count("*").cast("int").alias("n"))
    both = l.join(notes.withColumnRenamed("n", "nl"), "doc", "left").join(r.join(notes.withColumnRenamed("n", "nr"), "doc", "left"), "doc", "full_outer")
    nothing = lambda name: F.coalesce(name, F.array().cast(both.schema[name].dataType))
    both = both.select("doc", nothing("l").alias("l"), nothing("r").alias("r"), F.coalesce("nl", "nr", F.lit(0)).alias("n"))
    l, r, no_details = F.col("l"), F.col("r"), F.lit(None).cast("string")

    def one(section: int, pos: Column, kind: Column, message: Column, text: Column, details: Column) -> Column:
        fields = {"section": F.lit(section), "pos": pos, "type": kind, "message": message, "text": text, "details": details}
        return F.struct(*[c.alias(name) for name, c in fields.items()])

    def differences(a: Column, b: Column) -> Column:
        found = [F.when(when, one(1, a["p"], F.lit(kind), *said)) for when, kind, *said in _differences(a, b)]
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    def told(pairs: Column) -> Column:
        matched = F.transform(pairs, lambda x: let(F.get(l, x["i"]), lambda a: let(F.get(r, x["j"]), lambda b: differences(a, b))))
        taken = F.transform(F.filter(pairs, lambda x: x["j"].isNotNull()), lambda x: x["j"])
        left = F.array_except(F.filter(F.sequence(F.lit(0), F.size(r)), lambda j: j < F.size(r)), taken)
        extra = F.transform(left, lambda j: let(F.get(r, j), lambda b: one(2, b["p"], *_extra(b["text"]), no_details)))
        return F.concat(F.flatten(matched), extra)

    notes = F.size(F.filter("l", lambda x: x["role"] == "footnote"))
    counts = F.filter(F.array(F.when(notes != F.col("n"), one(3, F.lit(0).cast("long"), F.lit("footnotes_count_mismatch"), *_note_counts(notes, F.col("n")), no_details))), lambda x: x.isNotNull())
    found = F.concat(let(_aligned(l, r, lambda b: match_key(F.coalesce(b["text"], F.lit("")))), told), counts)
    return both.select("doc", F.explode(found).alias("x")).select("doc", "x.*")


def markup_anomalies(bodies: DataFrame, html: str = "html") -> DataFrame:
    """doc, section, pos, type, message, text, details: empty paragraphs and elements with a style, one row each."""
    found = anomalies(bodies, "doc", html).withColumn("pos", F.monotonically_increasing_id())
    name = F.lower(F.regexp_extract("found", "^<([A-Za-z0-9]+)", 1))
    style = F.regexp_replace(F.regexp_extract("found", r"""(?is)\sstyle\s*=\s*("[^"]*"|'[^']*'|[^\s>"']*)$""", 1), "^[\"']|[\"']$", "")
    styled = F.concat(F.lit("Style en ligne parasite détecté sur `"), name, F.lit('` : `style="'), style, F.lit('"`'))
    message = F.when(F.col("type") == "inline_style", styled).otherwise("Paragraphe vide `<p>` ou contenant uniquement des espaces.")
    return _told(found, 0, F.col("type"), message, excerpt(F.col("found"), 80))


def audit(page_blocks: DataFrame, bodies: DataFrame) -> DataFrame:
    """All anomalies of documents: of the markup of bodies (doc, html), and against page blocks; ``report`` takes these."""
    from foliant.operators.roles import audit_roles, footnote_notes, html_blocks

    blocks = audit_roles(html_blocks(bodies))
    found = markup_anomalies(bodies).unionByName(mismatches_by_document(page_blocks, blocks, footnote_notes(bodies)))
    return found.withColumn("pos", F.struct("section", "pos", "type"))


def totals(anomalies_: DataFrame, files: DataFrame) -> DataFrame:
    """n_files, n_files_with, n_anomalies."""
    return files.agg(F.count("*").alias("n_files")).crossJoin(anomalies_.agg(F.count_distinct("doc").alias("n_files_with"), F.count("*").alias("n_anomalies")))  # one row each
