"""From catalog fields and file names to records: authors, themes, versions, analyses, notions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import fixed
from foliant.functions.text import (
    PY_SPACE, SPACE, fold, fold_accents, fold_text, key_text, leading_id, let, match_key, sentence_case, title_separators, trim, typography, unquote_field, version_suffix, without_version,
)

NOTION_ARRAY = "array<string>"


def notions_literal() -> Column:
    return F.array(*map(F.lit, fixed.NOTIONS))


def _map_of(pairs: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in pairs.items() for v in pair])


def _parts(x: Column, mark: str = ",", space: str = SPACE) -> Column:
    return F.transform(F.split(x, mark, -1), lambda p: trim(p, space))


def split_name(filename: Column) -> Column:
    """(author, themes) of a file name as the catalog has it: author_themes, where DE_ takes the next part with it and EN.UNIV. gives way to it."""

    def told(parts: Column) -> Column:
        second = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
        rest = lambda n: F.array_join(F.slice(parts, n, F.greatest(F.size(parts), F.lit(1))), "_")
        first = F.when(parts[0] == "", fixed.NO_AUTHOR).otherwise(trim(parts[0]))
        merges, gives = (F.upper(first) == "DE") & (second != ""), (F.upper(first) == "EN.UNIV.") & (second != "")
        author = F.when(merges, F.concat(F.lit("DE_"), trim(second))).when(gives, trim(second)).otherwise(first)
        return F.struct(author.alias("author"), F.when(merges | gives, rest(3)).otherwise(rest(2)).alias("themes"))

    return let(F.split(filename, "_", -1), told)


def author_key(x: Column) -> Column:
    """Capitals and digits of a name, without accents."""
    return F.regexp_replace(fold_accents(F.upper(x)), "[^A-Z0-9]", "")


def display_author(raw: Column, text_id: Column) -> Column:
    """The author to show: that set for the id, else that of the name's key, else the name; typeset."""
    by_id = F.try_element_at(_map_of(fixed.AUTHORS_BY_ID), text_id.cast("int"))
    by_key = F.try_element_at(_map_of(fixed.AUTHORS), author_key(raw))
    return typography(F.replace(F.coalesce(by_id, by_key, raw), F.lit("'"), F.lit("’")))


def display_themes(raw: Column) -> Column:
    """Themes parted by & are joined by slashes and typeset."""
    return typography(F.array_join(_parts(raw, "&"), " / "))


def _found(x: Column, pattern: str, default: Column) -> Column:
    """The pattern's first group without outer blanks, which may be empty; the default only where nothing matches."""
    return F.when(x.rlike(pattern), trim(F.regexp_extract(x, pattern, 1))).otherwise(default)


def parse_analysis(analysis: Column, themes: Column) -> Column:
    """(title, thesis, summary) as an analysis column holds them, with what stands for a missing one."""
    s = SPACE + "*"
    title = _found(analysis, rf"Titre:{s}(.*?){s}\.{s}(?:Thèse:|\z)", themes)
    thesis = _found(analysis, rf"Thèse:{s}(.*?){s}\.{s}(?:Résumé:|\z)", F.lit(fixed.NO_THESIS))
    summary = _found(analysis, rf"Résumé:{s}(.*?){s}\.?{s}\z", F.lit(fixed.NO_SUMMARY))
    return F.struct(title.alias("title"), thesis.alias("thesis"), summary.alias("summary"))


def clean_title(x: Column) -> Column:
    """Without the version that a title tells in brackets."""
    for said in (rf"(?:version{SPACE}+)?courte?", rf"(?:version{SPACE}+)?complète?", "introduction"):
        x = F.regexp_replace(x, rf"(?iu){SPACE}*\({said}\){SPACE}*", "")
    return trim(x)


def display_title(raw: Column, text_id: Column) -> Column:
    return title_separators(sentence_case(typography(clean_title(raw))), text_id)


def parse_notions(x: Column) -> Column:
    """Notions parted by commas, typeset, without empty ones."""
    return F.filter(F.transform(_parts(F.coalesce(x, F.lit(""))), lambda p: typography(p)), lambda p: p != "")


def text_records(rows: DataFrame) -> DataFrame:
    """Text records from catalog rows (pos, id_raw, filename, analysis, notions); one projection a step, so that no expression is repeated."""
    raw = rows.select("pos", leading_id(trim(F.col("id_raw"))).alias("id"), unquote_field(F.col("filename")).alias("filename"), unquote_field(F.col("analysis")).alias("raw_analysis"), unquote_field(F.col("notions")).alias("notions"))
    named = raw.withColumn("n", let(F.col("filename"), split_name))
    named = named.select("*", F.col("n.author").alias("_author"), F.col("n.themes").alias("_themes")).drop("n")
    told = named.withColumns({"themes": display_themes(without_version(F.col("_themes"))), "suffix": version_suffix(F.col("_themes"))})
    parsed = told.withColumn("a", parse_analysis(F.col("raw_analysis"), F.col("themes")))
    return parsed.select(
        "pos", "id", "filename", display_author(F.col("_author"), F.col("id")).alias("author"), "themes", "suffix", display_title(F.col("a.title"), F.col("id")).alias("title"),
        typography(F.col("a.thesis")).alias("thesis"), typography(F.col("a.summary")).alias("summary"), parse_notions(F.col("notions")).alias("notions"), "raw_analysis",
    )


def official_notion(x: Column) -> Column:
    """The programme's spelling of a notion, else null."""
    return F.try_element_at(_map_of({key_text(n): n for n in fixed.NOTIONS}), match_key(x, spell_ae=False))


def notions_in_name(filename: Column) -> Column:
    """Notions whose key the file name's key holds, in the programme's order."""
    name = match_key(filename, spell_ae=False)
    return F.filter(notions_literal(), lambda n: name.contains(match_key(n, spell_ae=False)))


def notions_of_themes(themes: Column) -> Column:
    """Notions that one of the themes (parted by &) holds or is held by, in the programme's order; an empty theme is held by all."""
    keys = F.transform(F.split(themes, "&", -1), lambda t: match_key(t, spell_ae=False))
    pairs = lambda n: F.exists(keys, lambda t: match_key(n, spell_ae=False).contains(t) | t.contains(match_key(n, spell_ae=False)))
    return F.filter(notions_literal(), pairs)


def guard_technique(notions: Column, filename: Column, title: Column, summary: Column) -> Column:
    """Without "La technique" where other notions stand beside it and neither name, title nor summary speak of it."""
    key = key_text("La technique")
    told = F.exists(F.array(filename, title, summary), lambda x: F.coalesce(match_key(x, spell_ae=False).contains(key), F.lit(False)))
    at = F.array_position(notions, "La technique")
    return F.when((at > 0) & (F.size(notions) > 1) & ~told, F.filter(notions, lambda _, i: i + 1 != at)).otherwise(notions)


def final_notions(notions: Column, filename: Column, title: Column, summary: Column, most: int = 5) -> Column:
    """At most five notions: guarded, and taken from the file name if none is left."""
    kept = guard_technique(F.slice(F.coalesce(notions, F.array().cast(NOTION_ARRAY)), 1, most), filename, title, summary)
    return F.slice(F.when(F.size(kept) > 0, kept).otherwise(notions_in_name(filename)), 1, most)


def toggle_notions(selected: Column, answer: Column) -> Column:
    """A selection after an answer: numbers (parted by commas, from 1) add or take away, known names replace all, anything else changes nothing."""
    answer = trim(answer, PY_SPACE)
    parts = F.filter(_parts(answer, ",", PY_SPACE), lambda p: p != "")

    def toggle(acc: Column, part: Column) -> Column:
        n = F.when(part.rlike("^[0-9]{1,9}$"), part).try_cast("int")
        notion = F.when(n.between(1, len(fixed.NOTIONS)), F.try_element_at(notions_literal(), n))
        at = F.array_position(acc, notion)
        return F.when(notion.isNull(), acc).when(at > 0, F.filter(acc, lambda _, i: i + 1 != at)).otherwise(F.array_append(acc, notion))

    names = F.array_distinct(F.filter(F.transform(parts, official_notion), lambda n: n.isNotNull()))
    numbers = answer.rlike(rf"^(?:[0-9,]|{PY_SPACE})+\z")
    return F.when(numbers, F.aggregate(parts, selected, toggle)).when(F.size(names) > 0, names).otherwise(selected)


def parse_header(name: Column, plain_name: bool) -> Column:
    """(author, themes) of ``123.AUTHOR_Theme&Theme``: of the name without spaces, else parted at its first _.

    A name without _ has no author and is all themes if ``plain_name``, else it gives nulls.
    """
    pattern, nothing = r"^[0-9]+\.([^_]+)_(.*)$", F.lit("" if plain_name else None).cast("string")

    def cut(name: Column) -> Column:
        tight = F.replace(F.replace(name, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
        loose = F.split(trim(F.replace(name, F.lit("\n"), F.lit(" ")), PY_SPACE), "_", 2)
        two, fits = F.size(loose) == 2, tight.rlike(pattern)
        author = F.when(fits, F.regexp_extract(tight, pattern, 1)).when(two, F.regexp_replace(loose[0], r"(?s)^[^.]*\.", "")).otherwise(nothing)
        themes = F.when(fits, F.regexp_extract(tight, pattern, 2)).when(two, F.try_element_at(loose, F.lit(2))).otherwise(name if plain_name else nothing)
        return F.struct(trim(author, PY_SPACE).alias("a"), trim(themes, PY_SPACE).alias("t"))

    def merged(x: Column) -> Column:
        more, merges = F.split(x["t"], "_", 2), (F.upper(x["a"]) == "DE") & x["t"].contains("_")
        return F.struct(F.when(merges, F.concat(F.lit("DE "), more[0])).otherwise(x["a"]).alias("author"), F.when(merges, F.try_element_at(more, F.lit(2))).otherwise(x["t"]).alias("themes"))

    return let(let(name, cut), merged)


def seed_key(author: Column, themes: Column) -> Column:
    """(author_norm, themes_norm): match keys, the themes' without an ending that tells the version (a genuine last c goes too)."""
    ended = F.regexp_replace(match_key(themes, spell_ae=False), "(c|court|complet|introduction|intro)$", "")
    return F.struct(match_key(author, spell_ae=False).alias("author_norm"), ended.alias("themes_norm"))


def _labelled(x: Column, label: str, until: str | None) -> Column:
    stop = rf"(?:{until}|\z)" if until else r"\z"
    return F.coalesce(trim(F.regexp_extract(x, rf"(?s){label}(.*{'?' if until else ''}){stop}", 1), PY_SPACE), F.lit(""))


def parse_response(x: Column) -> Column:
    """(title, thesis, summary, notions) of a labelled answer; missing labels give empty texts, unknown notions go."""
    names = F.transform(F.split(_labelled(x, "Notions:", None), ",", -1), lambda p: official_notion(F.regexp_replace(trim(p, PY_SPACE), r"^\.+|\.+\z", "")))
    return F.struct(
        _labelled(x, "Titre:", "Thèse:").alias("title"), _labelled(x, "Thèse:", "Résumé:").alias("thesis"), _labelled(x, "Résumé:", "Notions:").alias("summary"),
        F.filter(names, lambda n: n.isNotNull()).alias("notions"),
    )


def parse_seed_block(lines: Column) -> Column:
    """(header, title, thesis, summary, notions) of the lines of a seed block; null without a title line.

    The last lines that hold a notion are its notions: read from the bottom up,
    each put before those found. What is left of the summary loses a notion at its end.
    """
    holds = lambda w: F.exists(notions_literal(), lambda n: match_key(w, spell_ae=False).contains(match_key(n, spell_ae=False)))
    part = lambda p: F.regexp_replace(trim(p, PY_SPACE), r"^\.+|\.+\z", "")

    def ending(rest: Column) -> Column:
        other = F.transform(rest, lambda x, i: F.when(F.exists(F.split(x, ",", -1), holds), 0).otherwise(i + 1))
        return F.struct(rest.alias("rest"), F.coalesce(F.array_max(other), F.lit(0)).cast("int").alias("last"))

    def notions(x: Column) -> Column:
        listed = F.flatten(F.transform(F.reverse(F.slice(x["rest"], x["last"] + 1, F.size(x["rest"]) + 1)), lambda line: F.transform(F.split(line, ",", -1), part)))
        spelt = F.transform(F.filter(listed, lambda p: p != ""), lambda p: F.coalesce(official_notion(p), p))
        summary = without_last_notion(F.array_join(F.slice(x["rest"], 1, x["last"]), " "))
        return F.struct(summary.alias("summary"), F.reverse(F.array_distinct(spelt)).alias("notions"))

    def card(x: Column) -> Column:
        lines, at = x["lines"], x["at"]
        header = trim(F.array_join(F.slice(lines, 1, F.greatest(at - 1, F.lit(0))), " "), PY_SPACE)
        told = F.array_join(F.slice(lines, F.greatest(at, F.lit(1)), F.size(lines)), "\n")

        def read(told: Column) -> Column:
            rest = F.filter(F.split(_labelled(told, "Résumé:", None), "\n", -1), lambda line: trim(line, PY_SPACE) != "")
            end = let(let(rest, ending), notions)
            return let(end, lambda e: F.struct(header.alias("header"), _labelled(told, "Titre:", "Thèse:").alias("title"), _labelled(told, "Thèse:", "Résumé:").alias("thesis"), e["summary"].alias("summary"), e["notions"].alias("notions")))

        return F.when(at > 0, let(told, read))

    at = F.array_position(F.transform(lines, lambda x: x.contains("Titre:")), True).cast("int")
    return let(F.struct(lines.alias("lines"), at.alias("at")), card)


def without_last_notion(summary: Column) -> Column:
    """A summary without a notion that its end still holds, nor commas there."""
    s = PY_SPACE
    named = "nature|religion|technique|science|justice|conscience|liberté|vérité|raison|le" + s + "+travail"
    return F.regexp_replace(trim(F.regexp_replace(trim(summary, s), rf"(?iu){s}*La{s}+({named}){s}*\z", ""), s), r"^,+|,+\z", "")


def analysis_column(title: Column, thesis: Column, summary: Column) -> Column:
    """The analysis field of a catalog row: labelled, runs of dots and of blanks collapsed."""
    said = F.concat(F.lit("Titre: "), title, F.lit(". Thèse: "), thesis, F.lit(". Résumé: "), summary, F.lit("."))
    return F.regexp_replace(F.regexp_replace(said, r"\.+", "."), PY_SPACE + "+", " ")


def fallback_title(themes: Column) -> Column:
    return F.replace(themes, F.lit("&"), F.lit(" et "))


def notion_stems() -> dict[str, str]:
    """The folded stem of each notion: without its article."""
    import re

    return {n: re.sub(r"^(l'|d'|la\s+|le\s+)", "", fold_text(n)).strip() for n in fixed.NOTIONS}


def notion_score(notions: Column, matched: list[str]) -> Column:
    """How many of a text's notions (repeats counted) are among the matched ones."""
    wanted = [fold_text(m) for m in matched]
    return F.size(F.filter(notions, lambda n: fold(n).isin(*wanted))).cast("long") if wanted else F.lit(0).cast("long")
