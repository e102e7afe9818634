"""Scalar text functions as Column expressions: folding, keys, typography, titles, tags."""

from __future__ import annotations

import re
import unicodedata
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import fixed

#: White space as browsers see it, and as Python does; Java's own classes are narrower.
SPACE = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
PY_SPACE = r"[\t-\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Letters that the typography knows, digits too where it says so.
LETTER, LETTER_DIGIT = r"[a-zA-Z\x{C0}-\x{17F}]", r"[a-zA-Z\x{C0}-\x{17F}0-9]"
NBSP = "\u00a0"
#: Quotes, brackets and blanks around a line that its tests look past.
EDGES = r"[«»\"“’\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}()\[\]{}]"


def _base_letters() -> tuple[str, str]:
    """All precomposed characters that canonical decomposition makes one character and marks of U+0300 to U+036F, and these characters."""
    found = []
    for c in map(chr, [*range(0xC0, 0xD800), *range(0xF900, 0xFB00)]):
        plain = re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", c))
        if len(plain) == 1 and plain != c:
            found.append((c, plain))
    return "".join(c for c, _ in found), "".join(p for _, p in found)


ACCENTED, PLAIN = _base_letters()


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which the plan then holds and computes once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim(x: Column, space: str = SPACE) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, rf"^{space}+|{space}+\z", "")


def fold_accents(x: Column) -> Column:
    """Without accents, precomposed or combining; ligatures stay."""
    return F.regexp_replace(F.translate(x, ACCENTED, PLAIN), r"[\x{300}-\x{36F}]", "")


def fold(x: Column) -> Column:
    """The form in which searches compare: lower case, straight apostrophes, no accents."""
    return fold_accents(F.translate(F.lower(x), "’", "'"))


_FOLDS = str.maketrans(ACCENTED, PLAIN)


def fold_text(x: str) -> str:
    """``fold`` of a text at hand."""
    return re.sub("[̀-ͯ]", "", x.lower().replace("’", "'").translate(_FOLDS))


def match_key(x: Column, spell_ae: bool = True) -> Column:
    """Lower-case a-z and digits only; œ (and æ, unless told not to) is spelt out and accented letters vanish."""
    spelt = F.replace(F.lower(x), F.lit("œ"), F.lit("oe"))
    if spell_ae:
        spelt = F.replace(spelt, F.lit("æ"), F.lit("ae"))
    return F.regexp_replace(spelt, "[^a-z0-9]", "")


def key_text(x: str, spell_ae: bool = False) -> str:
    """``match_key`` of a text at hand."""
    x = x.lower().replace("œ", "oe")
    return re.sub("[^a-z0-9]", "", x.replace("æ", "ae") if spell_ae else x)


def strip_html(x: Column) -> Column:
    """Tags become spaces, white space collapses, ends are trimmed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), SPACE + "+", " "), r"^ | \z", "")


def unquote_field(x: Column) -> Column:
    """A catalog field without blanks and outer quotes, doubled quotes made single; null is empty. A lone quote is its own outer pair."""

    def inner(f: Column) -> Column:
        return F.when(f.startswith('"') & f.endswith('"'), F.substring(f, F.lit(2), F.greatest(F.length(f) - 2, F.lit(0)))).otherwise(f)

    return trim(F.replace(let(trim(F.coalesce(x, F.lit(""))), inner), F.lit('""'), F.lit('"')))


def apostrophes(x: Column) -> Column:
    """Typographic apostrophe after a letter or digit."""
    return F.regexp_replace(x, f"({LETTER_DIGIT})'", "$1’")


def quotes(x: Column) -> Column:
    """Straight double quotes around something become guillemets; guillemets have one no-break space inside."""
    x = F.regexp_replace(x, '"([^"]+)"', f"«{NBSP}$1{NBSP}»")
    return F.regexp_replace(F.regexp_replace(x, f"«{SPACE}*", f"«{NBSP}"), f"{SPACE}*»", f"{NBSP}»")


def colons(x: Column) -> Column:
    """A no-break space before and a space after a colon, unless a digit stands before, or a digit or slash after."""
    return F.regexp_replace(x, f"(?<![0-9]){SPACE}*:{SPACE}*(?![0-9/])", f"{NBSP}: ")


def spaced_punctuation(x: Column, keep_entities: bool = True) -> Column:
    """After a letter or digit: one semicolon with a no-break space before and a space after; a no-break space before runs of ! and of ?.

    The semicolon of an HTML entity is none, unless ``keep_entities`` is off.
    """
    before = "(?<!&[A-Za-z0-9#]{0,8})" if keep_entities else ""
    x = F.regexp_replace(x, f"{before}({LETTER_DIGIT}){SPACE}*;+{SPACE}*", f"$1{NBSP}; ")
    for mark in ("!", r"\?"):
        x = F.regexp_replace(x, f"({LETTER_DIGIT}){SPACE}*({mark}+)", f"$1{NBSP}$2")
    return x


def outside_tags(x: Column, rule) -> Column:
    """``rule`` on the text between tags; tags, and a < that opens none, stay as they are."""
    parts = F.regexp_extract_all(x, F.lit("<[^>]*>|[^<]+|<"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("<"), p).otherwise(rule(p))), "")


def typography(x: Column, keep_entities: bool = True) -> Column:
    """French typography on the text outside tags: apostrophes, quotes, colons, then ; ! and ?. Null is empty."""
    rules = lambda p: spaced_punctuation(colons(quotes(apostrophes(p))), keep_entities)
    return outside_tags(F.coalesce(x, F.lit("")), rules)


def _upper_first(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))


_WORD_CHAR = "[A-Za-z0-9_]"


def _bounded(words: list[str]) -> str:
    """Any of ``words``, in their order, between borders of ASCII words: an accented letter is no part of one.

    The border before is looked for once for all words that follow each other and start alike, not for each.
    """
    is_word = lambda c: re.match(_WORD_CHAR, c) is not None
    one = lambda w: re.escape(w) + f"(?{'!' if is_word(w[-1]) else '='}{_WORD_CHAR})"
    alike = groupby(words, lambda w: is_word(w[0]))
    return "|".join(f"(?{'<!' if word else '<='}{_WORD_CHAR})(?:{'|'.join(map(one, some))})" for word, some in alike)


def _each(x: Column, words: list[str], change) -> Column:
    """``change`` on each of ``words`` (whole words, in either case) in x."""
    some = f"(?iu)(?:{_bounded(words)})"
    parts = F.split(F.regexp_replace(x, some, "\u0001$0\u0001"), "\u0001", -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, change(p)).otherwise(p)), "")


def sentence_case(x: Column) -> Column:
    """A title all in capitals is set in lower case, but for its first letter, known names and Roman numerals. Null is empty."""
    capital = lambda p: F.array_join(F.transform(F.split(p, "-"), _upper_first), "-")

    def lowered(x: Column) -> Column:
        low = F.lower(x)
        head = F.regexp_extract(low, r"(?s)^([^a-zA-Z\x{C0}-\x{17F}]*)", 1)
        out = F.concat(head, _upper_first(F.substring(low, F.length(head) + 1, F.length(low))))
        for several in (True, False):
            out = _each(out, [n for n in fixed.PROPER_NOUNS if (" " in n) == several], capital)
        return _each(out, list(fixed.ROMAN), F.upper)

    def told(x: Column) -> Column:
        letters = F.regexp_replace(x, r"[^a-zA-Z\x{C0}-\x{17F}]", "")
        return F.when((letters == "") | (letters != F.upper(letters)), x).otherwise(lowered(x))

    return let(F.coalesce(x, F.lit("")), told)


def title_separators(x: Column, text_id: Column) -> Column:
    """Parts of a list title (parted by /, else by ;, else for some ids by commas) with a capital each, joined by dashes."""

    def joined(x: Column, mark: str) -> Column:
        parts = F.filter(F.transform(F.split(x, mark), lambda p: trim(p)), lambda p: p != "")
        return F.array_join(F.transform(parts, _upper_first), " – ")

    def told(x: Column) -> Column:
        by_comma = x.contains(",") & F.coalesce(text_id.cast("long").isin(*fixed.LIST_TITLE_IDS), F.lit(False))
        return F.when(x.contains("/"), joined(x, "/")).when(x.contains(";"), joined(x, ";")).when(by_comma, joined(x, ",")).otherwise(x)

    return let(F.coalesce(x, F.lit("")), told)


def page_number_line(x: Column) -> Column:
    """If a line is only a page number: ``3 / 9``, ``page 3`` or ``3``."""
    return trim(x, PY_SPACE).rlike(rf"^(?:[0-9]+{PY_SPACE}*/{PY_SPACE}*[0-9]+|(?i:page){PY_SPACE}+[0-9]+|[0-9]+)\z")


def tighten(x: Column, repairs: bool = False) -> Column:
    """No blanks around apostrophes (made typographic) and hyphens between letters; ``repairs`` mends two words that scans break."""
    tight = x
    for mark, to in (("['’]", "’"), ("-", "-")):
        tight = F.regexp_replace(tight, f"({LETTER}){PY_SPACE}*{mark}{PY_SPACE}*({LETTER})", f"$1{to}$2")
    x = F.when(x.rlike("['’-]"), tight).otherwise(x)  # most spans have neither
    if repairs:
        x = F.regexp_replace(x, rf"(?iU)\bim{PY_SPACE}+médiat", "immédiat")
        x = F.regexp_replace(x, rf"(?iU)\bremp{PY_SPACE}+lace", "remplace")
    return x


def clean_html(x: Column) -> Column:
    """Slashes before a capital or « go, blanks collapse, empty paragraphs go, ends are trimmed."""
    for slashes in ("//+", "/+"):
        x = F.regexp_replace(x, f"{PY_SPACE}*{slashes}{PY_SPACE}*([A-ZÀ-Ÿ«])", " $1")
    x = F.regexp_replace(x, r"[ \t\x{A0}\x{202F}]+", " ")
    return trim(F.regexp_replace(x, f"<p>{PY_SPACE}*</p>", ""), PY_SPACE)


def grams(x: Column, size: int) -> Column:
    """The set of substrings of ``size`` characters, in order of their first places; empty if x is shorter or null."""

    def cut(chars: Column) -> Column:  # by single characters, as each substring would count from the start
        at = F.sequence(F.lit(0), F.greatest(F.size(chars) - size, F.lit(0)))
        return F.array_distinct(F.transform(at, lambda i: F.concat(*[F.get(chars, i + j) for j in range(size)])))

    return F.when(F.length(x) >= size, let(F.split(x, ""), cut)).otherwise(F.array().cast("array<string>"))


def trigrams(x: Column) -> Column:
    """The set of three-character substrings; empty under three characters."""
    return grams(x, 3)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def leading_integer(x: Column) -> Column:
    """The integer with which a text starts, signed, else null; of 19 digits at most."""
    return F.regexp_extract(x, rf"^{SPACE}*([+-]?[0-9]+)", 1).try_cast("bigint")


def leading_id(x: Column, default: int = 999) -> Column:
    """The leading integer; ``default`` if there is none or it is 0."""
    return F.coalesce(F.nullif(leading_integer(x), F.lit(0).cast("long")), F.lit(default).cast("long"))


def file_number(x: Column, default: int = 999) -> Column:
    """The number before the first dot of a file name; ``default`` if there is none."""
    return F.coalesce(F.regexp_extract(x, r"^([0-9]+)\.", 1).try_cast("bigint"), F.lit(default).cast("long"))


def route_id(x: Column) -> Column:
    """The text that a route (``#123``, ``#text-123``) names, else null."""
    return leading_integer(F.regexp_replace(F.regexp_replace(x, "^#", ""), "^(.*?)text-", "$1"))


_SUFFIXES = (("(?i)_C$|_Court$", "Version Courte", ("(?i)_C$", "(?i)_Court$")), ("(?i)_Complet$", "Version Complète", ("(?i)_Complet$",)), ("(?i)_Introduction$|_Intro$", "Introduction", ("(?i)_Introduction$", "(?i)_Intro$")))


def version_suffix(x: Column) -> Column:
    """The version that a file name's suffix tells, else null."""
    out = F.lit(None).cast("string")
    for found, name, _ in reversed(_SUFFIXES):
        out = F.when(x.rlike(found), name).otherwise(out)
    return out


def without_version(x: Column) -> Column:
    """A file name without the suffix that ``version_suffix`` tells (a second one of the same version too)."""
    out = x
    for found, _, gone in reversed(_SUFFIXES):
        cut = x
        for g in gone:
            cut = F.regexp_replace(cut, g, "")
        out = F.when(x.rlike(found), cut).otherwise(out)
    return out


def word_count(x: Column) -> Column:
    """Number of words parted by white space."""
    return F.regexp_count(F.coalesce(x, F.lit("")), F.lit(PY_SPACE.replace("[", "[^", 1) + "+")).cast("long")


def within_words(x: Column, most: int) -> Column:
    """If a text is neither empty nor longer than so many words (a thesis has 10, a summary 50)."""
    return word_count(x).between(1, most)


def excerpt(x: Column, chars: int) -> Column:
    """The first so many characters."""
    return F.substring(x, 1, chars)


def count_label(n: Column, noun: str = "texte", after: str = "trouvé") -> Column:
    """A number, a noun and a participle, both with an s from two on."""
    s = F.when(n > 1, "s").otherwise("")
    return F.concat(n.cast("string"), F.lit(f" {noun}"), s, F.lit(f" {after}"), s)


def position_outside_tags(html: Column, marks: str) -> Column:
    """0-based position of the first of the characters ``marks`` outside tags, -1 if there is none; nothing counts after a < that opens no tag."""
    state = lambda at, found, over: F.struct(at.alias("at"), found.alias("found"), over.alias("over"))

    def step(acc: Column, part: Column) -> Column:
        before = F.length(F.regexp_extract(part, f"^[^{re.escape(marks)}]*", 0))
        end, tag, here = acc["at"] + F.length(part), part.startswith("<"), acc["at"] + before
        met = F.when(~tag & (before < F.length(part)), here).otherwise(F.lit(-1).cast("bigint"))
        return F.when(acc["over"], acc).otherwise(state(end, met, (part == "<") | (met >= 0)))

    parts = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("<[^>]*>|[^<]+|<"), F.lit(0))
    return F.aggregate(parts, state(F.lit(0).cast("bigint"), F.lit(-1).cast("bigint"), F.lit(False)), step, lambda acc: acc["found"])


def first_comma(html: Column) -> Column:
    return position_outside_tags(html, ",")


def first_comma_or_paren(html: Column) -> Column:
    return position_outside_tags(html, ",(")


def fuzzy_pattern(x: Column) -> Column:
    """A pattern that finds x with any blanks, none too, for its spaces and either apostrophe, with blanks after, for its apostrophes."""
    escaped = F.regexp_replace(x, r"([\\.\[\]{}()*+?^$|#&~-])", r"\\$1")
    return F.concat(F.lit("(?iu)"), F.regexp_replace(F.regexp_replace(escaped, " ", rf"{PY_SPACE}*".replace("\\", "\\\\")), "['’]", rf"['’]{PY_SPACE}*".replace("\\", "\\\\")))
