"""Text functions against hand-derived values and plain-Python models."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import search

N = " "


def run(spark, rule, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", rule(F.col("x")).alias("y")).orderBy("i").collect()]


def french(s):
    """The seven rules of the typography, text outside tags only."""

    def rules(t):
        blank, letter = r"\s", "[a-zA-ZÀ-ſ0-9]"
        t = re.sub(f"(?<={letter})'", "’", t)
        t = re.sub('"([^"]+)"', f"«{N}\\1{N}»", t)
        t = re.sub(f"{blank}*»", f"{N}»", re.sub(f"«{blank}*", f"«{N}", t))
        t = re.sub(rf"(?<![0-9]){blank}*:{blank}*(?![0-9/])", f"{N}: ", t)
        t = re.sub(f"({letter}){blank}*;+{blank}*", f"\\1{N}; ", t)
        t = re.sub(f"({letter}){blank}*(!+)", f"\\1{N}\\2", t)
        return re.sub(f"({letter}){blank}*([?]+)", f"\\1{N}\\2", t)

    return re.sub(r"(<[^>]*>)|([^<]+)", lambda m: m[1] or rules(m[2]), s)


def test_typography(spark):
    cases = ["l'homme d'Été", 'il dit "oui" et ""', "« oui »", "a : b", "a: 5", "12 : y", "http://x", "a ;; b", "quoi?! non !!", 'href <a href="x?y;z">l\'a?</a> b', "a < b ; c", "x ?  y", "", "12:30", "«a»", "fin;"]
    assert run(spark, lambda x: T.typography(x, keep_entities=False), cases) == [french(c) for c in cases]
    assert run(spark, T.typography, [None, "a &amp; b ; c", "&#39;x"]) == ["", f"a &amp; b{N}; c", "&#39;x"]


def test_sentence_case(spark):
    cases = {"LA VÉRITÉ SELON KANT": None, "Pas tout": "Pas tout", "": "", "12 !": "12 !", "« DE MONTAIGNE ET LÉVI-STRAUSS »": None, "LOUIS XIV": "Louis XIV"}
    got = dict(zip(cases, run(spark, T.sentence_case, list(cases))))
    assert got["LA VÉRITÉ SELON KANT"] == "La Vérité selon Kant"  # v before é stands alone for an ASCII border: a numeral
    assert got["« DE MONTAIGNE ET LÉVI-STRAUSS »"] == "« De Montaigne et LéVI-Strauss »"  # vi after é too
    assert (got["Pas tout"], got[""], got["12 !"], got["LOUIS XIV"]) == ("Pas tout", "", "12 !", "Louis XIV")
    assert run(spark, T.sentence_case, [None, "SENS ET WEIL", "ÉPICURE", "L'ART DE LA COMTE-SPONVILLE"]) == ["", "Sens et Weil", "Épicure", "L'art de la Comte-Sponville"]


def test_title_separators(spark):
    df = spark.createDataFrame([(1, "a / b/ / c", "A – B – C"), (2, "a ; b", "A – B"), (170, "a, b", "A – B"), (3, "a, b", "a, b"), (4, None, "")], "id int, t string, e string")
    assert all(r["y"] == r["e"] for r in df.select("e", T.title_separators(F.col("t"), F.col("id")).alias("y")).collect())


def test_fold_covers_all_precomposed_letters(spark):
    letters = [chr(c) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if unicodedata.category(chr(c))[0] == "L"]
    plain = [re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", c)) for c in letters]
    assert run(spark, T.fold_accents, letters) == plain and [T.fold_text(c) for c in "DvořÁk’"] == list("dvorak'")
    df = spark.createDataFrame([("Antonín Dvořák",), ("L’État",)], "t string")
    assert search.search(df, "Dvořák", [F.col("t")]).count() == search.search(df, "etat", [F.col("t")]).count() == 1


def test_small_functions(spark):
    assert run(spark, T.match_key, ["L'État", "Cœur & æ", None]) == ["ltat", "coeurae", None]
    assert run(spark, lambda x: T.match_key(x, spell_ae=False), ["Cœur & æ"]) == ["coeur"]
    assert run(spark, T.strip_html, ["<p>a<br>b</p>　", "<>", "a < b"]) == ["a b", "<>", "a < b"]
    assert run(spark, T.unquote_field, [' "a ""b""" ', '"', "x", None, '""']) == ['a "b"', "", "x", "", ""]
    assert run(spark, T.leading_id, ["12a", " -5x", "0", "x", "", None, "1234567890123"]) == [12, -5, 999, 999, 999, 999, 1234567890123]
    assert run(spark, T.file_number, ["12.A_b", "0.A", "A.1", None]) == [12, 0, 999, 999]
    assert run(spark, T.route_id, ["#123", "#text-45x", "#", "#a"]) == [123, 45, None, None]
    assert run(spark, T.version_suffix, ["A_C", "A_court", "A_Complet", "A_Intro", "A_Introduction", "A", "C"]) == ["Version Courte", "Version Courte", "Version Complète", "Introduction", "Introduction", None, None]
    assert run(spark, T.without_version, ["A_C", "A_Court_C", "A_Intro_C", "A_Introduction", "A"]) == ["A", "A", "A_Intro", "A", "A"]
    assert run(spark, T.page_number_line, ["3 / 9", "Page 3", "3", "p. 3", " 4 ", ""]) == [True, True, True, False, True, False]
    assert run(spark, T.tighten, ["l ' homme", "peut - être", "a - b - c"]) == ["l’homme", "peut-être", "a-b - c"]
    assert run(spark, lambda x: T.tighten(x, repairs=True), ["im médiat et Remp lace"]) == ["immédiat et remplace"]
    assert run(spark, T.clean_html, [f" a // Bon /b <p> </p>{N}{N}c "]) == ["a Bon /b  c"]  # blanks collapse before the paragraph goes
    assert run(spark, T.word_count, ["a b  c", "", None]) == [3, 0, 0]
    assert run(spark, lambda x: T.within_words(x, 2), ["a b", "a b c", " "]) == [True, False, False]
    assert run(spark, lambda x: T.excerpt(x, 2), ["abc", ""]) == ["ab", ""]
    assert run(spark, lambda n: T.count_label(n, "mot", "lu"), [0, 1, 2], "int") == ["0 mot lu", "1 mot lu", "2 mots lus"]
    assert run(spark, T.first_comma, ["<a,b>x, y", "x", "a(b,c"]) == [6, -1, 3]
    assert run(spark, T.first_comma_or_paren, ["<i>a</i>(b,c", "a>b,c"]) == [8, 3]
    df = spark.createDataFrame([("l' homme  est", "l’homme est"), ("c.d", "cxd"), ("C.D", "c.d")], "t string, w string")
    assert [r[0] for r in df.select(F.regexp_like("t", T.fuzzy_pattern(F.col("w")))).collect()] == [True, False, True]


@pytest.mark.parametrize("query, terms", [
    ("la liberté", [("word", "liberte")]), ('"le bien" vrai', [("exact", "le bien"), ("word", "vrai")]), ("l'homme d'état", [("exact", "homme d"), ("word", "etat")]),
    ("pour la nature dans un livre", [("word", "nature"), ("word", "livre")]), ("la", [("word", "la")]), ("''", [("word", "''")]), ("-a' b", [("word", "-a' b")]),
])
def test_query_terms(spark, query, terms):
    assert search.search_terms(query) == terms
    got = run(spark, search.query_terms, [query])[0]
    assert ([tuple(t) for t in got] or [("word", T.fold_text(query))]) == terms


def test_the_border_before_words_is_looked_for_once():
    import re

    from foliant.functions import text

    pattern = text._bounded(["kant", "de gaulle", "ii"])
    assert pattern.count("(?<!") == 1
    assert re.findall(pattern, "kant kants de gaulle xii ii ékant") == ["kant", "de gaulle", "ii", "kant"]
