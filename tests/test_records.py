"""Catalog readers, records, seeds, writers and catalog operators on hand-made inputs."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import fixed
from foliant.functions import records as R
from foliant.operators import catalog, search
from foliant.sources import catalog as sources
from foliant.sources import sinks

HEADER = fixed.CATALOG_HEADER
ROWS = [
    "101\tDUPONT_Nature&Technique_C\tTitre: LA VIE. Thèse: On vit. Résumé: On vit bien.\tLa nature, La technique",
    "", "7\tonly two", "0\tDE_BEAUVOIR_X & Y_Intro\t\"Titre: A ; b. Thèse: \"\"t\"\" : oui.\"", "abc\tEN.UNIV._TAP-Pierre_L'État_Complet\tRésumé: Fin!\t",
    "\tSHIFTED\tname_here\tanalysis", "383\tX_Y\tz\tL'art,,La vérité", "50\tHUGO\tTitre: . Thèse: . Résumé: .\t",
]


@pytest.fixture()
def catalog_file(tmp_path):
    path = tmp_path / "catalog.tsv"
    path.write_bytes("\r\n".join([HEADER, *ROWS]).encode())
    return str(path)


def test_client_reads_records(spark, catalog_file):
    got = {r["filename"]: r for r in sources.read_catalog(spark, catalog_file).collect()}
    assert [r["id"] for r in sources.read_catalog(spark, catalog_file).collect()] == [50, 101, 383, 999, 999, 999]
    r = got["DUPONT_Nature&Technique_C"]
    assert (r["id"], r["author"], r["themes"], r["suffix"], r["title"], r["thesis"], r["summary"], r["notions"]) == (101, "DUPONT", "Nature / Technique", "Version Courte", "La vie", "On vit", "On vit bien", ["La nature", "La technique"])
    r = got["DE_BEAUVOIR_X & Y_Intro"]
    assert (r["id"], r["author"], r["themes"], r["suffix"], r["title"], r["thesis"], r["summary"], r["notions"]) == (999, "DE BEAUVOIR", "X / Y", "Introduction", "A ; b".replace(" ; ", " – ") if False else "A – B", "« t » : oui", "Résumé non spécifié.", [])
    r = got["EN.UNIV._TAP-Pierre_L'État_Complet"]
    assert (r["author"], r["themes"], r["suffix"], r["title"], r["thesis"], r["summary"]) == ("Pierre TAP", "L’État", "Version Complète", "L’État", "Thèse non spécifiée.", "Fin !")
    assert got["name_here"]["id"] == 999 and got["name_here"]["themes"] == "here"  # an empty first field moves the others
    assert got["X_Y"]["author"] == "BIBLE – LOCKE – DDHC 1789" and got["X_Y"]["notions"] == ["L’art", "La vérité"] and got["X_Y"]["title"] == "Y"
    assert (got["HUGO"]["title"], got["HUGO"]["thesis"], got["HUGO"]["summary"]) == ("", "", "")  # matched, and empty


def test_scripts_read_cells(spark, catalog_file):
    lines = sources.read_lines(spark, catalog_file)
    assert sources.catalog_header(lines).first()[0] == HEADER
    cells = [r["cells"] for r in sources.script_rows(lines).orderBy("pos").collect()]
    assert [len(c) for c in cells] == [4, 2, 3, 4, 4, 4, 4] and cells[4][0] == ""


def test_upsert_delete_and_write(spark, tmp_path):
    schema = "pos long, id string, filename string, analysis string, notions string"
    base = spark.createDataFrame([(1, "60", "a", "x", ""), (2, "bad", "b", "x", ""), (3, "7", "a", "x", "n"), (4, "9", None, "x", "")], schema)
    changes = spark.createDataFrame([(1, "61", "a", "first", ""), (2, "62", "a", "second", ""), (3, "8", "c", "new", ""), (4, "9", None, "null", "")], schema)
    out = catalog.upsert(base, changes, "filename")
    assert [tuple(r)[:4] for r in out.orderBy("pos").collect()] == [(1, "62", "a", "second"), (2, "bad", "b", "x"), (3, "7", "a", "x"), (4, "9", None, "null"), ((1 << 62) + 3, "8", "c", "new")]
    assert [r["id"] for r in catalog.by_number(out).collect()] == ["7", "8", "9", "62", "bad"]
    assert catalog.upsert(base, changes.limit(0), "filename").count() == 4 and catalog.upsert(base.limit(0), changes, "filename").count() == 3
    assert sorted(r["pos"] for r in catalog.delete_first(base, catalog.named("A")).collect()) == [2, 3, 4]
    assert sorted(r["pos"] for r in catalog.delete_first(base, catalog.named("7")).collect()) == [1, 2, 4] and catalog.delete_first(base, catalog.named("none")).count() == 4
    assert catalog.first_match(base, catalog.named("a")).first()["pos"] == 1
    assert tuple(catalog.next_id(base).first()) == (61, False) and tuple(catalog.next_id(base.limit(0)).first()) == (50, False)
    assert catalog.next_id(spark.createDataFrame([("99",)], "id string")).first()["overflow"]
    sinks.write_catalog(out, str(tmp_path / "out"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines[0] == HEADER and lines[1] == "7\ta\tx\tn" and len(lines) == 6
    assert sinks.catalog_lines(out.limit(0)).collect()[0][0] == HEADER


SEED = """intro without a number
103 no dot
101.DUPONT_Nature&Technique
Titre: La vie
Thèse: On vit
Résumé: On vit bien.
La nature, La technique
102.DE_MONTAIGNE_L'art c
Titre: T
Thèse: H
Résumé: Un. Deux La nature
 Autre ligne
Le bonheur., Divers
L’ART
104.NOTHING
no title here"""


def test_seeds(spark):
    lines = spark.createDataFrame([("s", i, x) for i, x in enumerate(SEED.split("\n"))], "doc string, pos int, line string")
    blocks = sources.seed_blocks(lines)
    assert sorted(r["block"] for r in blocks.collect()) == [0, 1, 2, 3]
    got = {(r["author_norm"], r["themes_norm"]): tuple(r)[2:] for r in sources.parse_seeds(blocks).collect()}
    assert got[("dupont", "naturetechnique")] == ("La vie", "On vit", "On vit bien.", ["La technique", "La nature"])
    assert set(got) == {("dupont", "naturetechnique"), ("demontaigne", "lart")}  # a genuine last c goes too
    title, thesis, summary, notions = got[("demontaigne", "lart")]
    assert (title, thesis, summary, notions) == ("T", "H", "Un. Deux La nature  Autre ligne", ["Divers", "Le bonheur", "L'art"])
    assert sources.parse_seeds(blocks.limit(0)).collect() == []


def test_seed_join_and_counts(spark):
    files = spark.createDataFrame([("1.A_Nature",), ("2.B_Temps",), ("3.B_Temps_C",), ("4.C_La technique&Le temps",), ("plain",)], "filename string")
    card = "title string, thesis string, summary string, notions array<string>"
    seeds = spark.createDataFrame([("a", "nature", "T", "H", "S", ["La nature", "La technique"])], "author_norm string, themes_norm string, " + card)
    made = spark.createDataFrame([("3.B_Temps_C", "G3", "h", "s", []), ("2.B_Temps", "G2", "h", "s", ["Le temps"])], "filename string, " + card)
    got = {r["filename"]: r for r in catalog.seeded(files, seeds, made).collect()}
    assert [(got[f]["origin"], got[f]["title"], got[f]["notions"]) for f in ("1.A_Nature", "2.B_Temps", "3.B_Temps_C")] == [("seed", "T", ["La nature"]), ("generated", "G2", ["Le temps"]), ("generated", "G2", ["Le temps"])]
    assert got["4.C_La technique&Le temps"]["title"] == "Latechnique et Letemps" and got["4.C_La technique&Le temps"]["notions"] == ["La technique", "Le temps"]
    assert got["plain"]["id"] == 999 and got["1.A_Nature"]["analysis"] == "Titre: T. Thèse: H. Résumé: S."
    assert tuple(catalog.origin_counts(catalog.seeded(files, seeds, made)).first()) == (1, 2, 2)
    assert [r["filename"] for r in sources.numbered(files).collect()][-1] == "plain"


def test_notions_and_responses(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(R.official_notion(F.lit("l’ÉTAT "))) == "L'État" and one(R.official_notion(F.lit("autre"))) is None
    assert one(R.notions_in_name(F.lit("x_La technique du travail&le bonheur"))) == ["Le bonheur", "La technique"]
    assert one(R.notions_of_themes(F.lit("nature&Art"))) == ["L'art", "La nature"]
    some = F.array(F.lit("La technique"), F.lit("L'art"))
    assert one(R.guard_technique(some, F.lit("a"), F.lit("b"), F.lit(None))) == ["L'art"]
    assert one(R.guard_technique(some, F.lit("a"), F.lit("la Technique"), F.lit(""))) == ["La technique", "L'art"]
    assert one(R.final_notions(F.lit(None).cast("array<string>"), F.lit("La nature"), F.lit(""), F.lit(""))) == ["La nature"]
    assert one(R.toggle_notions(F.array(F.lit("L'art")), F.lit("1, 4, 99, 2 3"))) == ["Le devoir"]
    assert one(R.toggle_notions(F.array(F.lit("L'art")), F.lit("la raison, x, LA RAISON"))) == ["La raison"]
    assert one(R.toggle_notions(F.array(F.lit("L'art")), F.lit("x"))) == ["L'art"] and one(R.toggle_notions(F.array(F.lit("L'art")), F.lit(" "))) == ["L'art"]
    r = one(R.parse_response(F.lit("Titre: a\nb\nThèse: c\nRésumé: d\nNotions: L'art., Autre, la nature")))
    assert tuple(r) == ("a\nb", "c", "d", ["L'art", "La nature"])
    assert tuple(one(R.parse_response(F.lit("Thèse: c")))) == ("", "c", "", [])
    assert one(R.analysis_column(F.lit("a.."), F.lit("b"), F.lit("c\n d"))) == "Titre: a. Thèse: b. Résumé: c d."
    heads = {"111.ARENDT_Homme & Machine": ("ARENDT", "Homme&Machine"), "DE_FUNES_x": ("DE FUNES", "x"), "a.b_c_d": ("b", "c_d"), "plain": ("", "plain")}
    for name, want in heads.items():
        assert tuple(one(R.parse_header(F.lit(name), plain_name=True))) == want
    assert tuple(one(R.parse_header(F.lit("plain"), plain_name=False))) == (None, None)


def test_search_ranks_by_notions(spark):
    schema = "pos int, id int, filename string, author string, themes string, suffix string, title string, thesis string, summary string, notions array<string>"
    rows = [(1, 5, "f5", "KANT", "t", None, "Le vrai", "", "", ["La vérité"]), (2, 3, "f3", "Élie", "t", "Introduction", "", "la vérité", None, ["L’art", "La vérité", "La vérité"]), (3, 4, "f4", None, "vérité", None, "", "", "", None), (4, 12, "f12", "x", "", None, "", "", "", [])]
    texts = spark.createDataFrame(rows, schema)
    ids = lambda q: [r["id"] for r in search.search_texts(texts, q).collect()]
    assert ids("") == [3, 4, 5, 12] and ids("verite") == [3, 5, 4] and ids('"vérité"') == [3, 4, 5] and ids("elie verite") == [3]
    assert ids("1") == [12] and ids("zzz") == [] and search.matched_notions("la part") == ["L'art"] and search.matched_notions('"part"') == []
    assert search.find_id(texts, 4).first()["filename"] == "f4"
    counted = catalog.result_count(search.search_texts(texts, "1")).first()
    assert tuple(counted) == (1, "1 texte trouvé", True)
    card = catalog.cards(texts.where("id = 3")).first()
    assert card["heading"] == " [Introduction]" and card["tags"] == "L’art | La vérité | La vérité" and card["pdf"] == "pdf/f3.pdf"
    near = search.neighbours(search.search_texts(texts, "verite"), [-F.col("score"), F.col("id")], "id", 5).first()
    assert tuple(near) == (2, 3, 4) and tuple(search.neighbours(texts, [F.col("id")], "id", 77).first()) == (None, None, None)


def test_bodies_listings_and_pages(spark, tmp_path):
    for name, html in (("A b&c.html", "<p>x</p>"), ("Z+1.html", "<p>y</p>")):
        (tmp_path / name).write_text(html)
    (tmp_path / "~$A.docx").write_text("x")
    (tmp_path / "B.docx").write_text("x")
    bodies = sources.read_bodies(spark, str(tmp_path))
    assert sorted(r["filename"] for r in bodies.collect()) == ["A b&c", "Z+1"]
    assert [r["filename"] for r in sources.list_files(spark, str(tmp_path), "docx").collect()] == ["B"]
    texts = spark.createDataFrame([(1, "A b&c"), (2, "none")], "id int, filename string")
    got = {r["id"]: (r["html"], r["has_body"]) for r in sources.with_bodies(texts, bodies).collect()}
    assert got == {1: ("<p>x</p>", True), 2: (fixed.BODY_MISSING, False)}
    lines = spark.createDataFrame([("d", 1, 0, "a"), ("d", 1, 1, "1 / 2"), ("d", 2, 0, "b"), ("d", 2, 1, "c"), ("d", 2, 2, "Page 2")], "doc string, page int, pos int, line string")
    assert sources.page_texts(lines).first()["text"] == "a\n\nb\nc"
    sinks.write_texts(bodies, str(tmp_path / "written"))
    assert spark.read.text(str(tmp_path / "written")).count() == 2
    both = sources.union_files(texts.select("filename"), texts.select("filename"))
    assert both.count() == 2 and catalog.base_name(texts, "none.pdf").count() == 1
    assert catalog.sample(texts, "filename", 1).collect() == catalog.sample(texts, "filename", 1).collect()


def test_large_groups_navigate_alike(spark):
    rows = [(i % 3 if i % 7 else None, i * 37 % 101, i) for i in range(100)]
    df = spark.createDataFrame(rows, "g int, s int, id int").repartition(5)
    columns = ["g", "id", "position", "total", "prev_id", "next_id", "has_prev", "has_next"]
    a, b = (sorted((tuple(r) for r in f(df, "g", [F.desc("s"), "id"], "id").select(columns).collect()), key=str) for f in (search.navigate, search.navigate_large))
    assert a == b and search.navigate_large(df.limit(0), "g", ["id"], "id").collect() == []
