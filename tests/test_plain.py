"""Plain texts and DOCX files on hand-made inputs."""

import io
import zipfile

from pyspark.sql import functions as F

from foliant.operators import plain
from foliant.sources import docx

TEXT = (
    "→ Avant\n\nLE TITRE\n\nUn sous titre\n\nUne phrase. »  « Une autre. -> Élie Kant, Œuvre, 1781\nTrad. X\n\nChez Elie KANT (1781) rien\n\n"
    "Trad. d'un autre (XVIIIe siècle)\n\n" + "Long " * 20 + "\n\n<b></b>\n\n[[FOOTNOTES]]\n [1] Note : une \r\n\n[2] Deux"
)


def test_text_blocks(spark):
    df = spark.createDataFrame([("a", TEXT, "Élie Kant"), ("b", None, None), ("c", "seul", None)], "doc string, text string, author string")
    got = [(r["html"].strip()[:12], r["role"]) for r in plain.text_blocks(df).where("doc = 'a'").orderBy("pos").collect()]
    assert got == [
        ("→ Avant", "reference"), ("LE TITRE", "title"), ("Un sous titr", "subheading"), ("Une phrase. ", "paragraph"), ("« Une autre.", "paragraph"), ("→ Élie Kant,", "reference"),
        ("Chez Elie KA", "reference"), ("Trad. d'un a", "reference"), ("Long Long Lo", "paragraph"), ("[1] Note : u", "footnote"), ("[2] Deux", "footnote"),
    ]
    html = {r["doc"]: r["html"] for r in plain.render(plain.text_blocks(df)).collect()}
    assert html["c"] == '<div class="text-body-title">seul</div>' and "b" not in html
    assert '<div class="text-body-reference">Élie Kant, <i>Œuvre</i>, 1781<br><span class="ref-translator">Trad. X</span></div>' in html["a"]
    assert html["a"].endswith('<div class="footnotes"><div class="footnote-item">[1] Note : une</div><div class="footnote-item">[2] Deux</div></div>')


def test_reference_format(spark):
    cases = {"<b>→</b> A, B (1990)": "A, <i>B</i>(1990)", "→ A, <i>B</i>, c": "A, <i>B</i>, c", "A sans virgule": "A sans virgule", "A, fin": "A, fin"}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r["x"]: r["y"] for r in df.select("x", plain.format_reference(F.col("x")).alias("y")).collect()} == cases


def document(*paragraphs: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{"".join(paragraphs)}</w:body></w:document>')
    return out.getvalue()


def test_docx(spark):
    run = lambda text, style="": f"<w:r><w:rPr>{style}</w:rPr><w:t>{text}</w:t></w:r>"
    content = document(f"<w:p>{run('Un ')}{run('gras', '<w:b/>')}{run(' deux', '<w:b/>')}{run(' &lt; ', '<w:i w:val=&quot;0&quot;/>'.replace('&quot;', chr(34)))}{run('x', '<w:u/><w:vertAlign w:val=' + chr(34) + 'superscript' + chr(34) + '/>')}</w:p>", "<w:p></w:p>", f"<w:p>{run('Fin')}<w:r><w:br/></w:r></w:p>")
    df = spark.createDataFrame([("a", bytearray(content)), ("b", bytearray(b"no")), ("c", None)], "path string, content binary")
    got = {r["path"]: r for r in docx.convert(df).collect()}
    assert got["a"]["html"] == "<p>Un <strong>gras deux</strong> &lt; <u><sup>x</sup></u></p><p>Fin<br /></p>" and got["a"]["text"] == "Un gras deux < x\n\n\n\nFin\n"
    assert got["a"]["error"] is None and got["b"]["html"] is None and got["b"]["error"] and got["c"]["error"]
