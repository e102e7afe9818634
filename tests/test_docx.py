"""DOCX packages with headings, lists, tables, links and notes, made here, against html by hand."""

import io
import zipfile

from foliant.sources import docx

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def run(text, about=""):
    return f"<w:r><w:rPr>{about}</w:rPr><w:t>{text}</w:t></w:r>"


def p(*content, style=None, num=None, level=0):
    about = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr>' if num else "")
    return f"<w:p><w:pPr>{about}</w:pPr>{''.join(x if x.startswith('<') else run(x) for x in content)}</w:p>"


def table(*rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{cell}</w:tc>" for cell in row) + "</w:tr>" for row in rows) + "</w:tbl>"


def note(n):
    return f'<w:r><w:footnoteReference w:id="{n}"/></w:r>'


def package(body, **others):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        for name, text in others.items():
            archive.writestr({"rels": "word/_rels/document.xml.rels"}.get(name, f"word/{name}.xml"), text)
    return bytearray(out.getvalue())


STYLES = f'<w:styles {NS}><w:style w:styleId="Titre1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="Puce"><w:name w:val="List Bullet"/><w:pPr><w:numPr><w:numId w:val="7"/></w:numPr></w:pPr></w:style></w:styles>'
LEVELS = "".join(f'<w:lvl w:ilvl="{i}"><w:numFmt w:val="{f}"/></w:lvl>' for i, f in enumerate(("decimal", "lowerLetter", "bullet")))
NUMBERING = f'<w:numbering {NS}><w:abstractNum w:abstractNumId="0">{LEVELS}</w:abstractNum><w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="3"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="7"><w:abstractNumId w:val="1"/></w:num></w:numbering>'
NOTES = f'<w:footnotes {NS}><w:footnote w:type="separator" w:id="0"><w:p/></w:footnote><w:footnote w:id="2">{p("Deux")}</w:footnote><w:footnote w:id="1">{p(" Un ", run("i", "<w:i/>"))}{p("suite")}</w:footnote><w:footnote w:id="9">{p("jamais")}</w:footnote></w:footnotes>'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId4" Target="http://x.org/?a=1&amp;b=&quot;2&quot;"/></Relationships>'


def convert(spark, **files):
    df = spark.createDataFrame(list(files.items()), "path string, content binary")
    return {r["path"]: r for r in docx.convert(df).collect()}


def test_headings_lists_links_and_notes(spark):
    body = (
        p("Titre", style="Titre1") + p("Avant", note(2)) + p("un", num=3) + p("a", num=3, level=1) + p("b", note(1), num=3, level=1) + p("puce", num=3, level=2) + p("deux", num=3)
        + p("") + p("rond", style="Puce") + p("seul", num=99) + p("zero", num=3) + p('<w:hyperlink r:id="rId4">' + run("lien", "<w:b/>") + "</w:hyperlink>", " et ", '<w:hyperlink w:anchor="ici">' + run("là") + "</w:hyperlink>")
    )
    got = convert(spark, a=package(body, styles=STYLES, numbering=NUMBERING, footnotes=NOTES, rels=RELS))["a"]
    ref = lambda n, k: f'<sup><a href="#footnote-{n}" id="footnote-ref-{n}">[{k}]</a></sup>'
    assert got["html"] == (
        f"<h1>Titre</h1><p>Avant{ref(2, 1)}</p><ol><li>un<ol><li>a</li><li>b{ref(1, 2)}<ul><li>puce</li></ul></li></ol></li><li>deux</li></ol>"
        '<ul><li>rond</li></ul><p>seul</p><ol><li>zero</li></ol><p><a href="http://x.org/?a=1&amp;b=&quot;2&quot;"><strong>lien</strong></a> et <a href="#ici">là</a></p>'
        '<ol><li id="footnote-2"><p>Deux <a href="#footnote-ref-2">↑</a></p></li><li id="footnote-1"><p>Un <em>i</em></p><p>suite <a href="#footnote-ref-1">↑</a></p></li></ol>'
    )
    assert got["text"].split("\n\n") == ["Titre", "Avant", "un", "a", "b", "puce", "deux", "", "rond", "seul", "zero", "lien et là"]


def test_tables_within_tables(spark):
    inner = table([p("x"), p("")])
    body = table([p("a") + p("b"), p("1", num=3) + p("2", num=3)], [inner + p("c")]) + table([p("d")]) + p("fin")
    got = convert(spark, a=package(body, numbering=NUMBERING), b=bytearray(b"no"), c=package(""), d=None)
    assert got["a"]["html"] == (
        "<table><tr><td><p>a</p><p>b</p></td><td><ol><li>1</li><li>2</li></ol></td></tr><tr><td><table><tr><td><p>x</p></td><td></td></tr></table><p>c</p></td></tr></table>"
        "<table><tr><td><p>d</p></td></tr></table><p>fin</p>"
    )
    assert (got["c"]["html"], got["c"]["text"], got["c"]["error"]) == ("", "", None)
    assert got["b"]["html"] is None and got["b"]["error"] and got["d"]["error"]
