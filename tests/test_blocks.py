"""Block operators on hand-made inputs."""

from foliant.operators import blocks


def test_each_anomaly_counts(spark):
    html = "<p></p><p class='a'> </p><p>&nbsp;</p><pre></pre><p>x</p><b style='c'>y</b><i title=' style=' STYLE=d>z</i><u data-style='e'></u><script>'<p></p><b style=f>'</script>"
    df = spark.createDataFrame([(1, html), (2, "<p>\n</p>" * 50), (3, None), (4, "")], "page_id long, html string")
    got = {(r["page_id"], r["type"]): r["count"] for r in blocks.anomalies(df, "page_id", "html").groupBy("page_id", "type").count().collect()}
    assert got == {(1, "empty_element"): 3, (1, "inline_style"): 2, (2, "empty_element"): 50}


def test_reference_lines_merge(spark):
    lines = ["Un titre", "<b>→</b> X, Œuvre,", "Suite Libre", "élan", "(1990)", "[trad]", "Trad. Y", "Une ligne ordinaire qui finit.", "Un sous titre", "seule", "→ Z,", "« Guillemet", "→ W,", "→ V;", "* note", "→ U", "N.B. x", "→ T", "Tome 2", "→ S:", "SOUS TITRE", "Autre"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc long, pos long, line string")
    got = [r["merged"] for r in blocks.merge_references(df, "doc", "pos", "line").orderBy("block").collect()]
    assert got == [
        "Un titre", "→ X, Œuvre,\nSuite Libre\nélan\n(1990)\n[trad]\nTrad. Y\nUne ligne ordinaire qui finit.", "Un sous titre", "seule", "→ Z,", "« Guillemet",
        "→ W,", "→ V;", "* note", "→ U", "N.B. x", "→ T\nTome 2", "→ S:\nSOUS TITRE", "Autre",
    ]
