"""Writers: catalog, html and text files, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import fixed


def catalog_lines(rows: DataFrame, header: str = fixed.CATALOG_HEADER) -> DataFrame:
    """value: the header, then rows (id, filename, analysis, notions as text) as tab-joined lines, by id (9999 if it is none), then ``pos``."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("id", "filename", "analysis", "notions")]
    number = F.coalesce(F.trim(F.col("id").cast("string")).try_cast("bigint"), F.lit(9999).cast("long"))
    lines = rows.select(F.lit(1).alias("part"), number.alias("n"), F.col("pos").cast("long").alias("p"), F.concat_ws("\t", *cells).alias("value"))
    first = rows.sparkSession.createDataFrame([(0, 0, 0, header)], lines.schema)
    return first.unionByName(lines).orderBy("part", "n", "p").select("value")


def write_catalog(rows: DataFrame, path: str, header: str = fixed.CATALOG_HEADER) -> None:
    """Overwrite a catalog with rows: a folder of one text file, header first. A catalog is small: it is one file by its format."""
    catalog_lines(rows, header).coalesce(1).write.mode("overwrite").text(path)


def write_texts(rows: DataFrame, path: str, name: str = "filename", text: str = "html") -> None:
    """Texts below ``path``, a folder ``name=...`` each; a new version goes to a new path, so that the old one stays."""
    rows.select(F.col(name).alias("name"), F.col(text).alias("value")).write.partitionBy("name").mode("errorifexists").text(path)


def _cell(x: Column) -> Column:
    return F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))


def report_rows(anomalies: DataFrame) -> DataFrame:
    """doc, n, lines: of each document its anomalies as table lines in their order (``pos``); anomalies are (doc, pos, type, message, text, details)."""
    told = F.when(F.col("details") != "", F.concat(F.lit(" ("), F.col("details"), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("| `"), F.col("type"), F.lit("` | "), F.col("message"), F.lit(" | *"), _cell(F.col("text")), F.lit("*"), F.coalesce(told, F.lit("")), F.lit(" |"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"])
    return anomalies.groupBy("doc").agg(F.count("*").alias("n"), ordered.alias("lines"))


def type_counts(anomalies: DataFrame) -> DataFrame:
    """type, description, n: the most frequent first, those of equal counts by type."""
    known = F.create_map(*[F.lit(v) for pair in fixed.ANOMALY_TYPES.items() for v in pair])
    counted = anomalies.groupBy("type").agg(F.count("*").alias("n"))
    return counted.select("type", F.coalesce(F.try_element_at(known, F.col("type")), F.col("type")).alias("description"), "n").orderBy(F.desc("n"), "type")


def report(files: DataFrame, anomalies: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """value: the lines of the Markdown report on ``files`` (doc), their ``anomalies`` and ``errors`` (doc, error), in order.

    Totals, errors, counts by type, then a table for each document, by name.
    The lines of one document are one row until they are exploded.
    """
    spark = files.sparkSession
    errors = errors if errors is not None else spark.createDataFrame([], "doc string, error string")
    totals = files.agg(F.count("*").alias("files")).crossJoin(anomalies.agg(F.count_distinct("doc").alias("bad"), F.count("*").alias("all"))).crossJoin(errors.agg(F.count_distinct("doc").alias("failed")))  # one row each
    said = lambda name, c: F.concat(F.lit(f"- **{name} :** "), F.col(c).cast("string"))
    top = F.array(
        F.lit("# Rapport de Diagnostic Visuel Géométrique (PDF vs HTML)"), F.lit(""),
        F.lit("Ce rapport liste les écarts structurels, visuels et typographiques entre les PDF originaux de référence et le formatage final HTML."), F.lit(""),
        F.lit("## Statistiques"), F.lit(""), said("Nombre total de fichiers analysés", "files"), said("Fichiers avec anomalies détectées", "bad"), said("Nombre total d'anomalies", "all"),
    )
    failed = F.when(F.col("failed") > 0, F.array(said("Fichiers avec erreurs d'analyse", "failed"))).otherwise(F.array().cast("array<string>"))
    rule = F.array(F.lit(""), F.lit("---"), F.lit(""))
    empty = F.when(F.col("all") == 0, F.array(F.lit("✅ Aucune anomalie détectée sur l'échantillon analysé !"))).otherwise(F.array().cast("array<string>"))
    detail = F.array(F.lit("## Détail des Anomalies par Fichier"), F.lit(""))

    def part(df: DataFrame, section: int, name: Column, lines: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), name.alias("name"), F.posexplode(lines).alias("at", "value"))

    none = F.lit("")
    by_doc = errors.groupBy("doc").agg(F.sort_array(F.collect_list("error")).alias("e"))
    bulleted = F.concat(F.array(F.concat(F.lit("### "), F.col("doc"))), F.transform("e", lambda e: F.concat(F.lit("- ⚠️ "), e)), F.array(F.lit("")))
    counts = type_counts(anomalies).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "type", "description", "n"))).alias("c")).where("size(c) > 0")
    table = F.transform("c", lambda c: F.concat(F.lit("| `"), c["type"], F.lit("` | "), c["description"], F.lit(" | "), c["n"].cast("string"), F.lit(" |")))
    summed = F.concat(F.array(F.lit("### Résumé par Type de Défaut"), F.lit(""), F.lit("| Type d'Anomalie | Description | Nombre d'occurrences |"), F.lit("| --- | --- | --- |")), table, rule)
    listed = F.concat(
        F.array(F.concat(F.lit("### "), F.col("doc")), F.lit(""), F.concat(F.lit("Nombre d'anomalies : **"), F.col("n").cast("string"), F.lit("**")), F.lit(""), F.lit("| Type | Message | Extrait / Détail |"), F.lit("| --- | --- | --- |")),
        F.col("lines"), F.array(F.lit("")),
    )
    parts = [
        part(totals, 0, none, F.concat(top, failed, rule)),
        part(totals.where("failed > 0"), 1, none, F.array(F.lit("## Erreurs d'Exécution / Fichiers Manquants"), F.lit(""))),
        part(by_doc, 2, F.col("doc"), bulleted),
        part(totals.where("failed > 0"), 3, none, F.array(F.lit("---"), F.lit(""))),
        part(totals, 4, none, F.concat(detail, empty)),
        part(counts, 5, none, summed),
        part(report_rows(anomalies), 6, F.col("doc"), listed),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.orderBy("section", "name", "at").select("value")
