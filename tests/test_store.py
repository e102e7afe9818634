"""Stored versions: failed and concurrent changes, the backup made once."""

import pytest
from pyspark.sql import functions as F

from foliant.sources import store


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_of_a_catalog(spark, tmp_path):
    path = f"file://{tmp_path}/the catalog"
    assert store.current(spark, path) is None
    with pytest.raises(FileNotFoundError):
        store.load(spark, path)
    base = spark.createDataFrame([(1, "a", "A"), (2, "b", "B"), (3, "a", "again")], "pos long, filename string, title string")
    first = store.save(base, path)
    store.upsert_stored(spark, path, spark.createDataFrame([(9, "a", "new"), (10, "c", "C")], base.schema))
    assert [r[1:] for r in rows(store.load(spark, path))] == [("a", "new"), ("b", "B"), ("a", "again"), ("c", "C")]
    store.delete_stored(spark, path, F.col("filename") == "a")
    assert [r[1:] for r in rows(store.load(spark, path))] == [("b", "B"), ("a", "again"), ("c", "C")]
    assert rows(store.load(spark, path, first)) == rows(base)

    seen = store.current(spark, path)
    bad = store.load(spark, path).withColumn("title", F.when(F.col("filename") == "c", F.raise_error(F.lit("lost"))).otherwise(F.col("title")))
    with pytest.raises(Exception, match="lost"):
        store.save(bad, path)
    assert store.current(spark, path) == seen and len(rows(store.load(spark, path))) == 3

    with pytest.raises(store.Changed):  # another change came between
        store.change(spark, path, lambda df: store.load(spark, path, store.save(df.where("filename = 'b'"), path)))
    assert [r[1] for r in rows(store.load(spark, path))] == ["b"]

    every = store.versions(spark, path)
    gone = store.vacuum(spark, path, keep=1)
    assert set(store.versions(spark, path)) == set(every) - set(gone) and first not in gone and store.current(spark, path) not in gone and gone
    assert store.restore(spark, path) == first and rows(store.load(spark, path)) == rows(base)
    store.save(base.limit(0), path)
    assert rows(store.load(spark, path)) == [] and store.restore(spark, path) == first
