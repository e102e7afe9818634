"""Row numbers that don't depend on how a table is scanned."""

from pyspark.sql import functions as F

from foliant.runtime import numbered


def test_numbers_stay_when_splits_change(spark, tmp_path):
    path = str(tmp_path / "a table")  # a blank in the path
    spark.range(10_000).select("id", F.concat(F.lit("x"), "id").alias("_number")).repartition(16).write.parquet(path)
    seen = []
    for size, cores in (("128m", 8), ("4k", 6), ("1m", 3)):
        settings = {"spark.sql.files.maxPartitionBytes": size, "spark.sql.leafNodeDefaultParallelism": str(cores), "spark.sql.files.openCostInBytes": "1"}
        before = {k: spark.conf.get(k, None) for k in settings}
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = numbered(spark.read.parquet(path), "rows").select("uid", "row.id", "row._number").collect()
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        seen.append({r["uid"]: (r["id"], r["_number"]) for r in rows})
    assert len(seen[0]) == 10_000 and seen[0] == seen[1] == seen[2]


def test_numbers_of_other_plans(spark):
    df = spark.range(50).withColumn("k", F.rand())
    first = numbered(df, "rows")
    assert sorted(first.collect()) == sorted(first.collect())
    assert numbered(df.limit(0), "rows").collect() == []
