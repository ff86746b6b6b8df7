"""Tables that landed in few files are dealt by their size."""

from colprov.plans import registry as R


def parts(df) -> int:
    return df.rdd.getNumPartitions()


def table(spark, folder, rows=200_000):
    spark.range(rows).selectExpr("id", "xxhash64(id) AS v").coalesce(1).write.parquet(f"{folder}/t.parquet")
    return spark.read.parquet(f"{folder}/t.parquet")


def test_a_larger_table_has_more_parts(spark, tmp_path, monkeypatch):
    """A task's share of a table in one file stays the same when the table grows."""
    df = table(spark, tmp_path)
    cores = spark.sparkContext.defaultParallelism
    assert parts(R.spread(df)) == cores
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    monkeypatch.setattr(R, "PART_BYTES", size // 40)
    assert parts(R.spread(df)) >= 40
    assert R.spread(df).agg({"id": "sum"}).first()[0] == sum(range(200_000))
