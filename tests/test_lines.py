"""The joined frame of lineitem: the number of its tasks follows the stored bytes, its rows do not."""

from pyspark.sql import functions as F

from colprov.plans import frames as fr
from colprov.plans.registry import Tables
from colprov.plans.stream_queries import LANDED


def small(spark, tmp_path):
    n = spark.range(400)
    key = F.col("id") % 40
    n.select(
        F.when(F.col("id") % 9 > 0, key).alias("l_orderkey"), (F.col("id") % 20).alias("l_partkey"), F.lit(1).cast("long").alias("l_suppkey"), F.lit(1).alias("l_linenumber"),
        F.lit(1.0).alias("l_quantity"), F.col("id").cast("double").alias("l_extendedprice"), F.lit(0.0).alias("l_discount"), F.lit(0.0).alias("l_tax"),
        F.lit("R").alias("l_returnflag"), F.lit("F").alias("l_linestatus"), F.lit("2020-01-01").cast("timestamp").alias("l_shipdate"),
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(30).selectExpr("id AS o_orderkey", "1L AS o_custkey", "'O' AS o_orderstatus", "1.0D AS o_totalprice", "'1-URGENT' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(15).selectExpr("id AS p_partkey", "'Brand#1' AS p_brand", "'PROMO' AS p_type", "cast(id AS int) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    return Tables(spark, str(tmp_path))


def test_a_large_table_gets_tasks_by_its_bytes(spark, tmp_path, monkeypatch):
    t = small(spark, tmp_path)
    plain = sorted(map(str, fr.audit(t).collect()))
    monkeypatch.setattr(fr, "LINES_BYTES", 64)
    large = fr.audit(t)
    size = int(t.lineitem._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert large.rdd.getNumPartitions() == size // 64 > 8
    assert sorted(map(str, large.collect())) == plain and len(plain) > 0


def test_landed_verdicts_are_written_by_more_than_one_task_a_batch():
    assert LANDED > 1
