"""Exported frames with a manifest, its verification, and the input inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, path: str) -> list[str]:
    """The files under a path, through the file system Spark itself uses."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found, it = [], fs.listFiles(root, True)
    while it.hasNext():
        found.append(it.next().getPath().toString())
    return found


def export_frame(df: DataFrame, columns: list[str], target: str, path: str) -> None:
    """The corpus columns and the target as gzipped CSV parts."""
    df.select(*columns, target).write.mode("errorifexists").option("header", True).option("compression", "gzip").csv(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) per part file."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path)
        .select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    )


def frame_manifest(df: DataFrame, name: str, columns: list[str], positive: str) -> DataFrame:
    """(ds, n_rows, n_cols, n_pos) of an exported frame."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.expr(positive)).alias("n_pos")).select(
        F.lit(name).alias("ds"), "n_rows", F.lit(len(columns)).cast("long").alias("n_cols"), "n_pos"
    )


def verify_manifest(recorded: DataFrame, found: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """(key.., status): ok, CHANGED, MISSING (recorded, not found) or EXTRA."""
    a = recorded.select(*key, F.struct(*values).alias("_a"))
    b = found.select(*key, F.struct(*values).alias("_b"))
    status = (
        F.when(F.col("_b").isNull(), "MISSING").when(F.col("_a").isNull(), "EXTRA").when(F.col("_a").eqNullSafe(F.col("_b")), "ok").otherwise("CHANGED")
    )
    return a.join(b, key, "full").select(*key, status.alias("status"))


def input_inventory(declared: DataFrame, landed: DataFrame) -> DataFrame:
    """Files a spec names with their provenance and whether they landed.
    ``declared``: (ds, file, provenance); ``landed``: (file)."""
    here = landed.select("file").distinct().withColumn("present", F.lit(True))
    return declared.join(here, "file", "left").withColumn("present", F.coalesce("present", F.lit(False)))
