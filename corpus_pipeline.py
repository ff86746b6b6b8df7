"""A corpus from raw documents to token ids: every stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colprov.llm import bpe, decontaminate, jaccard_join, suffix_dedup, toxicity
from colprov.session import scratch


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are toxic with a probability of one half or more go."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a similarity of 0.8 of their five-word shingles one stays.

    It is the one with the smallest id (null ids last), of texts under one id the one with the
    smallest hash; texts are told apart, not ids. Of rows that repeat id and text the one with
    the smallest hash of all its columns stays. Texts without words link with nothing and stay.
    """
    key = F.xxhash64("doc_id", "text").alias("key")
    linked = jaccard_join.join(docs.select(key.alias("doc_id"), "text"), 5, 80, 100).select(F.col("doc_id").alias("key"), "component_id")
    rows = docs.select("doc_id", key, F.xxhash64(*docs.columns).alias("whole"))
    ranked = linked.distinct().join(rows.select("doc_id", "key").distinct(), "key")
    first = ranked.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("first"))
    gone = ranked.join(first, "component_id").where(F.col("key") != F.col("first.key")).select(F.col("key").alias("__key"))
    left = docs.withColumn("__key", key).join(gone, "__key", "left_anti")
    again = rows.groupBy(F.col("key").alias("__key")).agg(F.count("*").alias("n"), F.min("whole").alias("__whole")).where("n > 1").drop("n")
    single = left.join(again, "__key", "left_anti").select(*docs.columns)
    repeated = left.withColumn("__whole", F.xxhash64(*docs.columns)).join(again, ["__key", "__whole"], "left_semi").dropDuplicates(["__key"])
    return single.unionByName(repeated.select(*docs.columns))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 200-byte strings that occur again anywhere go from the texts; lengths follow."""
    kept = suffix_dedup.remove_repeats(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left: id, number of tokens, and digests of ids and of their decoding."""
    return bpe.digests(docs, *bpe.public_vocabulary())


STAGES = [
    ("toxicity", toxicity_stage),
    ("jaccard_join", jaccard_stage),
    ("suffix_dedup", suffix_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: Learning, suffix order and tokens cannot be said in SQL; tests hold each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
