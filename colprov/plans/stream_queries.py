"""The incremental jobs, run over files that Spark writes from the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprov.operators import cells as C
from colprov.plans import frames as fr
from colprov.plans import sieve_queries as sq
from colprov.plans.registry import Tables, query
from colprov.session import scratch
from colprov.streaming import jobs as L

DOC = "doc_id bigint, ds string, lang string, text string"


@query(
    "l1_incremental_sieve",
    f"""WITH {sq.HITS_SQL}, {sq.WORDS_SQL}, a AS (SELECT doc_id, pos, col FROM hits JOIN cols USING (ds) WHERE regexp_matches(sentence, '(^|[^A-Za-z0-9_])' || col || '([^A-Za-z0-9_]|$)')),
   g AS (SELECT doc_id, pos, array_to_string(list_transform(list_sort(list(DISTINCT struct_pack(l := -length(col), c := col))), lambda x: x.c), '|') AS columns FROM a GROUP BY ALL)
   SELECT doc_id, pos, family, trigger, coalesce(columns, '') AS columns FROM hits LEFT JOIN g USING (doc_id, pos)""",
)
def l1(t: Tables):
    """Files picked up two at a time until none is left; the same hits as the batch sieve."""
    folder, sink, check = (scratch(t.spark, n) for n in ("cards", "hits", "progress"))
    sq.cards(t).repartition(4, "doc_id").write.parquet(folder)
    q = L.run_sieve(t.spark, folder, DOC, sq.columns(t), sink, check, files_per_batch=2, warn=sq.WARN, define=sq.DEFINE, condition=sq.COND, assign=sq.ASSIGN)
    q.awaitTermination()
    out = t.spark.read.parquet(sink)
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), "family", "trigger", F.array_join("columns", "|").alias("columns"))


ORDER = ["ts", "tie1", "tie2"]
#: Files of one batch: each is written, and later read, by a task of its own.
LANDED = 16
VERDICT = "model string, ds string, cond int, seed int, col string, verdict string, status string, ts timestamp, tie1 bigint, tie2 double"


def landed_cells(t: Tables) -> DataFrame:
    return fr.records(t).select(
        "model", "ds", "cond", F.col("seed").cast("int").alias("seed"), "col", F.when(F.col("confidence") > 5, F.col("verdict")).otherwise("").alias("verdict"),
        F.when(F.col("provider") == "P", "ERROR 429").otherwise("ok").alias("status"), "ts", "tie1", "tie2",
    )


@query(
    "l2_newest_verdict_stream",
    f"""WITH {fr.RECORDS_SQL}, ok AS (SELECT * FROM records WHERE confidence > 5 AND provider <> 'P')
   SELECT model, ds, cond, seed, col, verdict, ts FROM (SELECT *, row_number() OVER (PARTITION BY model, ds, cond, seed, col ORDER BY ts DESC, tie1 DESC, tie2 DESC) AS rn FROM ok) WHERE rn = 1""",
)
def l2(t: Tables):
    """Cells land in files in any order; failed and empty answers never show up."""
    folder, sink, check = (scratch(t.spark, n) for n in ("landed", "verdicts", "progress"))
    landed_cells(t).repartition(3 * LANDED, "tie1").write.parquet(folder)
    L.run_verdicts(t.spark, folder, VERDICT, sink, check, ORDER, files_per_batch=LANDED, deltas=1).awaitTermination()
    return L.current_verdicts(t.spark, sink, VERDICT, ORDER).select("model", "ds", "cond", "seed", "col", "verdict", "ts")


@query(
    "l2_versioned_upsert",
    f"""WITH {fr.RECORDS_SQL}, ok AS (SELECT * FROM records WHERE confidence > 5 AND provider <> 'P'),
   n AS (SELECT version, model, ds, verdict, row_number() OVER (PARTITION BY version, model, ds, cond, seed, col ORDER BY ts DESC, tie1 DESC, tie2 DESC) AS rn
         FROM ok JOIN (SELECT unnest([0, 1, 2]) AS version) ON tie1 % 3 <= version)
   SELECT version, model, ds, count(*) AS n_keys, count(*) FILTER (WHERE verdict = 'UNAVAILABLE') AS n_unavailable FROM n WHERE rn = 1 GROUP BY ALL""",
)
def l2b(t: Tables):
    """The snapshot as of each of three batches; the last batch is run twice."""
    sink, rows = scratch(t.spark, "upserts"), C.usable(landed_cells(t), raw="verdict", status="status")
    for batch in (0, 1, 2, 2):
        L.upsert_verdicts(rows.where(F.col("tie1") % 3 == batch), batch, sink, ORDER, buckets=8, deltas=1)
    each = [L.current_verdicts(t.spark, sink, VERDICT, ORDER, v).withColumn("version", F.lit(v)) for v in L.versions(t.spark, sink)]
    return reduce(DataFrame.unionByName, each).groupBy("version", "model", "ds").agg(
        F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("verdict") == "UNAVAILABLE").alias("n_unavailable")
    )
