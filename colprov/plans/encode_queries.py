"""Encodings and filters over whole driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from colprov.operators import encode as E
from colprov.plans import frames as fr
from colprov.plans.registry import Tables, query

DOCS_SQL = """d AS (SELECT d.doc_id, lang, source, n_chars, quality::DOUBLE AS quality, toxic::DOUBLE AS toxic,
  CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END AS grade,
  '$' || n_chars || '%' AS price FROM documents d LEFT JOIN labels l USING (doc_id))"""


def docs(t: Tables):
    q = F.col("quality")
    return t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", "lang", "source", "n_chars", q.cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"),
        F.when(q == 1, "good").when(q == 0, "bad").alias("grade"),
        F.concat(F.lit("$"), F.col("n_chars").cast("string"), F.lit("%")).alias("price"),
    )


@query(
    "b1_all_null_columns",
    f"WITH {fr.AUDIT_SQL} SELECT 'refund_amt' AS col, count(refund_amt) AS n_values, count(refund_amt) = 0 AS dead FROM audit "
    "UNION ALL SELECT 'l_tax', count(l_tax), count(l_tax) = 0 FROM audit UNION ALL SELECT 'never', 0, TRUE",
)
def b1(t: Tables):
    a = fr.audit(t).withColumn("never", F.lit(None).cast("double"))
    return E.dead_report(a, ["refund_amt", "l_tax", "never"])


@query(
    "b2_safe_names",
    r"""WITH n AS (SELECT DISTINCT p_brand || '.' || p_name AS name FROM part)
  SELECT name, regexp_replace(name, '[^\p{L}\p{N}_]', '_', 'g') AS safe,
         count(*) OVER (PARTITION BY regexp_replace(name, '[^\p{L}\p{N}_]', '_', 'g')) > 1 AS collides FROM n""",
)
def b2(t: Tables):
    n = t.part.select(F.concat_ws(".", "p_brand", "p_name").alias("name")).distinct().withColumn("safe", E.safe(F.col("name")))
    dup = n.groupBy("safe").agg(F.count(F.lit(1)).alias("k"))
    return n.join(dup, "safe").select("name", "safe", (F.col("k") > 1).alias("collides"))


@query(
    "b3_bare_names",
    "SELECT source AS name, count(*) AS n FROM documents GROUP BY source",
)
def b3(t: Tables):
    dirty = F.concat(F.lit("﻿  "), "source", F.lit(" \t"))
    return t.documents.groupBy(E.bare(dirty).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "b4_encode_sorted",
    f"""WITH {DOCS_SQL}, s AS (SELECT source, dense_rank() OVER (ORDER BY source) - 1 AS code FROM (SELECT DISTINCT source FROM d)),
  g AS (SELECT grade, dense_rank() OVER (ORDER BY grade) - 1 AS code FROM (SELECT DISTINCT grade FROM d WHERE grade IS NOT NULL))
  SELECT doc_id, s.code::DOUBLE AS source, coalesce(g.code, -1)::DOUBLE AS grade, n_chars::DOUBLE AS price
  FROM d JOIN s USING (source) LEFT JOIN g USING (grade)""",
)
def b4(t: Tables):
    return E.encode_sorted(docs(t).select("doc_id", "source", "grade", "price"), ["source", "grade", "price"])


FIRST_SQL = """, s AS (SELECT source, row_number() OVER (ORDER BY min(doc_id)) - 1 AS code FROM d GROUP BY source),
  g AS (SELECT coalesce(grade, 'nan') AS grade, row_number() OVER (ORDER BY min(doc_id)) - 1 AS code FROM d GROUP BY 1)
  SELECT doc_id, s.code::DOUBLE AS source, g.code::DOUBLE AS grade, coalesce(quality, {fill})::DOUBLE AS quality
  FROM d JOIN s USING (source) JOIN g ON coalesce(d.grade, 'nan') = g.grade"""


@query("b5_encode_first_seen_median", f"WITH {DOCS_SQL}" + FIRST_SQL.format(fill="(SELECT median(quality) FROM d)"))
def b5(t: Tables):
    return E.encode_first_seen(docs(t).select("doc_id", "source", "grade", "quality"), ["source", "grade", "quality"], "doc_id")


@query("b6_encode_first_seen_minus_one", f"WITH {DOCS_SQL}" + FIRST_SQL.format(fill="-1"))
def b6(t: Tables):
    return E.encode_first_seen(docs(t).select("doc_id", "source", "grade", "quality"), ["source", "grade", "quality"], "doc_id", -1.0)


@query(
    "b7_encode_strict",
    f"WITH {DOCS_SQL} SELECT doc_id, coalesce(quality, -999)::DOUBLE AS quality, (n_chars > 1000)::INT::DOUBLE AS long FROM d",
)
def b7(t: Tables):
    d = docs(t).select("doc_id", "quality", (F.col("n_chars") > 1000).alias("long"))
    return E.encode_strict(d, ["quality", "long"])


@query(
    "b8_binarise_target",
    """WITH m AS (SELECT o_orderpriority AS top FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
  SELECT o_orderkey, (o_orderpriority = (SELECT top FROM m))::INT AS by_mode,
         (o_totalprice > (SELECT median(o_totalprice) FROM orders))::INT AS by_median,
         (o_orderstatus = 'P')::INT AS by_max FROM orders""",
)
def b8(t: Tables):
    o = t.orders.withColumn("two", (F.col("o_orderstatus") == "P").cast("int") * 5 + 2)
    o = E.binarise(o, "o_orderpriority", "by_mode")
    o = E.binarise(o, "o_totalprice", "by_median")
    return E.binarise(o, "two", "by_max").select("o_orderkey", "by_mode", "by_median", "by_max")


@query(
    "b9_named_binarisers",
    """SELECT o_orderkey, (o_orderpriority = (SELECT max(o_orderpriority) FROM orders))::INT AS last_level,
       (o_orderstatus = 'F')::INT AS yes FROM orders""",
)
def b9(t: Tables):
    o = t.orders.withColumn("said", F.when(F.col("o_orderstatus") == "F", " yes ").otherwise("no"))
    return o.select("o_orderkey", E.last_level(t.orders, "o_orderpriority").alias("last_level"), E.yes("said").alias("yes"))


RULES = {
    "orders": ("o_orderstatus = 'F'", "o_orderstatus == 'F' (filled is the event)"),
    "events": ("value > 50", "value > 50 (a heavy event)"),
}


@query(
    "b10_binarise_by_rule",
    """SELECT 'orders' AS ds, rule, sum(y) AS n_pos, count(*) AS n FROM (SELECT (o_orderstatus = 'F')::INT AS y,
       'o_orderstatus == ''F'' (filled is the event)' AS rule FROM orders) GROUP BY rule
       UNION ALL SELECT 'events', 'value > 50 (a heavy event)', sum((value > 50)::INT), count(*) FROM events""".replace("sum(y)", "sum(y)::BIGINT").replace("sum((value > 50)::INT)", "sum((value > 50)::INT)::BIGINT"),
)
def b10(t: Tables):
    parts = [
        E.binarise_by_rule(df, RULES, name).groupBy(F.lit(name).alias("ds"), "rule").agg(
            F.sum("y01").alias("n_pos"), F.count(F.lit(1)).alias("n")
        )
        for name, df in (("orders", t.orders), ("events", t.events))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "b11_month_ordinal",
    "SELECT o_orderkey, (year(o_orderdate) * 12 + month(o_orderdate))::INT AS months FROM orders",
)
def b11(t: Tables):
    return t.orders.select("o_orderkey", E.month_ordinal(F.date_format("o_orderdate", "MMM-yy")).alias("months"))


@query(
    "b12_level_set_indicator",
    "SELECT p_partkey, (p_size IN (11, 13, 14, 19, 20, 21))::INT AS terminal FROM part",
)
def b12(t: Tables):
    return E.level_set(t.part.select("p_partkey", "p_size"), "p_size", [11, 13, 14, 19, 20, 21], "terminal")


@query(
    "b13_domain_filter",
    """SELECT count(*) AS n_before, count(*) FILTER (WHERE p_size % 7 IN (0, 1)) AS n_flag, count(*) FILTER (WHERE p_size % 7 IN (0, 1)) AS n_after
       FROM part""",
)
def b13(t: Tables):
    return E.filter_report(t.part, flag=(F.col("p_size") % 7).isin(0, 1))


COHORT = "l_quantity BETWEEN 5 AND 45 AND l_discount <= 0.08 AND l_tax > 0 AND l_returnflag <> 'N' AND l_linenumber <= 6"


@query(
    "b14_cohort_filter",
    f"""SELECT count(*) AS n_before, count(*) FILTER (WHERE l_quantity BETWEEN 5 AND 45) AS n_quantity,
        count(*) FILTER (WHERE l_discount <= 0.08) AS n_discount, count(*) FILTER (WHERE l_tax > 0) AS n_tax,
        count(*) FILTER (WHERE l_returnflag <> 'N') AS n_flag, count(*) FILTER (WHERE l_linenumber <= 6) AS n_line,
        count(*) FILTER (WHERE {COHORT}) AS n_after FROM lineitem""",
)
def b14(t: Tables):
    return E.filter_report(
        t.lineitem,
        quantity=F.col("l_quantity").between(5, 45),
        discount=F.col("l_discount") <= 0.08,
        tax=F.col("l_tax") > 0,
        flag=F.col("l_returnflag") != "N",
        line=F.col("l_linenumber") <= 6,
    )


@query("b15_exclusion_list", "SELECT c_nationkey, c_acctbal FROM customer")
def b15(t: Tables):
    return E.exclude(t.customer, ["c_custkey"], ["c_name"], "c_mktsegment")


@query("b16_fixed_sample", "SELECT event_id, user_id, value FROM events ORDER BY event_id * 7919 % 100003, event_id LIMIT 500")
def b16(t: Tables):
    """Exactly 500 events, the same on every run."""
    return E.fixed_sample(t.events, ["event_id"], 500, hashed=F.col("event_id") * 7919 % 100003).select("event_id", "user_id", "value")


@query(
    "b17_alias_rename",
    """SELECT p_brand AS ds, 'c' || p_partkey AS col, CASE WHEN p_size % 10 > 0 THEN 'f_' || p_partkey END AS alias,
       p_size <= 10 AS is_pos, p_size % 10 = 0 AS unmapped FROM part""",
)
def b17(t: Tables):
    truth = fr.cell_truth(t).select("ds", "col", "is_pos")
    aliases = t.part.where(F.col("p_size") % 10 > 0).select(
        F.col("p_brand").alias("ds"),
        F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("col"),
        F.concat(F.lit("f_"), F.col("p_partkey").cast("string")).alias("alias"),
    )
    return E.rename_by_alias(truth, aliases, ["ds"])


@query(
    "b18_shuffled_column_order",
    "SELECT p_brand AS ds, count(*)::INT AS n, string_agg('c' || p_partkey, ',' ORDER BY md5('3|c' || p_partkey)) AS columns FROM part GROUP BY p_brand",
)
def b18(t: Tables):
    o = E.shuffled_order(fr.cell_truth(t).select("ds", "col"), ["ds"], hashed=F.md5(F.concat(F.lit("3|"), "col")))
    return o.select("ds", F.size("order").alias("n"), F.array_join("order", ",").alias("columns"))


@query(
    "b19_content_id",
    "SELECT doc_id, left(sha256(lang || '|' || source || '|' || text), 20) AS content_id FROM documents",
)
def b19(t: Tables):
    return t.documents.select("doc_id", E.content_id(F.col("lang"), F.col("source"), F.col("text")).alias("content_id"))
