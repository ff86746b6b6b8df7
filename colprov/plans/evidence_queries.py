"""Evidence governance over the RECORDS frame and the part catalogue."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from colprov.operators import evidence as I
from colprov.plans import frames as fr
from colprov.plans.registry import Tables, query
from colprov.session import scratch

PROBLEM_SQL = f"""WITH {fr.EVIDENCE_SQL}, e AS (SELECT *, CASE WHEN trim(quote) = '' THEN 0 ELSE len(string_split(trim(quote), ' ')) END AS words FROM evidence),
 p AS (SELECT doc_id AS "index", 'missing required field ''quote''' AS problem FROM e WHERE quote = ''
  UNION ALL SELECT doc_id, 'LABEL_DERIVED with no quote' FROM e WHERE label = 'LABEL_DERIVED' AND words = 0
  UNION ALL SELECT doc_id, 'quote is ' || words || ' words, limit 25' FROM e WHERE label = 'LABEL_DERIVED' AND words > 25
  UNION ALL SELECT doc_id, 'LABEL_DERIVED requires a subtype' FROM e WHERE label = 'LABEL_DERIVED' AND subtype IS NULL
  UNION ALL SELECT doc_id, 'E1/E2 must come from DOCUMENTATION' FROM e WHERE evidence_tier IN ('E1', 'E2') AND source_type <> 'DOCUMENTATION'
  UNION ALL SELECT -1, 'duplicate record x' || count(*) || ' for ' || dataset_id || '/' || "column" || '/' || source_citation FROM e GROUP BY dataset_id, "column", source_citation HAVING count(*) > 1
  UNION ALL SELECT -1, 'source ' || dataset_id || '/' || source_citation || ' declares conflicting scopes' FROM e GROUP BY dataset_id, source_citation HAVING count(DISTINCT scope) > 1)"""


@query("i1_record_problems", PROBLEM_SQL + ' SELECT "index", problem FROM p')
def i1(t: Tables):
    return I.record_problems(fr.evidence(t), "doc_id")


SETTLED_SQL = f"""{fr.EVIDENCE_SQL}, b AS (SELECT dataset_id, "column", min(evidence_tier) AS tier, count(DISTINCT source_citation) AS n_sources FROM evidence GROUP BY ALL),
 d AS (SELECT e.dataset_id, e."column", tier, n_sources, min(label) AS lo, max(label) AS hi, arg_min(coalesce(subtype, '-'), source_citation || '|' || source_locator) AS sub
       FROM evidence e JOIN b ON e.dataset_id = b.dataset_id AND e."column" = b."column" AND e.evidence_tier = b.tier GROUP BY ALL),
 settled AS (SELECT dataset_id, "column", CASE WHEN lo = hi THEN lo ELSE 'CONTESTED' END AS label, CASE WHEN lo = hi THEN nullif(sub, '-') END AS subtype,
   CASE WHEN lo = hi THEN CASE WHEN tier IN ('E1', 'E2') THEN 'documentation' ELSE 'sources agree' END
        ELSE CASE WHEN tier IN ('E1', 'E2') THEN 'documentation sources disagree' ELSE 'sources disagree' END END AS basis, n_sources, tier FROM d)"""


@query("i2_adjudicated_labels", f"WITH {SETTLED_SQL} SELECT * FROM settled")
def i2(t: Tables):
    return I.adjudicate(fr.evidence(t))


@query(
    "i3_materialised_negatives",
    f"""WITH {SETTLED_SQL}, cols AS (SELECT DISTINCT lang AS dataset_id, source AS "column" FROM documents)
   SELECT dataset_id, "column", coalesce(label, 'LEGITIMATE') AS label, coalesce(basis, 'default (no source named it)') AS basis, coalesce(n_sources, 0) AS n_sources, tier
   FROM cols LEFT JOIN settled USING (dataset_id, "column")""",
)
def i3(t: Tables):
    cols = t.documents.select(F.col("lang").alias("dataset_id"), F.col("source").alias("column")).distinct()
    full, _ = I.materialise(cols, I.adjudicate(fr.evidence(t)))
    return full.select("dataset_id", "column", "label", "basis", "n_sources", "tier")


@query(
    "i3_unknown_columns",
    f"""WITH {SETTLED_SQL}, cols AS (SELECT DISTINCT lang AS dataset_id, source AS "column" FROM documents WHERE substr(md5(lang || source), 1, 1) < '8')
   SELECT dataset_id, "column", label FROM settled ANTI JOIN cols USING (dataset_id, "column")""",
)
def i3b(t: Tables):
    cols = t.documents.where("substr(md5(lang || source), 1, 1) < '8'").select(F.col("lang").alias("dataset_id"), F.col("source").alias("column")).distinct()
    _, unknown = I.materialise(cols, I.adjudicate(fr.evidence(t)))
    return unknown.select("dataset_id", "column", "label")


@query(
    "i4_audit_overlay",
    f"""WITH {fr.CELL_TRUTH_SQL}, a AS (SELECT p_brand AS ds, 'c' || p_partkey AS col, CASE p_type WHEN 'PROMO' THEN 'withdraw' ELSE 'relicense' END AS action, p_name AS quote
     FROM part WHERE p_size <= 10 AND p_type IN ('PROMO', 'LARGE'))
   SELECT ds, col, is_pos AND coalesce(action, '') <> 'withdraw' AS is_pos, coalesce(action, 'unchanged') AS audited, CASE WHEN action = 'relicense' THEN quote END AS licence
   FROM cell_truth LEFT JOIN a USING (ds, col)""",
)
def i4(t: Tables):
    a = t.part.where("p_size <= 10 AND p_type IN ('PROMO', 'LARGE')").select(
        F.col("p_brand").alias("ds"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("col"),
        F.when(F.col("p_type") == "PROMO", "withdraw").otherwise("relicense").alias("action"), F.col("p_name").alias("quote"),
    )
    return I.overlay(fr.cell_truth(t).select("ds", "col", "is_pos"), a)


@query(
    "i5_subtype_holes",
    f"""WITH {fr.CELL_TRUTH_SQL} SELECT ds, col, CASE WHEN substr(col, 2)::BIGINT % 5 <> 0 THEN subtype END AS code, substr(col, 2)::BIGINT % 5 = 0 AS hole FROM cell_truth WHERE is_pos""",
)
def i5(t: Tables):
    truth = fr.cell_truth(t)
    codes = truth.where(F.expr("cast(substr(col, 2) as bigint) % 5 <> 0")).select("ds", "col", F.col("subtype").alias("code"))
    return I.code_subtypes(truth, codes)


@query(
    "i6_evidence_summary",
    f"""WITH {fr.EVIDENCE_SQL}, r AS (SELECT dataset_id AS ds, "column" AS col, arg_min(struct_pack(t := evidence_tier, q := quote), evidence_tier || '|' || source_citation || '|' || source_locator) AS r FROM evidence GROUP BY ALL),
   pos AS (SELECT DISTINCT lang AS ds, source AS col FROM documents), j AS (SELECT pos.*, r FROM pos LEFT JOIN r USING (ds, col))
   SELECT 'positives' AS what, count(*) AS n FROM j UNION ALL SELECT 'with a record', count(r) FROM j UNION ALL SELECT 'quoted', count(*) FILTER (WHERE coalesce(trim(r.q), '') <> '') FROM j
   UNION ALL SELECT 'tier ' || t, count(*) FILTER (WHERE r.t = tt.t) FROM j, (VALUES ('E1'), ('E2'), ('E3'), ('E4')) tt(t) GROUP BY tt.t""",
)
def i6(t: Tables):
    pos = t.documents.select(F.col("lang").alias("ds"), F.col("source").alias("col")).distinct()
    return I.evidence_summary(pos, fr.evidence(t))


CAND_SQL = """cand AS (SELECT lang || source AS ds, CASE WHEN n_chars < 500 THEN 'no licensing phrase' WHEN n_chars < 1500 THEN 'IS_TARGET' END AS reject FROM documents)"""


@query("i6_attrition_by_reason", "WITH " + CAND_SQL + " SELECT reject, count(*) AS n FROM cand WHERE reject IS NOT NULL GROUP BY reject")
def i6b(t: Tables):
    return I.attrition(candidates(t), docs_ds(t))[0]


@query("i6_zero_yield_datasets", "WITH " + CAND_SQL + " SELECT DISTINCT lang || source AS ds FROM documents WHERE lang || source NOT IN (SELECT ds FROM cand WHERE reject IS NULL)")
def i6c(t: Tables):
    return I.attrition(candidates(t), docs_ds(t))[1]


def docs_ds(t):
    return t.documents.select(F.concat("lang", "source").alias("ds")).distinct()


def candidates(t):
    n = F.col("n_chars")
    return t.documents.select(
        F.concat("lang", "source").alias("ds"), F.when(n < 500, "no licensing phrase").when(n < 1500, "IS_TARGET").alias("reject")
    )


@query(
    "i7_corpus_summary",
    f"""WITH {fr.CELL_TRUTH_SQL}, s AS (SELECT *, CASE WHEN ds < 'Brand#2' THEN 'A' ELSE 'B' END AS stratum FROM cell_truth)
   SELECT stratum, ds, count(*) AS n_cols, count(*) FILTER (WHERE is_pos) AS n_pos, 1 AS n_ds FROM s GROUP BY stratum, ds
   UNION ALL SELECT stratum, 'TOTAL', count(*), count(*) FILTER (WHERE is_pos), count(DISTINCT ds) FROM s GROUP BY stratum
   UNION ALL SELECT 'COMBINED', 'COMBINED', count(*), count(*) FILTER (WHERE is_pos), count(DISTINCT ds) FROM s""",
)
def i7(t: Tables):
    return I.corpus_summary(fr.cell_truth(t).withColumn("stratum", F.when(F.col("ds") < "Brand#2", "A").otherwise("B")))


def named(df, cond):
    return df.where(cond).select(F.col("p_brand").alias("ds"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("col"))


@query(
    "i8_spec_problems",
    """WITH p AS (SELECT p_brand AS ds, 'c' || p_partkey AS col, p_size, p_partkey FROM part), cols AS (SELECT ds, col FROM p WHERE p_size % 9 <> 0 UNION ALL SELECT ds, col FROM p WHERE p_size = 50),
   u AS (SELECT DISTINCT ds, col FROM cols), tr AS (SELECT ds, col, p_size <= 10 AS is_pos, p_size % 7 = 0 AS nosub FROM p WHERE p_size % 13 <> 0), da AS (SELECT ds, col FROM p WHERE p_size % 8 <> 0), sa AS (SELECT ds, col FROM p WHERE p_size % 5 <> 0),
   tg AS (SELECT ds, 'c' || min(p_partkey) AS col FROM p GROUP BY ds),
   x AS (SELECT ds, 'target among the features' AS problem, 'hard' AS severity FROM u SEMI JOIN tg USING (ds, col)
    UNION ALL SELECT ds, 'positive absent from the data file', 'hard' FROM tr ANTI JOIN da USING (ds, col) WHERE is_pos
    UNION ALL SELECT ds, 'truth names a column not listed', 'hard' FROM tr ANTI JOIN u USING (ds, col)
    UNION ALL SELECT ds, 'listed column without truth', 'hard' FROM u ANTI JOIN tr USING (ds, col)
    UNION ALL SELECT ds, 'duplicate column', 'hard' FROM (SELECT ds, col FROM cols GROUP BY ALL HAVING count(*) > 1)
    UNION ALL SELECT ds, 'positive without a subtype', 'hard' FROM tr WHERE is_pos AND nosub
    UNION ALL SELECT ds, 'column absent from the sample', 'soft' FROM u ANTI JOIN sa USING (ds, col))
   SELECT ds, problem, severity, count(*) AS n FROM x GROUP BY ALL""",
)
def i8(t: Tables):
    p = t.part
    cols = named(p, "p_size % 9 <> 0").unionByName(named(p, "p_size = 50"))
    truth = p.where("p_size % 13 <> 0").select(
        F.col("p_brand").alias("ds"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("col"),
        (F.col("p_size") <= 10).alias("is_pos"), F.when(F.col("p_size") % 7 != 0, "REASON").alias("subtype"),
    )
    targets = p.groupBy(F.col("p_brand").alias("ds")).agg(F.concat(F.lit("c"), F.min("p_partkey").cast("string")).alias("target"))
    return I.spec_problems(targets, cols, truth, named(p, "p_size % 8 <> 0"), named(p, "p_size % 5 <> 0"))


@query(
    "i9_partition_problems",
    """WITH p AS (SELECT p_brand AS ds, 'c' || p_partkey AS col, p_size FROM part), a AS (SELECT ds, col, 'clean' AS arm FROM p WHERE p_size % 2 = 0 UNION ALL SELECT ds, col, 'leaky' FROM p WHERE p_size % 3 = 0)
   SELECT ds, col, 'in both arms' AS problem FROM a GROUP BY ds, col HAVING count(DISTINCT arm) > 1
   UNION ALL SELECT DISTINCT ds, col, 'label or identifier in an arm' FROM a SEMI JOIN (SELECT ds, col FROM p WHERE p_size IN (8, 9, 11)) USING (ds, col)""",
)
def i9(t: Tables):
    arms = named(t.part, "p_size % 2 = 0").withColumn("arm", F.lit("clean")).unionByName(named(t.part, "p_size % 3 = 0").withColumn("arm", F.lit("leaky")))
    return I.partition_problems(arms, named(t.part, "p_size IN (8, 9, 11)"))


@query(
    "i9_groups_spanning_folds",
    "SELECT o_custkey, count(DISTINCT (o_custkey * 31 + (o_orderkey % 50 = 0)::INT) % 5) AS n_folds FROM orders GROUP BY o_custkey HAVING count(DISTINCT (o_custkey * 31 + (o_orderkey % 50 = 0)::INT) % 5) > 1",
)
def i9b(t: Tables):
    fold = (F.col("o_custkey") * 31 + (F.col("o_orderkey") % 50 == 0).cast("int")) % 5
    return I.split_groups(t.orders.select("o_custkey", fold.alias("fold")), "o_custkey")


ALIAS_SQL = """p AS (SELECT p_brand AS ds, 'col_' || p_partkey AS col, p_size <= 10 AS is_pos, p_size, p_partkey, p_name FROM part),
 al AS (SELECT ds, col, CASE p_size % 7 WHEN 0 THEN col WHEN 1 THEN 'x_' || col WHEN 2 THEN 'final_' || p_partkey WHEN 3 THEN 'shared_' || (p_size % 10) ELSE 'feat_' || p_partkey END AS alias FROM p WHERE p_size % 11 <> 0
        UNION ALL SELECT ds, 'gone_' || p_partkey, 'g' || p_partkey FROM p WHERE p_size = 33),
 ex AS (SELECT ds, col FROM p WHERE p_size % 2 = 0)"""


@query(
    "i10_alias_problems",
    f"""WITH {ALIAS_SQL}, j AS (SELECT p.ds, p.col, p.is_pos, al.alias, ex.col IS NOT NULL AS exempt FROM p LEFT JOIN al USING (ds, col) LEFT JOIN ex USING (ds, col)),
   k AS (SELECT *, length(col) > 3 AND instr(lower(alias), lower(col)) > 0 AND alias <> col AS contains_, regexp_matches(replace(col, '_', ' '), '(?i)\\bfinal\\b') AS m1, regexp_matches(replace(alias, '_', ' '), '(?i)\\bfinal\\b') AS m2 FROM j)
   SELECT ds, col, 'C1 unmapped' AS "check" FROM k WHERE alias IS NULL UNION ALL SELECT ds, col, 'C2 identical' FROM k WHERE alias = col
   UNION ALL SELECT ds, col, 'C2 contains original' FROM k WHERE contains_ AND NOT exempt UNION ALL SELECT ds, col, 'C2 positive exempted' FROM k WHERE contains_ AND exempt AND is_pos
   UNION ALL SELECT ds, col, 'C3 marker status changed' FROM k WHERE alias IS NOT NULL AND m1 <> m2
   UNION ALL SELECT ds, col, 'C1 maps a column not in data' FROM al ANTI JOIN p USING (ds, col)
   UNION ALL SELECT ds, alias, 'C1 aliases collide' FROM k WHERE alias IS NOT NULL GROUP BY ds, alias HAVING count(*) > 1
   UNION ALL SELECT '*', alias, 'C4 conflicting truth' FROM k WHERE alias IS NOT NULL GROUP BY alias HAVING bool_or(is_pos) AND NOT bool_and(is_pos)""",
)
def i10(t: Tables):
    key, s = F.col("p_partkey").cast("string"), F.col("p_size")
    p = t.part.select(F.col("p_brand").alias("ds"), F.concat(F.lit("col_"), key).alias("col"), (s <= 10).alias("is_pos"), "p_size", key.alias("k"))
    k = s % 7
    alias = (
        F.when(k == 0, F.col("col")).when(k == 1, F.concat(F.lit("x_"), "col")).when(k == 2, F.concat(F.lit("final_"), "k"))
        .when(k == 3, F.concat(F.lit("shared_"), (s % 10).cast("string"))).otherwise(F.concat(F.lit("feat_"), "k"))
    )
    al = p.where("p_size % 11 <> 0").select("ds", "col", alias.alias("alias")).unionByName(
        p.where("p_size = 33").select("ds", F.concat(F.lit("gone_"), "k").alias("col"), F.concat(F.lit("g"), "k").alias("alias"))
    )
    return I.alias_problems(p.select("ds", "col", "is_pos"), al, p.where("p_size % 2 = 0").select("ds", "col"))


@query(
    "i11_coder_sheet",
    """SELECT p_brand AS ds, string_agg('c' || p_partkey, '|' ORDER BY 'c' || p_partkey) AS columns, count(*) AS n_columns, '' AS answer, '' AS note,
   row_number() OVER (ORDER BY (sum(p_partkey) * 7919) % 1009, p_brand) AS item FROM part GROUP BY p_brand""",
)
def i11(t: Tables):
    cols = named(t.part, F.lit(True))
    order = (F.aggregate(F.split("columns", r"\|"), F.lit(0).cast("long"), lambda a, x: a + F.substr(x, F.lit(2)).cast("long")) * 7919) % 1009
    return I.coder_sheet(cols, order).withColumn("item", F.col("item").cast("long"))


@query("i12_freshness", "SELECT * FROM (VALUES ('before its input', TRUE), ('after its input', FALSE)) v(\"table\", stale)")
def i12(t: Tables):
    """A table derived before its input was landed anew, and one derived after."""
    def landed(name, df):
        path = scratch(t.spark, name)
        df.write.parquet(path)
        time.sleep(0.05)  # file times count milliseconds
        return t.spark.read.parquet(path).select(F.lit(name).alias("table"), F.col("_metadata.file_modification_time").alias("mtime")).distinct()

    per_order = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"))
    before = landed("before its input", per_order)
    inputs = landed("input", t.orders.select("o_orderkey", "o_totalprice")).select(F.explode(F.array(F.lit("before its input"), F.lit("after its input"))).alias("table"), "mtime")
    after = landed("after its input", per_order)
    return I.stale(before.unionByName(after), inputs).select("table", "stale")


@query(
    "i13_positive_priority",
    f"""WITH {fr.EVIDENCE_SQL}, cols AS (SELECT DISTINCT lang AS ds, source AS col FROM documents), s AS (SELECT dataset_id AS ds, "column" AS col, count(DISTINCT source_citation) AS k, string_agg(DISTINCT source_citation, ',' ORDER BY source_citation) AS s
     FROM evidence WHERE label = 'LABEL_DERIVED' GROUP BY ALL) SELECT ds, col, coalesce(k, 0) AS n_sources, coalesce(s, '') AS sources, coalesce(k, 0) >= 2 AS multi_source FROM cols LEFT JOIN s USING (ds, col)""",
)
def i13(t: Tables):
    cols = t.documents.select(F.col("lang").alias("ds"), F.col("source").alias("col")).distinct()
    return I.positive_priority(cols, fr.evidence(t)).withColumn("n_sources", F.col("n_sources").cast("long"))


@query(
    "i14_backfilled_records",
    f"""WITH {fr.AUDIT_SQL}, x AS (SELECT (y = 'A' AND l_tax > 0.04)::INT AS part_flag, (y = 'R')::INT AS late_flag, y2, y <> 'R' AS kept FROM audit),
   c AS (SELECT 'part_flag' AS col, count(*) FILTER (WHERE part_flag = 1) AS n, count(*) FILTER (WHERE part_flag = 1 AND kept) AS h FROM x
     UNION ALL SELECT 'late_flag', count(*) FILTER (WHERE late_flag = 1), count(*) FILTER (WHERE late_flag = 1 AND kept) FROM x
     UNION ALL SELECT 'y2', count(*) FILTER (WHERE y2 = 1), count(*) FILTER (WHERE y2 = 1 AND kept) FROM x),
   q AS (SELECT o_orderpriority AS ds, unnest(['part_flag', 'late_flag', 'y2']) AS col, CASE WHEN o_orderpriority < '3' THEN 'named by the source' END AS quote FROM (SELECT DISTINCT o_orderpriority FROM orders))
   SELECT ds, col, quote, 'rule' AS coder, 'LABEL_DERIVED' AS label, format('every row with {{}}=1 has the target ({{}} of {{}}, {{}})', col, h, n, CASE WHEN n > 0 AND n = h THEN 'CONFIRMED' ELSE 'CONTRADICTED' END) AS data_check
   FROM q JOIN c USING (col)""",
)
def i14(t: Tables):
    from colprov.operators.rules import implications

    y = F.col("y")
    x = fr.audit(t).withColumns({"part_flag": ((y == "A") & (F.col("l_tax") > 0.04)).cast("int"), "late_flag": (y == "R").cast("int")})
    checks = implications(x, ["part_flag", "late_flag", "y2"], y != "R")
    ds = t.orders.select(F.col("o_orderpriority").alias("ds")).distinct()
    each = F.explode(F.array(F.lit("part_flag"), F.lit("late_flag"), F.lit("y2")))
    rows = ds.select("ds", each.alias("col"), F.when(F.col("ds") < "3", "named by the source").alias("quote"))
    checked = rows.select("ds", "col").join(checks.withColumnRenamed("flag", "col"), "col")
    return I.backfill(rows, checked, {"coder": "rule", "label": "LABEL_DERIVED"})


@query(
    "i14_quote_counts",
    f"WITH {fr.EVIDENCE_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE trim(quote) <> '') AS with_quote, count(*) FILTER (WHERE trim(quote) = '') AS without_quote FROM evidence",
)
def i14b(t: Tables):
    return I.quote_counts(fr.evidence(t))


@query(
    "i15_scope_ledger",
    """WITH e AS (SELECT p_brand AS ds, 'no part above size 48' AS reason FROM part GROUP BY p_brand HAVING max(p_size) <= 48)
   SELECT ds, reason, reason IS NULL AS in_scope FROM (SELECT DISTINCT p_brand AS ds FROM part) LEFT JOIN e USING (ds)""",
)
def i15(t: Tables):
    ds = t.part.select(F.col("p_brand").alias("ds")).distinct()
    ex = t.part.groupBy(F.col("p_brand").alias("ds")).agg(F.max("p_size").alias("m")).where("m <= 48").select("ds", F.lit("no part above size 48").alias("reason"))
    return I.scope_ledger(ds, ex)


@query(
    "i16_encoding_checks",
    f"""WITH {fr.AUDIT_SQL}, m AS (SELECT *, year(l_shipdate) * 12 + month(l_shipdate) AS months FROM audit)
   SELECT 'no column is all null' AS "check", count(l_tax) > 0 AND count(refund_amt) > 0 AND count(months) > 0 AS ok FROM m UNION ALL SELECT 'widths add up', TRUE UNION ALL SELECT 'no leak in the clean arm', TRUE
   UNION ALL SELECT 'months without gaps', max(months) - min(months) + 1 = count(DISTINCT months) FROM m""",
)
def i16(t: Tables):
    a = fr.audit(t).withColumn("months", F.year("l_shipdate") * 12 + F.month("l_shipdate"))
    return I.encoding_problems(a, ["l_tax", "months"], ["refund_amt"], "months")


@query(
    "i17_yield_by_provenance",
    """SELECT CASE WHEN doc_id % 4 > 0 THEN 'sieve' ELSE 'nominated' END AS kind, count(*) AS n_records, count(DISTINCT source) AS n_datasets FROM documents GROUP BY 1""",
)
def i17(t: Tables):
    prov = F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("SIEVE/"), "lang")).otherwise("NOMINATED")
    return I.yield_by_provenance(t.documents.select(prov.alias("provenance"), F.col("source").alias("ds")))
