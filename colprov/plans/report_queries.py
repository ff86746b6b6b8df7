"""Reports written from the driver tables, checked against those tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprov.operators import reports as P
from colprov.operators import score as G
from colprov.plans.registry import Tables, query
from colprov.plans.score_queries import CNT, DEC_SQL, scored


def documents(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("report_id"), "text")


PROSE_SQL = r"""l AS (SELECT doc_id AS report_id, unnest(generate_series(1, len(p))) AS line_no, trim(unnest(p)) AS t FROM (SELECT doc_id, string_split_regex(text, '\r?\n') AS p FROM documents)),
 s AS (SELECT *, t = '' OR regexp_matches(t, '^(\||#|>|\*\[)') AS skip FROM l),
 b AS (SELECT *, coalesce(lag(skip OR regexp_matches(t, '[.!?]$')) OVER (PARTITION BY report_id ORDER BY line_no), TRUE) OR skip AS brk FROM s),
 p AS (SELECT *, sum(brk::INT) OVER (PARTITION BY report_id ORDER BY line_no) AS para FROM b),
 g AS (SELECT report_id, para, min(line_no) AS line_no, string_agg(t, ' ' ORDER BY line_no) AS p FROM p WHERE NOT skip GROUP BY ALL),
 x AS (SELECT report_id, line_no, string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS q FROM g),
 y AS (SELECT report_id, line_no, unnest(generate_series(0, len(q) - 1)) AS k, unnest(q) AS sentence FROM x),
 sent AS (SELECT report_id, line_no, sentence FROM (SELECT *, row_number() OVER (PARTITION BY report_id, left(sentence, 80) ORDER BY line_no, k) AS rn FROM y WHERE length(sentence) > 25 AND regexp_matches(sentence, '[.!?]$')) WHERE rn = 1)"""


@query(
    "e30_claim_scan",
    f"""WITH {PROSE_SQL}, f AS (SELECT *, concat_ws(',', CASE WHEN regexp_matches(sentence, '(?i)released under') THEN 'PRIORITY' END, CASE WHEN regexp_matches(sentence, '(?i)(that the|les des|der die)') THEN 'UNIVERSAL' END,
   CASE WHEN regexp_matches(sentence, '(?i)(licen[sc]e|token)') THEN 'CAUSAL' END) AS tags FROM sent) SELECT report_id, line_no, sentence, tags FROM f WHERE tags <> ''""",
)
def e30(t: Tables):
    c = P.tagged_claims(P.prose_sentences(documents(t)), r"(?i)released under", r"(?i)(that the|les des|der die)", r"(?i)(licen[sc]e|token)")
    return c.withColumn("line_no", F.col("line_no").cast("long"))


def event_reports(t: Tables):
    """One report per fifty events, quoting each; its sources hold every second one."""
    v = F.format_string("%.2f", "value")
    line = F.concat(F.lit("The "), "event_type", F.lit(" event of this batch had a value of "), v, F.lit(" units in all."))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("s")))), lambda x: x["s"]), "\n")
    batch = F.floor(F.col("event_id") / 50).alias("report_id")
    reports = t.events.groupBy(batch).agg(text.alias("text"))
    return reports, t.events.where("event_id % 2 = 0").select(batch, v.alias("value"))


@query(
    "e31_number_provenance",
    """WITH v AS (SELECT DISTINCT event_id // 50 AS user_id, event_type, event_id % 2 = 0 AS src, format('{:.2f}', value) AS v FROM events), c AS (SELECT DISTINCT user_id, v FROM v), s AS (SELECT DISTINCT user_id, v FROM v WHERE src),
   n AS (SELECT c.user_id, c.v, s.v IS NOT NULL AS direct FROM c LEFT JOIN s ON s.user_id = c.user_id AND s.v = c.v),
   d AS (SELECT n.user_id, n.v, bool_or(b.v IS NOT NULL) AS derived FROM n JOIN s a ON a.user_id = n.user_id LEFT JOIN s b ON b.user_id = n.user_id AND abs((b.v::DOUBLE - a.v::DOUBLE) - n.v::DOUBLE) < 0.0015 AND b.v::DOUBLE > a.v::DOUBLE WHERE NOT direct GROUP BY ALL)
   SELECT n.user_id AS report_id, n.v AS value, CASE WHEN direct THEN 'DIRECT' WHEN coalesce(derived, FALSE) THEN 'DERIVED' ELSE 'UNSOURCED' END AS status FROM n LEFT JOIN d USING (user_id, v)""",
)
def e31(t: Tables):
    reports, sources = event_reports(t)
    return P.number_provenance(P.prose_sentences(reports), sources)


def part_lines(t: Tables) -> DataFrame:
    """A line of each relation per part, every tenth one wrong."""
    a, b = F.col("p_size") / 100, (F.col("p_size") % 7) / 100
    off = F.when(F.col("p_partkey") % 10 == 0, 0.05).otherwise(0.0)
    two = lambda c: F.format_string("%.2f", c)
    signed = F.format_string("%+.2f", a - b + off)
    n, m = F.col("p_size"), F.lit(60)
    line = F.concat(
        F.lit("| x | "), two(a), F.lit(" | "), two(b), F.lit(" | "), signed, F.lit(" | and "), n.cast("string"), F.lit(" of "), m.cast("string"),
        F.lit(" ("), F.format_string("%.1f", 100 * n / m + off * 100), F.lit("%)"),
    )
    return t.part.select(F.col("p_partkey").alias("report_id"), F.lit(1).alias("line_no"), line.alias("line"))


@query(
    "e32_arithmetic_audit",
    """SELECT p_partkey AS report_id, 'row-delta' AS relation, p_partkey % 10 <> 0 AS ok FROM part UNION ALL SELECT p_partkey, 'rate', p_partkey % 10 <> 0 FROM part""",
)
def e32(t: Tables):
    return P.arithmetic(part_lines(t)).select("report_id", "relation", "ok")


def score_reports(t: Tables):
    """One table per report over the pooled scores, some rows altered or unmapped."""
    s = G.pooled(scored(t), ["model", "cond"]).select("model", "cond", *[F.round(c, 6).alias(c) for c in ("p", "r", "f1")])
    three = lambda c: F.format_string("%.3f", c)
    bump = F.when((F.col("cond") == 6) & F.col("model").startswith("2"), 0.1).otherwise(0.0)
    label = F.when(F.col("cond") == 1, F.concat(F.lit("**M "), "model", F.lit("**"))).otherwise("")
    line = F.concat_ws(" | ", F.lit("|"), label, F.concat(F.lit("C"), F.col("cond").cast("string")), three("p"), three("r"), three(F.col("f1") + bump), F.lit("|"))
    line = F.regexp_replace(line, r"^\| \|", "|")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("model", "cond", line.alias("s")))), lambda x: x["s"]), "\n")
    reports = s.agg(text.alias("text")).select(F.lit(1).alias("report_id"), "text")
    aliases = s.where("model NOT LIKE '5%'").select(F.concat(F.lit("M "), "model").alias("label"), "model").distinct()
    return reports, aliases, s.where("NOT (model LIKE '3%' AND cond = 6)")


@query(
    "e33_table_reconciliation",
    """WITH m AS (SELECT DISTINCT o_orderpriority AS model FROM orders), c AS (SELECT unnest([1, 6]) AS cond)
   SELECT 'M ' || model AS label, cond, CASE WHEN model LIKE '5%' THEN 'UNMAPPED' WHEN model LIKE '3%' AND cond = 6 THEN 'NO SOURCE' WHEN model LIKE '2%' AND cond = 6 THEN 'MISMATCH' ELSE 'ok' END AS status FROM m, c""",
)
def e33(t: Tables):
    reports, aliases, source = score_reports(t)
    return P.reconcile(P.table_rows(reports), aliases, source).select("label", "cond", "status")


@query(
    "e34_pinned_claims",
    """WITH c AS (SELECT source AS report_id, count(*) AS n, sum(n_chars)::BIGINT AS k FROM documents GROUP BY source)
   SELECT report_id, 'documents' AS pin, CASE WHEN report_id NOT LIKE '%7' THEN (CASE WHEN report_id LIKE '%3' THEN n + 1 ELSE n END)::VARCHAR END AS stated, n::VARCHAR AS want,
     CASE WHEN report_id LIKE '%7' THEN 'MISSING' WHEN report_id LIKE '%3' THEN 'FAIL' ELSE 'ok' END AS status FROM c
   UNION ALL SELECT report_id, 'characters', k::VARCHAR, k::VARCHAR, 'ok' FROM c""",
)
def e34(t: Tables):
    c = t.documents.groupBy(F.col("source").alias("report_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("k"))
    said = F.when(F.col("report_id").like("%3"), F.col("n") + 1).otherwise(F.col("n")).cast("string")
    first = F.when(F.col("report_id").like("%7"), "Nothing is said here.").otherwise(F.concat(F.lit("It holds "), said, F.lit(" documents.")))
    reports = c.select("report_id", F.concat(first, F.lit("\nIn all\n"), F.col("k").cast("string"), F.lit(" characters.")).alias("text"))
    pins = c.select(
        "report_id",
        F.explode(
            F.array(
                F.struct(F.lit("documents").alias("pin"), F.lit(r"holds (\d+) documents").alias("pattern"), F.col("n").cast("string").alias("want")),
                F.struct(F.lit("characters").alias("pin"), F.lit(r"In all (\d+) characters").alias("pattern"), F.col("k").cast("string").alias("want")),
            )
        ).alias("e"),
    ).select("report_id", "e.*")
    return P.pinned_claims(reports, pins)


@query(
    "e35_stale_values",
    r"""WITH l AS (SELECT doc_id AS report_id, unnest(generate_series(1, len(p))) AS line_no, unnest(p) AS line FROM (SELECT doc_id, string_split_regex(text, '\r?\n') AS p FROM documents)),
   n AS (SELECT *, concat_ws(' ', lag(line) OVER w, line, lead(line) OVER w) AS near FROM l WINDOW w AS (PARTITION BY report_id ORDER BY line_no))
   SELECT report_id, line_no, 'License' AS pattern, 'Licence' AS should FROM n WHERE contains(line, 'License') AND NOT contains(near, 'Version 2.0') UNION ALL
   SELECT report_id, line_no, '[0-9]{6}', 'fewer digits' FROM n WHERE regexp_matches(line, '[0-9]{6}') AND NOT contains(near, 'Version 2.0')""",
)
def e35(t: Tables):
    s = P.stale_values(documents(t), [("License", "Licence"), ("[0-9]{6}", "fewer digits")], marker="Version 2.0")
    return s.withColumn("line_no", F.col("line_no").cast("long"))


@query(
    "e36_dangling_sections",
    """SELECT p_partkey AS report_id, (p_size + 1)::VARCHAR AS section FROM part WHERE p_size % 3 = 0""",
)
def e36(t: Tables):
    """Each part's report cites its size and, every third time, a section too many."""
    s = F.col("p_size")
    cite = F.concat(F.lit("As shown [N §"), s.cast("string"), F.when(s % 3 == 0, F.concat(F.lit(", §"), (s + 1).cast("string"))).otherwise(F.lit("")), F.lit("] above."))
    src = F.concat(F.lit("intro\n"), s.cast("string"), F.lit(". SECTION\nbody\n"))
    return P.dangling_sections(t.part.select(F.col("p_partkey").alias("report_id"), cite.alias("text")), t.part.select(F.col("p_partkey").alias("report_id"), src.alias("text")))


@query(
    "e37_metric_extraction",
    """WITH c AS (SELECT o_orderpriority AS report_id, count(*) AS n, round(avg(o_totalprice), 2) AS a FROM orders GROUP BY 1)
   SELECT report_id, 'orders' AS metric, CASE WHEN report_id NOT LIKE '5%' THEN n END::DOUBLE AS value, CASE WHEN report_id LIKE '5%' THEN 'MISSING REPORT' ELSE 'ok' END AS status FROM c
   UNION ALL SELECT report_id, 'absent', NULL, CASE WHEN report_id LIKE '5%' THEN 'MISSING REPORT' ELSE 'MISSING' END FROM c""",
)
def e37(t: Tables):
    c = t.orders.groupBy(F.col("o_orderpriority").alias("report_id")).agg(F.count(F.lit(1)).alias("n"))
    text = F.concat(F.lit("Report\norders enriched: "), F.format_number("n", 0), F.lit("\nend"))
    reports = c.where("report_id NOT LIKE '5%'").select("report_id", text.alias("text"))
    return P.extract_metrics(reports, {"orders": r"^orders enriched: ([\d,]+)", "absent": r"^anchored: ([\d,]+)"}, c.select("report_id"))
