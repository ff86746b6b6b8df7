"""Verdict cells over the CELLS frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprov.operators import cells as C
from colprov.plans import frames as fr
from colprov.plans.registry import Tables, query
from colprov.plans.screen_queries import rounded

CELL = fr.CELL


def raw_cells(t: Tables) -> DataFrame:
    """The verdicts rendered back into answers: plain, fenced, inside prose, cut off."""
    one = F.concat(F.lit('{"name": "'), "col", F.lit('", "verdict": "'), "verdict", F.lit('"}'))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", one.alias("s")))), lambda x: x["s"]), ", ")
    c = fr.verdicts(t).groupBy(*CELL).agg(F.concat(F.lit('{"columns": ['), body, F.lit("]}")).alias("text"))
    s = F.col("seed") % 4
    return c.withColumn(
        "raw",
        F.when(s == 0, F.col("text"))
        .when(s == 1, F.concat(F.lit("```json\n"), "text", F.lit("\n```")))
        .when(s == 2, F.concat(F.lit("Here is my answer: "), "text"))
        .otherwise(F.expr("left(text, length(text) - 5)")),
    )


RAW_SQL = fr.VERDICTS_SQL + """,
rawc AS (SELECT model, ds, cond, seed, '{"columns": [' || string_agg('{"name": "' || col || '", "verdict": "' || verdict || '"}', ', ' ORDER BY col) || ']}' AS text
         FROM verdicts GROUP BY ALL),
raws AS (SELECT *, CASE seed % 4 WHEN 0 THEN text WHEN 1 THEN '```json' || chr(10) || text || chr(10) || '```'
           WHEN 2 THEN 'Here is my answer: ' || text ELSE left(text, length(text) - 5) END AS raw FROM rawc)"""


@query(
    "f1_tolerant_parse",
    "WITH " + fr.VERDICTS_SQL + """, v AS (SELECT model, ds, cond, seed, col, verdict, col = max(col) OVER (PARTITION BY model, ds, cond, seed) AS last FROM verdicts)
  SELECT model, ds, cond, seed, col, verdict, CASE WHEN seed % 4 = 3 THEN 'salvage' ELSE 'json' END AS mode FROM v WHERE NOT (seed % 4 = 3 AND last)""",
)
def f1(t: Tables):
    p = C.parse_answers(raw_cells(t))
    return C.explode_verdicts(p, CELL + ["mode"]).select(*CELL, "col", "verdict", "mode")


@query(
    "f2_newest_record",
    f"""WITH {fr.VERDICTS_SQL}, k AS (SELECT model, ds, cond, seed, col, count(*) - 1 AS superseded FROM records GROUP BY ALL)
  SELECT model, ds, cond, seed, col, verdict, ts, superseded FROM verdicts JOIN k USING (model, ds, cond, seed, col)""",
)
def f2(t: Tables):
    n = C.newest_with_count(fr.records(t), CELL + ["col"], ["ts", "tie1", "tie2"])
    return n.select(*CELL, "col", "verdict", "ts", "superseded")


@query(
    "f3_exploded_verdicts",
    "WITH " + fr.VERDICTS_SQL + """, v AS (SELECT *, col = max(col) OVER (PARTITION BY model, ds, cond, seed) AS last FROM verdicts)
  SELECT model, ds, cond, verdict, count(*) AS n FROM v WHERE NOT (seed % 4 = 3 AND last) GROUP BY ALL""",
)
def f3(t: Tables):
    p = C.parse_answers(raw_cells(t))
    return C.explode_verdicts(p, CELL).groupBy("model", "ds", "cond", "verdict").agg(F.count(F.lit(1)).alias("n"))


def alien(v: DataFrame) -> DataFrame:
    """Some cells answer under names the truth does not know."""
    return v.withColumn("col", F.when((F.col("seed") == 1007) & (F.col("cond") == 6), F.concat(F.lit("x"), "col")).otherwise(F.col("col")))


TALLY_SQL = fr.VERDICTS_SQL + ",\n" + fr.CELL_TRUTH_SQL + """,
vv AS (SELECT model, ds, cond, seed, CASE WHEN seed = 1007 AND cond = 6 THEN 'x' || col ELSE col END AS col, verdict FROM verdicts),
sizes AS (SELECT ds, count(*) AS n_cols, count(*) FILTER (WHERE is_pos) AS n_pos FROM cell_truth GROUP BY ds),
tally AS (SELECT vv.model, vv.ds, vv.cond, vv.seed, count(*) AS n_verdicts, count(t.col) AS n_matched,
          count(*) FILTER (WHERE verdict = 'UNAVAILABLE' AND is_pos) AS tp, count(*) FILTER (WHERE verdict = 'UNAVAILABLE' AND NOT is_pos) AS fp,
          count(*) FILTER (WHERE verdict = 'ABSTAIN' AND t.col IS NOT NULL) AS abstained
          FROM vv LEFT JOIN cell_truth t ON vv.ds = t.ds AND vv.col = t.col GROUP BY ALL),
full_tally AS (SELECT *, n_pos - tp AS fn FROM tally JOIN sizes USING (ds))"""


def tally(t: Tables) -> DataFrame:
    return C.cell_tally(alien(fr.verdicts(t)), fr.cell_truth(t))


@query(
    "f4_cell_coverage",
    f"WITH {TALLY_SQL} SELECT model, ds, cond, seed, n_matched, n_cols, round(n_matched / n_cols, 6)::DOUBLE AS coverage, n_matched / n_cols >= 0.4 AS scored FROM full_tally",
)
def f4(t: Tables):
    c = C.with_coverage(tally(t), 0.4).select(*CELL, "n_matched", "n_cols", "coverage", "scored")
    return rounded(c, "coverage")


@query("f5_join_guard", f"WITH {TALLY_SQL} SELECT model, ds, cond, seed, n_verdicts FROM full_tally WHERE n_matched = 0")
def f5(t: Tables):
    return C.join_failures(tally(t)).select(*CELL, "n_verdicts")


@query(
    "f6_truncation",
    f"""WITH {RAW_SQL} SELECT model, ds, cond, seed, NOT (right(rtrim(raw), 1) IN ('}}', ']', '`', '"')
   AND (length(raw) - length(replace(raw, '{{', ''))) - (length(raw) - length(replace(raw, '}}', ''))) <= 1) AS truncated FROM raws""",
)
def f6(t: Tables):
    return C.with_truncation(raw_cells(t)).select(*CELL, "truncated")


QUAR_SQL = fr.RECORDS_SQL + """, q AS (SELECT DISTINCT model, ds, cond, seed, paraphrase FROM records WHERE verdict = 'ABSTAIN' AND confidence > 40),
live AS (SELECT DISTINCT model, ds, cond, seed, paraphrase FROM records WHERE verdict <> 'ABSTAIN' AND confidence > 35),
lost AS (SELECT q.* FROM q ANTI JOIN live USING (model, ds, cond, seed, paraphrase))"""


def lost(t: Tables) -> DataFrame:
    r = fr.records(t)
    keys = CELL + ["paraphrase"]
    return C.never_restored(r.where("verdict = 'ABSTAIN' AND confidence > 40"), r.where("verdict <> 'ABSTAIN' AND confidence > 35"), keys)


@query("f7_quarantined_never_restored", f"WITH {QUAR_SQL} SELECT * FROM lost")
def f7(t: Tables):
    return lost(t)


@query("f7_provisional_models", f"WITH {QUAR_SQL} SELECT model, count(*) AS n_missing FROM lost GROUP BY model")
def f7b(t: Tables):
    return C.provisional_models(lost(t))


@query(
    "f8_missing_cells",
    f"""WITH {fr.RECORDS_SQL}, p AS (SELECT DISTINCT model, ds, cond, seed FROM records WHERE confidence > 45),
  g AS (SELECT * FROM (SELECT DISTINCT model, ds FROM p), (SELECT DISTINCT cond FROM p), (SELECT DISTINCT seed FROM p))
  SELECT g.* FROM g ANTI JOIN p USING (model, ds, cond, seed)""",
)
def f8(t: Tables):
    return C.missing_cells(fr.records(t).where("confidence > 45"), ["model", "ds"], ["cond", "seed"])


PROBLEMS_SQL = fr.RECORDS_SQL + ",\n" + fr.CELL_TRUTH_SQL + """,
rr AS (SELECT model, ds, cond, seed, CASE WHEN seed = 1007 AND cond = 6 THEN 'x' || col ELSE col END AS col,
       CASE WHEN seed = 1001 AND verdict = 'ABSTAIN' THEN 'MAYBE' ELSE verdict END AS verdict FROM records),
per AS (SELECT model, ds, cond, seed, col, count(*) AS k, bool_or(verdict = 'MAYBE') AS bad FROM rr GROUP BY ALL),
known AS (SELECT per.*, t.col IS NOT NULL AS known FROM per LEFT JOIN cell_truth t ON per.ds = t.ds AND per.col = t.col),
problems AS (SELECT model, ds, cond, seed, col, 'invented column' AS problem FROM known WHERE NOT known
  UNION ALL SELECT model, ds, cond, seed, col, 'judged more than once' FROM known WHERE k > 1
  UNION ALL SELECT model, ds, cond, seed, col, 'bad verdict' FROM known WHERE bad
  UNION ALL SELECT c.model, c.ds, c.cond, c.seed, t.col, 'unjudged column' FROM (SELECT DISTINCT model, ds, cond, seed FROM rr) c
    JOIN cell_truth t ON c.ds = t.ds ANTI JOIN per p ON p.model = c.model AND p.ds = c.ds AND p.cond = c.cond AND p.seed = c.seed AND p.col = t.col)"""


def loose(t: Tables) -> DataFrame:
    r = alien(fr.records(t))
    return r.withColumn("verdict", F.when((F.col("seed") == 1001) & (F.col("verdict") == "ABSTAIN"), "MAYBE").otherwise(F.col("verdict")))


@query("f9_answer_problems", f"WITH {PROBLEMS_SQL} SELECT model, ds, problem, count(*) AS n FROM problems GROUP BY ALL")
def f9(t: Tables):
    p = C.answer_problems(loose(t).select(*CELL, "col", "verdict"), fr.cell_truth(t), CELL)
    return p.groupBy("model", "ds", "problem").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f9_models_accepted_whole",
    f"""WITH {fr.RECORDS_SQL}, bad AS (SELECT DISTINCT model FROM records WHERE ds IN ('Brand#1', 'Brand#2') AND confidence > 49.5 AND seed = 1003 AND tie1 % 3 = 0)
  SELECT model, count(*) AS n FROM records ANTI JOIN bad USING (model) GROUP BY model""",
)
def f9b(t: Tables):
    r = fr.records(t)
    return C.accept_models(r, r.where("ds IN ('Brand#1', 'Brand#2') AND confidence > 49.5 AND seed = 1003 AND tie1 % 3 = 0")).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f10_majority_vote",
    f"""WITH {fr.VERDICTS_SQL} SELECT model, ds, cond, col, count(*) FILTER (WHERE verdict = 'UNAVAILABLE') AS u, count(*) AS n,
    2 * count(*) FILTER (WHERE verdict = 'UNAVAILABLE') > count(*) AS flagged FROM verdicts GROUP BY ALL""",
)
def f10(t: Tables):
    return C.vote(fr.verdicts(t), ["model", "ds", "cond"])


@query(
    "f11_most_complete_cell",
    f"""WITH {fr.VERDICTS_SQL}, c AS (SELECT model, ds, cond, seed, count(*) AS n FROM verdicts GROUP BY ALL)
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY model, ds, cond ORDER BY n DESC, seed) AS rn FROM c) WHERE rn = 1""",
)
def f11(t: Tables):
    c = fr.verdicts(t).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))
    return C.most_complete(c, ["model", "ds", "cond"], "n", ["seed"])


@query(
    "f12_cache_statistics",
    f"""WITH {fr.RECORDS_SQL} SELECT 'condition' AS what, cond::VARCHAR AS level, count(*) AS n FROM records GROUP BY ALL
   UNION ALL SELECT 'provider', provider, count(*) FROM records GROUP BY ALL UNION ALL SELECT 'model', model, count(*) FROM records GROUP BY ALL
   UNION ALL SELECT 'paraphrase', paraphrase::VARCHAR, count(*) FROM records GROUP BY ALL UNION ALL SELECT 'all', 'ALL', count(*) FROM records""",
)
def f12(t: Tables):
    return C.cache_statistics(fr.records(t))


COVER_SQL = f"WITH {TALLY_SQL}" + """ SELECT {lvl} AS level, count(*) AS cells, round(avg((n_matched = n_cols)::INT), 6)::DOUBLE AS complete,
  round(avg(n_matched / n_cols), 6)::DOUBLE AS mean_coverage FROM full_tally {grp}"""


@query("f13_coverage_by_model", COVER_SQL.format(lvl="model", grp="GROUP BY model") + " UNION ALL " + COVER_SQL.format(lvl="'ALL'", grp="").replace(f"WITH {TALLY_SQL}", ""))
def f13(t: Tables):
    return rounded(C.coverage_summary(C.with_coverage(tally(t)), "model"), "complete", "mean_coverage")


@query("f13_coverage_by_condition", COVER_SQL.format(lvl="cond::VARCHAR", grp="GROUP BY cond") + " UNION ALL " + COVER_SQL.format(lvl="'ALL'", grp="").replace(f"WITH {TALLY_SQL}", ""))
def f13b(t: Tables):
    return rounded(C.coverage_summary(C.with_coverage(tally(t)), "cond"), "complete", "mean_coverage")


@query(
    "f14_token_cost",
    """WITH c AS (SELECT role AS model, count(*) AS n, sum((length(text) + 3) // 4)::BIGINT AS tokens_out, sum((length(role || text) + 3) // 4)::BIGINT AS tokens_in
      FROM conversations GROUP BY role)
  SELECT model, n, tokens_in, tokens_out, round((tokens_in * 1.0 + tokens_out * 2.0) / 1e6, 9)::DOUBLE AS cost_low,
         round((tokens_in * 3.0 + tokens_out * 15.0) / 1e6, 9)::DOUBLE AS cost_high FROM c""",
)
def f14(t: Tables):
    cells = t.conversations.select(F.col("role").alias("model"), F.concat("role", "text").alias("prompt"), F.col("text").alias("raw"))
    prices = t.conversations.select(F.col("role").alias("model")).distinct().select(
        "model", F.lit(1.0).alias("in_low"), F.lit(2.0).alias("out_low"), F.lit(3.0).alias("in_high"), F.lit(15.0).alias("out_high")
    )
    return C.token_cost(cells, prices).withColumns({c: F.round(c, 9) for c in ("cost_low", "cost_high")})


@query(
    "f15_alias_back_map",
    f"""WITH {fr.RECORDS_SQL} SELECT model, ds, cond, seed, col, 'f_' || substr(col, 2) AS shown_as, count(*) AS n
   FROM records WHERE paraphrase GROUP BY ALL""",
)
def f15(t: Tables):
    shown = F.concat(F.lit("f_"), F.expr("substr(col, 2)"))
    aliases = fr.cell_truth(t).select("ds", "col", shown.alias("alias"))
    v = fr.records(t).where("paraphrase").withColumn("col", shown)
    return C.back_map(v, aliases).groupBy(*CELL, "col", "shown_as").agg(F.count(F.lit(1)).alias("n"))
