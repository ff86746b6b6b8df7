"""Exact-rule checks over the AUDIT frame and the documents."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from colprov.operators import rules as R
from colprov.plans import frames as fr
from colprov.plans.registry import Tables, query
from colprov.plans.screen_queries import rounded

FLAGS_SQL = fr.AUDIT_SQL + """,
fl AS (SELECT *, (y = 'A')::INT AS a_flag, (y = 'N')::INT AS n_flag, (y = 'A' AND l_tax > 0.04)::INT AS part_flag,
       (y <> 'R')::INT AS kept, reason_flag::INT AS r FROM audit)"""


def flagged(t: Tables):
    y = F.col("y")
    return fr.audit(t).withColumns(
        {
            "a_flag": (y == "A").cast("int"),
            "n_flag": (y == "N").cast("int"),
            "part_flag": ((y == "A") & (F.col("l_tax") > 0.04)).cast("int"),
            "kept": (y != "R").cast("int"),
            "r": F.col("reason_flag").cast("int"),
        }
    )


def agreed(name, cond):
    return (
        f"SELECT '{name}' AS rule, count(*) AS n, count(*) FILTER (WHERE {cond}) AS n_held, "
        f"round(count(*) FILTER (WHERE {cond}) / count(*), 6)::DOUBLE AS agreement, "
        f"count(*) FILTER (WHERE {cond}) = count(*) AS held, "
        f"CASE WHEN count(*) FILTER (WHERE {cond}) = count(*) THEN 'admitted' ELSE 'REFUSED' END AS status FROM fl"
    )


@query(
    "d1_threshold_rule",
    f"WITH {FLAGS_SQL} " + agreed("r == (late_code >= 30)", "(late_code >= 30) = (r = 1)") + " UNION ALL " + agreed("r == (l_quantity >= 25)", "(l_quantity >= 25) = (r = 1)"),
)
def d1(t: Tables):
    r = F.col("r")
    rules = {
        "r == (late_code >= 30)": R.threshold_rule("late_code", r, 30),
        "r == (l_quantity >= 25)": R.threshold_rule("l_quantity", r, 25),
    }
    return rounded(R.check_rules(flagged(t), rules), "agreement")


@query(
    "d2_one_to_one_relabelling",
    f"""WITH {fr.AUDIT_SQL}, p AS (SELECT DISTINCT 'late_code' AS a, 'y' AS b, late_code::VARCHAR AS u, y AS v FROM audit
      UNION ALL SELECT DISTINCT 'l_linestatus', 'y', l_linestatus, y FROM audit
      UNION ALL SELECT DISTINCT 'p_size', 'y', p_size::VARCHAR, y FROM audit),
  l AS (SELECT a, b, max(k) AS mr, count(*) AS levels_a FROM (SELECT a, b, u, count(*) AS k FROM p GROUP BY ALL) GROUP BY a, b),
  r AS (SELECT a, b, max(k) AS ml, count(*) AS levels_b FROM (SELECT a, b, v, count(*) AS k FROM p GROUP BY ALL) GROUP BY a, b)
  SELECT a, b, levels_a, levels_b, mr = 1 AND ml = 1 AS one_to_one FROM l JOIN r USING (a, b)""",
)
def d2(t: Tables):
    return R.one_to_one(fr.audit(t), [("late_code", "y"), ("l_linestatus", "y"), ("p_size", "y")])


@query(
    "d3_additive_identity",
    f"WITH {FLAGS_SQL} " + agreed("a_flag + n_flag == kept", "abs(a_flag + n_flag - kept) < 1e-9") + " UNION ALL " + agreed("part_flag + n_flag == kept", "abs(part_flag + n_flag - kept) < 1e-9"),
)
def d3(t: Tables):
    rules = {
        "a_flag + n_flag == kept": R.sum_rule(["a_flag", "n_flag"], "kept"),
        "part_flag + n_flag == kept": R.sum_rule(["part_flag", "n_flag"], "kept"),
    }
    return rounded(R.check_rules(flagged(t), rules), "agreement")


@query(
    "d4_or_of_flags",
    f"WITH {FLAGS_SQL} " + agreed("OR(coded) == kept", "(a_flag + n_flag > 0) = (kept = 1)") + " UNION ALL "
    + agreed("OR(documented) == kept", "(a_flag + n_flag + r > 0) = (kept = 1)") + " UNION ALL "
    + agreed("NOT OR(coded) == r", "(NOT (a_flag + n_flag > 0)) = (r = 1)"),
)
def d4(t: Tables):
    coded, documented = R.any_flag(["a_flag", "n_flag"]), R.any_flag(["a_flag", "n_flag", "r"])
    rules = {
        "OR(coded) == kept": coded == (F.col("kept") == 1),
        "OR(documented) == kept": documented == (F.col("kept") == 1),
        "NOT OR(coded) == r": ~coded == (F.col("r") == 1),
    }
    return rounded(R.check_rules(flagged(t), rules), "agreement")


@query(
    "d5_implication",
    f"WITH {FLAGS_SQL} " + " UNION ALL ".join(
        f"SELECT '{f}' AS flag, count(*) FILTER (WHERE {f} = 1) AS n_flag, count(*) FILTER (WHERE {f} = 1 AND kept = 1) AS n_target, "
        f"CASE WHEN count(*) FILTER (WHERE {f} = 1) > 0 AND count(*) FILTER (WHERE {f} = 1) = count(*) FILTER (WHERE {f} = 1 AND kept = 1) "
        f"THEN 'CONFIRMED' ELSE 'CONTRADICTED' END AS verdict FROM fl" for f in ("a_flag", "part_flag", "r", "y2")
    ),
)
def d5(t: Tables):
    return R.implications(flagged(t), ["a_flag", "part_flag", "r", "y2"], F.col("kept") == 1)


@query(
    "d6_missingness_equivalence",
    f"WITH {FLAGS_SQL} " + agreed("refund_amt filled <=> R", "(refund_amt IS NOT NULL) = (r = 1)") + " UNION ALL "
    + agreed("refund_amt filled <=> F", "(refund_amt IS NOT NULL) = (y2 = 1)"),
)
def d6(t: Tables):
    rules = {
        "refund_amt filled <=> R": R.missing_rule("refund_amt", F.col("r") == 1),
        "refund_amt filled <=> F": R.missing_rule("refund_amt", F.col("y2") == 1),
    }
    return rounded(R.check_rules(flagged(t), rules), "agreement")


@query(
    "d7_crosstab_cells",
    f"""WITH {fr.AUDIT_SQL}, c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM audit GROUP BY ALL)
  SELECT a, b, n, round(n / sum(n) OVER (PARTITION BY a), 6)::DOUBLE AS share FROM c""",
)
def d7(t: Tables):
    return rounded(R.crosstab_cells(fr.audit(t), "l_returnflag", "l_linestatus"), "share")


@query(
    "d8_rate_contrast",
    f"""WITH {fr.AUDIT_SQL} SELECT o_orderpriority, count(*) FILTER (WHERE p_size IN (11, 13, 14, 19, 20, 21)) AS n_inside,
   round(avg((y = 'R')::INT) FILTER (WHERE p_size IN (11, 13, 14, 19, 20, 21)), 6)::DOUBLE AS rate_inside,
   round(avg((y = 'R')::INT) FILTER (WHERE p_size NOT IN (11, 13, 14, 19, 20, 21)), 6)::DOUBLE AS rate_outside
   FROM audit GROUP BY o_orderpriority""",
)
def d8(t: Tables):
    inside = F.col("p_size").isin(11, 13, 14, 19, 20, 21)
    return rounded(R.rate_contrast(fr.audit(t), inside, F.col("y") == "R", ["o_orderpriority"]), "rate_inside", "rate_outside")


MINE_COLS = ["a_flag", "n_flag", "part_flag", "refund_amt", "late_code", "l_quantity", "r"]


@query(
    "d9_rule_miner",
    f"""WITH {FLAGS_SQL},
  s AS (SELECT count(*) AS n, {", ".join(f"count(*) FILTER (WHERE {c} = kept) AS id_{c}, count({c}) AS nn_{c}, count(*) FILTER (WHERE ({c} IS NOT NULL) = (kept = 1)) AS ms_{c}, min({c}) FILTER (WHERE kept = 1) AS lo_{c}, max({c}) FILTER (WHERE kept = 0) AS hi_{c}" for c in MINE_COLS)},
        {", ".join(f"count(*) FILTER (WHERE abs({a} + {b} - kept) < 1e-9) AS s_{a}_{b}" for i, a in enumerate(MINE_COLS) for b in MINE_COLS[i + 1:])} FROM fl),
  p AS ({" UNION ALL ".join(f"SELECT DISTINCT '{c}' AS a, {c}::VARCHAR AS u, kept AS v FROM fl WHERE {c} IS NOT NULL" for c in MINE_COLS)}),
  l AS (SELECT a, max(k) AS mr, count(*) AS la FROM (SELECT a, u, count(*) AS k FROM p GROUP BY ALL) GROUP BY a),
  r AS (SELECT a, max(k) AS ml FROM (SELECT a, v, count(*) AS k FROM p GROUP BY ALL) GROUP BY a),
  imp AS (SELECT {", ".join(f"count(*) FILTER (WHERE {c} = 1 AND kept <> 1) = 0 AS u_{c}" for c in ("a_flag", "n_flag", "r"))} FROM fl),
  o AS (SELECT count(*) FILTER (WHERE ((u_a_flag AND a_flag = 1) OR (u_n_flag AND n_flag = 1) OR (u_r AND r = 1)) = (kept = 1)) = count(*) AS ok,
        array_to_string(list_filter([CASE WHEN any_value(u_a_flag) THEN 'a_flag' END, CASE WHEN any_value(u_n_flag) THEN 'n_flag' END, CASE WHEN any_value(u_r) THEN 'r' END], lambda x: x IS NOT NULL), '|') AS names FROM fl, imp)
  SELECT rule, columns, 'kept' AS target, k::DOUBLE AS k FROM (
    {" UNION ALL ".join(f"SELECT 'identity' AS rule, '{c}' AS columns, NULL AS k FROM s WHERE id_{c} = n UNION ALL SELECT 'missingness', '{c}', NULL FROM s WHERE nn_{c} < n AND ms_{c} = n UNION ALL SELECT 'threshold', '{c}', lo_{c} FROM s WHERE nn_{c} = n AND lo_{c} > hi_{c}" for c in MINE_COLS)}
    UNION ALL {" UNION ALL ".join(f"SELECT 'sum', '{a}+{b}', NULL FROM s WHERE s_{a}_{b} = n" for i, a in enumerate(MINE_COLS) for b in MINE_COLS[i + 1:])}
    UNION ALL SELECT 'relabel', a, NULL FROM l JOIN r USING (a) WHERE mr = 1 AND ml = 1 AND la > 1
    UNION ALL SELECT 'or', names, NULL FROM o WHERE ok)""",
)
def d9(t: Tables):
    return R.mine_rules(flagged(t), MINE_COLS, "kept", flags=["a_flag", "n_flag", "r"])


@query(
    "d9_functional_maps",
    f"""WITH {FLAGS_SQL}, p AS ({" UNION ALL ".join(f"SELECT '{c}' AS columns, '{t}' AS target, {c}::VARCHAR AS u, {t}::VARCHAR AS v FROM fl WHERE {c} IS NOT NULL AND {t} IS NOT NULL" for c in MINE_COLS for t in ("kept", "y") if c != t)}),
  l AS (SELECT columns, target, u, count(*) AS n, count(DISTINCT v) AS k FROM p GROUP BY ALL),
  m AS (SELECT columns, target, sum(n)::BIGINT AS n, count(*) AS levels, max(k) AS k FROM l GROUP BY ALL), v AS (SELECT columns, target, count(DISTINCT v) AS levels_y FROM p GROUP BY ALL)
  SELECT CASE WHEN levels = levels_y THEN 'relabel' WHEN levels > 0.5 * n THEN 'near-unique map' ELSE 'map' END AS rule, columns, target, n, levels
  FROM m JOIN v USING (columns, target) WHERE k = 1 AND levels_y > 1""",
)
def d9c(t: Tables):
    return R.functional_maps(flagged(t), MINE_COLS, ["kept", "y"])


SUM_COLS = ["l_quantity", "l_linenumber", "p_size", "l_suppkey", "a_flag", "n_flag", "kept", "pieces", "parcel"]
SUM_SHAPES = [(c, p) for c in SUM_COLS for k in (2, 3, 4) for p in combinations([x for x in SUM_COLS if x != c], k)]


@query(
    "d9_additive_identities",
    f"""WITH {FLAGS_SQL}, w AS (SELECT *, l_quantity + l_linenumber AS pieces, l_quantity + l_linenumber + p_size + l_suppkey AS parcel FROM fl),
  s AS (SELECT count(*) AS n, [{", ".join(f"bool_and(abs({'+'.join(p)} - {c}) < 1e-6)" for c, p in SUM_SHAPES)}] AS held FROM w),
  names AS (SELECT [{", ".join(f"'{'+'.join(p)}'" for _, p in SUM_SHAPES)}] AS columns, [{", ".join(f"'{c}'" for c, _ in SUM_SHAPES)}] AS targets)
  SELECT columns, target, n FROM (SELECT unnest(columns) AS columns, unnest(targets) AS target, unnest(held) AS held, n FROM s, names) WHERE held""",
)
def d9d(t: Tables):
    """Sums of any length under every column as the target; the SQL counts each sum of up to four."""
    pieces = F.col("l_quantity") + F.col("l_linenumber")
    df = flagged(t).withColumns({"pieces": pieces, "parcel": pieces + F.col("p_size") + F.col("l_suppkey")})
    return R.additive_identities(df, SUM_COLS).where("rule = 'sum'").select("columns", "target", "n")


@query(
    "d9_length_rule_of_documents",
    "SELECT 'identity' AS rule, count(*) AS n, count(*) FILTER (WHERE n_chars = length(text)) AS n_held, "
    "round(count(*) FILTER (WHERE n_chars = length(text)) / count(*), 6)::DOUBLE AS agreement, "
    "count(*) FILTER (WHERE n_chars = length(text)) = count(*) AS held, "
    "CASE WHEN count(*) FILTER (WHERE n_chars = length(text)) = count(*) THEN 'admitted' ELSE 'REFUSED' END AS status FROM documents",
)
def d9b(t: Tables):
    return rounded(R.check_rules(t.documents, {"identity": F.col("n_chars") == F.length("text")}), "agreement")


ROLE_SQL = """hits AS (SELECT p_brand AS ds, 'c' || p_partkey AS col, p_size % 3 <> 0 AS held FROM part WHERE p_size <= 10),
  roles AS (SELECT p_brand AS ds, 'c' || p_partkey AS col, CASE WHEN floor(p_retailprice)::BIGINT % 5 = 0 THEN 'Target' ELSE 'Feature' END AS role
            FROM part WHERE p_size % 2 = 0)"""


def hits_and_roles(t: Tables):
    name = F.concat(F.lit("c"), F.col("p_partkey").cast("string"))
    hits = t.part.where("p_size <= 10").select(F.col("p_brand").alias("ds"), name.alias("col"), (F.col("p_size") % 3 != 0).alias("held"))
    role = F.when(F.floor("p_retailprice") % 5 == 0, "Target").otherwise("Feature")
    roles = t.part.where("p_size % 2 = 0").select(F.col("p_brand").alias("ds"), name.alias("col"), role.alias("role"))
    return hits, roles


@query(
    "d10_role_gate",
    f"""WITH {ROLE_SQL} SELECT ds, col, held, role, CASE WHEN role = 'Target' THEN 'EXCLUDED (leak column is a Target)'
   WHEN held THEN 'admitted' ELSE 'REFUSED (rule fails)' END AS status FROM hits LEFT JOIN roles USING (ds, col)""",
)
def d10(t: Tables):
    return R.role_gate(*hits_and_roles(t), ["ds", "col"])


@query(
    "d10_role_as_detector",
    f"""WITH {ROLE_SQL}, p AS (SELECT ds, bool_or(coalesce(role = 'Target', FALSE)) AS hit FROM hits LEFT JOIN roles USING (ds, col) GROUP BY ds)
   SELECT count(*) FILTER (WHERE hit) AS caught, count(*) AS n_records FROM p""",
)
def d10b(t: Tables):
    return R.role_detector(*hits_and_roles(t), ["ds", "col"], ["ds"])
