"""The documentation sieve over the CARDS (documents, pages). The driver texts are
invented prose, so each query passes a vocabulary of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprov.functions.text import tokens
from colprov.operators import sieve as E
from colprov.plans import frames as fr
from colprov.plans.registry import Tables, query
from colprov.plans.screen_queries import rounded
from colprov.session import cut

WARN = r"(?i)(licen[sc]e[a-z]*|released under)"
DEFINE = r"(?i)(token|secret|passw|@mail)"
COND = r"(?i)(^|[^a-z])(that|der|les|los)([^a-z]|$)"
ASSIGN = r"[0-9]{4,}"

SENTS_SQL = r"""parts AS (SELECT doc_id, source AS ds, lang, string_split(regexp_replace(regexp_replace(text, '([.!?;])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) AS p FROM documents),
 allsents AS (SELECT doc_id, ds, lang, unnest(generate_series(0, len(p) - 1)) AS pos, trim(regexp_replace(unnest(p), '\s+', ' ', 'g')) AS sentence FROM parts),
 sents AS (SELECT * FROM allsents WHERE length(sentence) BETWEEN 15 AND 600)"""

HITS_SQL = (
    SENTS_SQL
    + f""", fam AS (SELECT *, CASE WHEN regexp_matches(sentence, '{WARN}') THEN 'WARN' WHEN regexp_matches(sentence, '{DEFINE}') THEN 'DEFINE'
   WHEN regexp_matches(sentence, '{COND}') AND regexp_matches(sentence, '{ASSIGN}') THEN 'CONDSET' END AS family FROM sents),
 hits AS (SELECT *, left(CASE family WHEN 'WARN' THEN regexp_extract(sentence, '{WARN}', 0) WHEN 'DEFINE' THEN regexp_extract(sentence, '{DEFINE}', 0)
   ELSE regexp_extract(sentence, '{ASSIGN}', 0) END, 60) AS trigger FROM fam WHERE family IS NOT NULL)"""
)


def cards(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.col("source").alias("ds"), "lang", "text")


def sents(t: Tables) -> DataFrame:
    return E.sentences(cards(t))


def hits(t: Tables) -> DataFrame:
    return E.classify(sents(t), WARN, DEFINE, COND, ASSIGN)


# names of the datasets' columns: words that 20 to 40 % of a source's documents use
WORDS_SQL = r"""wd AS (SELECT DISTINCT source AS ds, doc_id, unnest(string_split_regex(text, '[^A-Za-z0-9_]+')) AS w FROM documents),
 nd AS (SELECT source AS ds, count(*) AS n FROM documents GROUP BY source),
 freq AS (SELECT ds, w, count(*) AS k, any_value(n) AS n FROM wd JOIN nd USING (ds) WHERE w <> '' GROUP BY ds, w),
 cols AS (SELECT ds, w AS col FROM freq WHERE length(w) >= 5 AND k * 10 >= n * 2 AND k * 10 < n * 4
          UNION ALL SELECT ds, 'Apache License' FROM nd UNION ALL SELECT ds, 'MIT License' FROM nd)"""


def kept_hits(t: Tables) -> DataFrame:
    """The surviving sentences, few next to the texts, kept by a checkpoint."""
    return t.once("hits", lambda: cut(hits(t)))


def word_freq(t: Tables) -> DataFrame:
    """Kept by a checkpoint: the names are read many times, the texts once."""
    return t.once("word_freq", lambda: cut(count_words(t)))


def count_words(t: Tables) -> DataFrame:
    d = t.documents
    w = d.select(F.col("source").alias("ds"), F.explode(tokens(F.col("text"))).alias("w")).groupBy("ds", "w").agg(F.count(F.lit(1)).alias("k"))
    n = d.groupBy(F.col("source").alias("ds")).agg(F.count(F.lit(1)).alias("n"))
    return w.join(n, "ds").where("k * 10 >= n * 2 AND k * 10 < n * 4")


def columns(t: Tables) -> DataFrame:
    plain = word_freq(t).where("length(w) >= 5").select("ds", F.col("w").alias("col"))
    ds = t.documents.select(F.col("source").alias("ds")).distinct()
    return plain.unionByName(ds.select("ds", F.explode(F.array(F.lit("Apache License"), F.lit("MIT License"))).alias("col")))


@query("e1_sentences", f"WITH {SENTS_SQL} SELECT doc_id, pos, sentence FROM sents")
def e1(t: Tables):
    return sents(t).select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


@query(
    "e2_field_fan_out",
    """SELECT doc_id, field, text FROM (SELECT doc_id, 'abstract' AS field, text FROM documents UNION ALL SELECT doc_id, 'info.lang', lang FROM documents UNION ALL SELECT doc_id, 'info.source', source FROM documents
      UNION ALL SELECT doc_id, 'paper.title', CASE WHEN doc_id % 2 = 0 THEN 'T' || doc_id ELSE '' END FROM documents UNION ALL SELECT doc_id, 'variables[' || source || ']', lang FROM documents) WHERE trim(text) <> ''""",
)
def e2(t: Tables):
    rec = t.documents.select(
        "doc_id",
        F.col("text").alias("abstract"),
        F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("info"),
        F.struct(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("T"), F.col("doc_id").cast("string"))).otherwise("").alias("title")).alias("paper"),
        F.array(F.struct(F.col("source").alias("name"), F.lit("Feature").alias("role"), F.col("lang").alias("description"))).alias("variables"),
    )
    return E.fan_out(rec, "doc_id", ["abstract"], ["info"], {"paper": ["title"]}, ["variables"])


@query("e3_family_classification", f"WITH {HITS_SQL} SELECT doc_id, pos, family, trigger, sentence FROM hits")
def e3(t: Tables):
    return hits(t).select("doc_id", F.col("pos").cast("long").alias("pos"), "family", "trigger", "sentence")


VERB = r"(and|of|le|der)\s+[a-z]+"


def after_name_sql(names: str, need: str, width: int) -> str:
    """Windows after each place where a target of the dataset stands as a whole word; positions instead of look-around."""
    return f"""{SENTS_SQL}, {WORDS_SQL}, named AS ({names}),
 targets AS (SELECT DISTINCT ds, target FROM (SELECT ds, col AS target FROM named UNION ALL SELECT ds, regexp_replace(col, '[_-]+', ' ', 'g') FROM named) WHERE length(target) >= 3),
 near AS (SELECT doc_id, pos, sentence, target FROM sents JOIN targets USING (ds) WHERE regexp_matches(sentence, '(?i){need}') AND contains(lower(sentence), lower(target))),
 place AS (SELECT *, unnest(range(1, length(sentence) - length(target) + 2)) AS p FROM near),
 windows AS (SELECT doc_id, pos, target, p, regexp_extract(substr(sentence, p + length(target)), '^.{{0,{width}}}', 0) AS w FROM place WHERE lower(substr(sentence, p, length(target))) = lower(target)
   AND (p = 1 OR NOT regexp_matches(substr(sentence, p - 1, 1), '[A-Za-z0-9_]')) AND NOT regexp_matches(substr(sentence, p + length(target), 1), '[A-Za-z0-9_]'))"""


PLAIN_NAME = "regexp_matches(col, '^[A-Za-z0-9_]+$')"


@query(
    "e4_define_by_target_name",
    f"""WITH {after_name_sql(f"SELECT ds, min(col) AS col FROM cols WHERE {PLAIN_NAME} GROUP BY ds", VERB, 90)},
 best AS (SELECT doc_id, pos, target, arg_min(w, p) AS w FROM windows WHERE regexp_matches(w, '(?i){VERB}') GROUP BY ALL)
 SELECT doc_id, pos, target, target || regexp_extract(w, '(?is)^.*?(?:{VERB})', 0) AS trigger FROM best""",
)
def e4(t: Tables):
    """A dataset's own target, and how it is said to be made."""
    roles = columns(t).where(F.col("col").rlike("^[A-Za-z0-9_]+$")).groupBy("ds").agg(F.min("col").alias("col")).withColumn("role", F.lit("Target"))
    targets = E.target_names(roles, roles.select("ds", F.lit(None).cast("string").alias("target")))
    return E.define_by_target(sents(t), targets, VERB).select("doc_id", F.col("pos").cast("long").alias("pos"), "target", "trigger")


@query(
    "e5_condset_by_target_name",
    f"""WITH {after_name_sql(f"SELECT ds, col FROM cols WHERE {PLAIN_NAME}", "(that|der|les|los)", 60)}
 SELECT DISTINCT doc_id, pos, target, 'CONDSET_NAMED' AS family FROM windows WHERE regexp_matches(w, '(?i)^\\s+(of|and|le|la|die)')""",
)
def e5(t: Tables):
    """A condition, and the target directly followed by an assignment."""
    roles = columns(t).where(F.col("col").rlike("^[A-Za-z0-9_]+$")).withColumn("role", F.lit("Target"))
    targets = E.target_names(roles, roles.select("ds", F.lit(None).cast("string").alias("target")))
    h = E.condset_by_target(sents(t), targets, r"(that|der|les|los)", r"\s+(of|and|le|la|die)")
    return h.select("doc_id", F.col("pos").cast("long").alias("pos"), "target", "family")


@query(
    "e6_column_anchoring",
    f"""WITH {HITS_SQL}, {WORDS_SQL}, a AS (SELECT doc_id, pos, col FROM hits JOIN cols USING (ds) WHERE regexp_matches(sentence, '(^|[^A-Za-z0-9_])' || col || '([^A-Za-z0-9_]|$)')),
   g AS (SELECT doc_id, pos, array_to_string(list_transform(list_sort(list(DISTINCT struct_pack(l := -length(col), c := col))), lambda x: x.c), '|') AS columns FROM a GROUP BY ALL)
   SELECT h.doc_id, h.pos, coalesce(columns, '') AS columns FROM hits h LEFT JOIN g USING (doc_id, pos)""",
)
def e6(t: Tables):
    a = E.anchor(kept_hits(t), columns(t), ["doc_id", "pos"], 2)
    return a.select("doc_id", F.col("pos").cast("long").alias("pos"), F.array_join("columns", "|").alias("columns"))


@query(
    "e6_column_anchoring_ignoring_case",
    f"""WITH {HITS_SQL}, {WORDS_SQL}, a AS (SELECT DISTINCT doc_id, pos, col FROM hits JOIN cols USING (ds) WHERE length(col) >= 3 AND regexp_matches(sentence, '(?i)(^|[^A-Za-z0-9_])' || col || '([^A-Za-z0-9_]|$)'))
   SELECT doc_id, count(*) AS n FROM a GROUP BY doc_id""",
)
def e6b(t: Tables):
    a = E.anchor(kept_hits(t), columns(t), ["doc_id", "pos"], 3, True)
    return a.groupBy("doc_id").agg(F.sum(F.size("columns")).alias("n")).where("n > 0")


@query(
    "e7_self_anchored_fields",
    """SELECT doc_id, field, CASE WHEN doc_id % 2 = 0 THEN 'v' || (doc_id % 9) || ',' || lang ELSE lang END AS columns FROM (SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN 'variables[v' || (doc_id % 9) || ']' ELSE 'abstract' END AS field FROM documents)""",
)
def e7(t: Tables):
    h = t.documents.select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("variables[v"), (F.col("doc_id") % 9).cast("string"), F.lit("]"))).otherwise("abstract").alias("field"), F.array("lang").alias("columns")
    )
    return E.self_anchor(h).withColumn("columns", F.array_join("columns", ","))


HEAD = r"(?i)(the|und|les|los)"


#: Lines with their block: headings found by structure, a block up to any next heading.
LINES_SQL = r"""l AS (SELECT doc_id, source AS ds, unnest(generate_series(0, len(p) - 1)) AS i, unnest(p) AS line FROM (SELECT doc_id, source, string_split_regex(text, '\r?\n') AS p FROM documents)),
   h AS (SELECT *, trim(line) <> '' AND length(trim(line)) <= 130 AND NOT regexp_matches(trim(line), '^\s*(\d{1,3})[.)]\s+(.*)$') AND NOT regexp_matches(trim(line), '(?i)^\s*(cases|missing|\d|[-+]?\d*\.?\d+%?)\b')
      AND NOT contains(line, chr(9)) AND regexp_matches(trim(line), '[A-Za-z]{4}') AS hd FROM l),
   b AS (SELECT *, sum(hd::INT) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS block FROM h)"""


@query(
    "e8_heading_blocks",
    f"""WITH {LINES_SQL}
   SELECT doc_id, block::BIGINT AS block, max(CASE WHEN hd THEN trim(line) END) AS heading, count(*) - 1 AS n_lines FROM b WHERE block >= 0 GROUP BY doc_id, block HAVING regexp_matches(max(CASE WHEN hd THEN trim(line) END), '{HEAD}')""",
)
def e8(t: Tables):
    b = E.heading_blocks(cards(t), HEAD)
    return b.select("doc_id", F.col("block").cast("long").alias("block"), "heading", F.col("n_lines").cast("long").alias("n_lines"))


@query(
    "e8_block_columns",
    f"""WITH {LINES_SQL}, {WORDS_SQL},
   body AS (SELECT doc_id, ds, block, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT hd) AS body FROM b WHERE block >= 0 GROUP BY doc_id, ds, block HAVING regexp_matches(max(CASE WHEN hd THEN trim(line) END), '{HEAD}')),
   a AS (SELECT doc_id, block, col FROM body JOIN cols USING (ds) WHERE regexp_matches(body, '(^|[^A-Za-z0-9_])' || col || '([^A-Za-z0-9_]|$)'))
   SELECT doc_id, block::BIGINT AS block, array_to_string(list_transform(list_sort(list(DISTINCT struct_pack(l := -length(col), c := col))), lambda x: x.c), '|') AS columns FROM a GROUP BY doc_id, block""",
)
def e8b(t: Tables):
    """Columns named inside outcome blocks."""
    b = E.heading_blocks(cards(t), HEAD)
    a = E.anchor(b, columns(t), ["doc_id", "block"], 2, text="body")
    return a.where(F.size("columns") > 0).select("doc_id", F.col("block").cast("long").alias("block"), F.array_join("columns", "|").alias("columns"))


MARK, MWARN = r"(?i)(licen[sc]e[a-z]*|[0-9]{3}-[0-9]{4})", r"(?i)version [0-9]"


@query(
    "e9_dictionary_markers",
    f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '{MARK}', 0), lambda x: lower(x)))), '|') AS markers,
   CASE WHEN regexp_matches(text, '{MWARN}') THEN 'E2' ELSE 'E1' END AS tier_hint FROM documents WHERE regexp_matches(text, '{MARK}') OR regexp_matches(text, '{MWARN}')""",
)
def e9(t: Tables):
    return E.dictionary_screen(t.documents, "text", MARK, MWARN).select("doc_id", F.array_join("markers", "|").alias("markers"), "tier_hint")


@query(
    "e10_structured_before_prose",
    f"""WITH {WORDS_SQL}, st AS (SELECT ds, col, CASE WHEN length(col) % 3 = 0 THEN 'a license of ' || col ELSE 'plain ' || col END AS description FROM cols),
   s AS (SELECT ds, col, 'structured' AS via FROM st WHERE regexp_matches(description, '{MARK}')),
   fr AS (SELECT ds, doc_id, trim(regexp_replace(unnest(string_split(regexp_replace(text, '([.;\n])\\s+', '\\1' || chr(1), 'g'), chr(1))), '\\s+', ' ', 'g')) AS frag FROM (SELECT source AS ds, doc_id, text FROM documents)),
   p AS (SELECT DISTINCT ds, col, 'prose' AS via FROM fr JOIN cols USING (ds) WHERE length(frag) BETWEEN 1 AND 400 AND (regexp_matches(frag, '{MARK}') OR regexp_matches(frag, '{MWARN}'))
      AND length(col) >= 3 AND regexp_matches(frag, '(?i)(^|[^A-Za-z0-9_])' || col || '([^A-Za-z0-9_]|$)'))
   SELECT * FROM s UNION ALL SELECT * FROM p ANTI JOIN s USING (ds, col)""",
)
def e10(t: Tables):
    c = columns(t)
    st = c.withColumn("description", F.when(F.length("col") % 3 == 0, F.concat(F.lit("a license of "), "col")).otherwise(F.concat(F.lit("plain "), "col")))
    prose = t.documents.select(F.col("source").alias("ds"), "doc_id", "text")
    return E.two_source_sieve(st, prose, c, MARK, MWARN).select("ds", "col", "via")


PHRASES = [(r"released under", "RELEASED"), (r"licen[sc]ed? under", "LICENSED"), (r"(?:token|secret) = ", "SECRET")]


@query(
    "e11_explicit_quotes",
    r"""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM documents), m AS (SELECT *, CASE WHEN regexp_matches(s, '(?i)released under') THEN 'RELEASED'
     WHEN regexp_matches(s, '(?i)licen[sc]ed? under') THEN 'LICENSED' WHEN regexp_matches(s, '(?i)(?:token|secret) = ') THEN 'SECRET' END AS kind FROM d),
   h AS (SELECT *, regexp_extract(s, CASE kind WHEN 'RELEASED' THEN '(?i)released under' WHEN 'LICENSED' THEN '(?i)licen[sc]ed? under' ELSE '(?i)(?:token|secret) = ' END, 0) AS matched FROM m WHERE kind IS NOT NULL)
   SELECT doc_id, kind, matched, trim(substr(s, greatest(instr(s, matched) - 60, 1), instr(s, matched) + length(matched) + 60 - greatest(instr(s, matched) - 60, 1))) AS quote FROM h""",
)
def e11(t: Tables):
    return E.explicit_quotes(t.documents, "text", PHRASES).select("doc_id", "kind", "matched", "quote")


CW = r"(?i)the (?:on|th|an)[a-z]*"
CW_SQL = rf"""cw AS (SELECT doc_id, source AS ds, quality, toxic, doc_id % 10 = 0 AS is_target, CASE WHEN doc_id % 97 = 96 AND source IN ('src1', 'src2', 'src3') THEN '' ELSE trim(text) END AS d FROM documents LEFT JOIN labels USING (doc_id)),
 oc AS (SELECT *, regexp_extract_all(d, '{CW}', 0) AS h, string_split_regex(d, '{CW}') AS g FROM cw),
 ok AS (SELECT *, list_filter(list_transform(range(1, len(h) + 1), lambda i: CASE WHEN regexp_matches(lower(right(CASE WHEN i > 1 THEN h[i - 1] ELSE '' END || g[i], 8)), '\bat (?:the )?$') THEN NULL ELSE lower(h[i]) END), lambda x: x IS NOT NULL) AS good FROM oc),
 lab AS (SELECT *, CASE WHEN is_target THEN 'TARGET' WHEN len(good) > 0 THEN 'LEAKY' ELSE 'CLEAN' END AS verdict, CASE WHEN NOT is_target THEN good[1] END AS phrase FROM ok)"""


def closed(t: Tables):
    k = F.col("doc_id")
    blank = (k % 97 == 96) & F.col("source").isin("src1", "src2", "src3")
    rows = t.documents.join(t.labels, "doc_id", "left").select(
        k, F.col("source").alias("ds"), k.cast("string").alias("col"), "toxic", (k % 10 == 0).alias("is_target"), F.when(blank, "").otherwise(F.col("text")).alias("description")
    )
    return E.closed_world(rows, CW, r"(?i)zzzz")


@query("e12_closed_world_label", f"WITH {CW_SQL} SELECT doc_id, verdict, phrase FROM lab")
def e12(t: Tables):
    return closed(t).select("doc_id", "verdict", "phrase")


@query(
    "e13_complete_dictionaries",
    f"WITH {CW_SQL} SELECT ds, bool_and(d <> '') AS complete, count(*) AS n_cols FROM lab GROUP BY ds",
)
def e13(t: Tables):
    return E.complete_dictionaries(closed(t))


@query(
    "e13_closed_world_report",
    f"""WITH {CW_SQL}, sc AS (SELECT ds FROM lab GROUP BY ds HAVING bool_and(d <> '')), i AS (SELECT lab.* FROM lab SEMI JOIN sc USING (ds))
   SELECT count(DISTINCT ds) AS n_ds, count(*) AS n_cols, count(*) FILTER (WHERE verdict = 'LEAKY') AS n_leaky, count(*) FILTER (WHERE verdict = 'TARGET') AS n_target, count(*) FILTER (WHERE toxic = 1) AS n_pos,
   count(*) FILTER (WHERE toxic = 1 AND verdict = 'LEAKY') AS n_hit, round(count(*) FILTER (WHERE verdict = 'LEAKY') / count(*), 6)::DOUBLE AS flag_rate,
   round(count(*) FILTER (WHERE toxic = 1 AND verdict = 'LEAKY') / count(*) FILTER (WHERE toxic = 1), 6)::DOUBLE AS recall FROM i""",
)
def e13b(t: Tables):
    c = closed(t)
    truth = c.select("ds", "col", (F.coalesce("toxic", F.lit(0)) == 1).alias("is_pos"))
    return rounded(E.closed_world_report(c.select("ds", "col", "description", "verdict"), truth), "flag_rate", "recall")


@query(
    "e14_documentation_coverage",
    rf"""WITH {WORDS_SQL}, c AS (SELECT ds, col, CASE WHEN length(col) % 2 = 0 THEN col END AS description FROM cols), lw AS (SELECT DISTINCT source AS ds, unnest(string_split_regex(lower(text), '[^A-Za-z0-9_]+')) AS w FROM documents)
   SELECT c.ds, count(*) AS n_cols, round(avg((description IS NOT NULL)::INT), 6)::DOUBLE AS described, round(avg((lw.w IS NOT NULL)::INT), 6)::DOUBLE AS in_prose FROM c LEFT JOIN lw ON lw.ds = c.ds AND lw.w = lower(c.col) GROUP BY c.ds""",
)
def e14(t: Tables):
    c = columns(t).withColumn("description", F.when(F.length("col") % 2 == 0, F.col("col")))
    prose = t.documents.select(F.col("source").alias("ds"), "text")
    return rounded(E.documentation_coverage(c, prose), "described", "in_prose")


@query(
    "e15_paper_statements",
    r"""WITH d AS (SELECT doc_id, regexp_replace(replace(text, '-' || chr(10), ''), '\s+', ' ', 'g') AS x FROM documents),
   p AS (SELECT doc_id, string_split(regexp_replace(x, '([.;:])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM d),
   s AS (SELECT doc_id, unnest(generate_series(0, len(p) - 1)) AS pos, trim(regexp_replace(unnest(p), '\s+', ' ', 'g')) AS s FROM p),
   f AS (SELECT *, regexp_matches(s, '(?i)licen[sc]ed') AS a, regexp_matches(s, '(?i)token|secret') AS r, regexp_matches(s, '(?i)version') AS late, regexp_matches(s, '(?i)mail') AS ident, regexp_matches(s, '[A-Z]{3,}') AS c FROM s WHERE length(s) BETWEEN 25 AND 600)
   SELECT doc_id, pos, s AS sentence, CASE WHEN ident AND NOT late THEN 'IDENTIFIER' WHEN late AND c THEN 'TIMING_CLAIM' WHEN a AND c THEN 'EXCLUSION' WHEN late THEN 'TIMING_NO_COLUMN' ELSE 'GENERIC' END AS kind FROM f WHERE r OR (a AND c)""",
)
def e15(t: Tables):
    s = E.statements(t.documents.select("doc_id", "text"), action="licen[sc]ed", reason="token|secret", timing="version", identifier="mail", named="qqqq", column_like="[A-Z]{3,}")
    return s.select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence", "kind")


@query("e16_dictionary_rows")
def e16(t: Tables):
    """Rows only: the row pattern looks ahead to the next row."""
    p = t.documents.select(F.col("lang").alias("ds"), "source", F.col("doc_id").alias("page"), "text")
    return E.dictionary_rows(p, marker=r"(?i)licen[sc]e|mail", extra=r"(?i)token").select("ds", "source", "col", "page", "marker", "is_target_row")


@query("e17_anchored_windows")
def e17(t: Tables):
    """Rows only: windows around matches need look-around."""
    p = t.documents.select(F.col("source").alias("ds"), "source", F.col("doc_id").alias("page"), "text")
    w = E.anchored_windows(p, columns(t), marker=r"(?i)licen[sc]e", timing=r"(?i)token", reason=r"(?i)secret", dictish=r"[0-9]")
    return w.select("ds", "source", "col", "page", "dictish", F.length("quote").alias("n_chars"))


@query(
    "e18_corroborated_columns",
    """WITH w AS (SELECT DISTINCT lang AS ds, source, unnest(string_split_regex(text, '[^A-Za-z0-9_]+')) AS col FROM documents) SELECT ds, col, count(*) AS n_sources FROM w WHERE length(col) >= 12 GROUP BY ds, col HAVING count(*) >= 2""",
)
def e18(t: Tables):
    w = t.documents.select(F.col("lang").alias("ds"), "source", F.explode(tokens(F.col("text"))).alias("col")).where(F.length("col") >= 12)
    return E.corroborated(w)


@query("e19_licence_adjudication")
def e19(t: Tables):
    """Rows only: spans up to the next row need look-around."""
    c = t.documents.select(
        "doc_id", F.when(F.col("lang") == "en", "the").when(F.col("lang") == "de", "der").when(F.col("lang") == "fr", "les").otherwise("los").alias("col"),
        F.col("text").alias("quote"), (F.col("doc_id") % 3 == 0).alias("dictish"), (F.col("doc_id") % 11 == 0).alias("is_target"),
    )
    return E.adjudicate_licence(c, r"(?i)(and|und|la|el) [a-z]+", r"(?i)(secret|token)", r"(?i)licen[sc]e").select("doc_id", "reject", "licence_kind", "licensing_phrase")


@query(
    "e20_synthetic_scope",
    r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)(token|secret)') THEN regexp_extract(text, '(?i)(token|secret)', 0) END AS synthetic,
   CASE WHEN regexp_matches(text, '(?i)(token|secret)') THEN CASE WHEN doc_id % 2 = 0 THEN 'scoped' ELSE 'whole' END END AS synthetic_scope FROM documents""",
)
def e20(t: Tables):
    d = t.documents.withColumn("configs", F.array("lang", F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit("_synth"))).otherwise(F.col("lang"))))
    return E.synthetic(d, r"(?i)(token|secret)", "configs").select("doc_id", "synthetic", "synthetic_scope")


MIRROR_SQL = r"""lw AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(lang || ' ' || text), '[^a-z0-9_]+')) AS word FROM documents),
 fpw AS (SELECT DISTINCT ds AS name, substr(ds, 4)::BIGINT AS rank, lower(w) AS word, CASE WHEN length(w) >= 4 THEN 'long' ELSE 'short' END AS kind FROM freq WHERE length(w) >= 2 AND k * 10 >= n * 2 AND k * 10 < n * 4),
 fp AS (SELECT * FROM fpw UNION ALL SELECT name, any_value(rank), min(word), 'target' FROM fpw WHERE kind = 'long' GROUP BY name),
 sz AS (SELECT name, count(*) AS size FROM fp WHERE kind = 'long' GROUP BY name),
 hit AS (SELECT doc_id, name, rank, kind FROM lw JOIN fp USING (word)
   UNION ALL SELECT doc_id, 'src3', 3, 'credit' FROM documents WHERE contains(lower(lang || ' ' || text), 'mit license')
   UNION ALL SELECT doc_id, 'src5', 5, 'credit' FROM lw WHERE word = 'secret'),
 per AS (SELECT doc_id, name, rank, count(*) FILTER (WHERE kind = 'long') AS n_long, count(*) FILTER (WHERE kind = 'short') AS n_short, count(*) FILTER (WHERE kind = 'target') AS n_target, count(*) FILTER (WHERE kind = 'credit') AS n_credit FROM hit GROUP BY ALL),
 rl AS (SELECT per.*, CASE WHEN n_credit > 0 THEN 'source name' WHEN n_long >= greatest(4, floor(0.25 * size)) THEN 'column overlap' WHEN n_short >= 6 THEN 'short names' WHEN n_target > 0 AND n_long + n_short >= 2 THEN 'target and two names' END AS rule FROM per LEFT JOIN sz USING (name)),
 mir AS (SELECT doc_id, name AS mirror, rule, n_long, n_short FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank, name) AS rn FROM rl WHERE rule IS NOT NULL) WHERE rn = 1)"""


def mirror_inputs(t: Tables):
    rank = F.expr("cast(substr(ds, 4) as bigint)")
    w = word_freq(t).where("length(w) >= 2").select(F.col("ds").alias("name"), rank.alias("rank"), F.lower("w").alias("word"), F.when(F.length("w") >= 4, "long").otherwise("short").alias("kind")).distinct()
    target = w.where("kind = 'long'").groupBy("name").agg(F.max("rank").alias("rank"), F.min("word").alias("word")).withColumn("kind", F.lit("target"))
    ds = t.documents.select(F.col("source").alias("ds")).distinct()
    credits = ds.where("ds IN ('src3', 'src5')").select(F.col("ds").alias("name"), rank.alias("rank"), F.when(F.col("ds") == "src3", "MIT License").otherwise("secret").alias("phrase"))
    docs = t.documents.select("doc_id", F.col("lang").alias("title"), "text")
    return docs, w.unionByName(target.select("name", "rank", "word", "kind")), credits


@query("e21_mirror_detection", f"WITH {WORDS_SQL}, {MIRROR_SQL} SELECT * FROM mir")
def e21(t: Tables):
    return E.mirrors(*mirror_inputs(t))


@query(
    "e22_schema_mirrors",
    f"""WITH {WORDS_SQL}, f AS (SELECT DISTINCT ds AS name, lower(w) AS word FROM freq WHERE length(w) >= 4 AND k * 10 >= n * 2 AND k * 10 < n * 4), sz AS (SELECT name, count(*) AS size FROM f GROUP BY name),
   s AS (SELECT DISTINCT doc_id AS did, lower(w) AS word FROM wd WHERE length(w) >= 4), sh AS (SELECT did, name, count(*) AS shared FROM s JOIN f USING (word) GROUP BY ALL)
   SELECT did, min(name) AS mirror, arg_min(shared, name) AS shared FROM sh JOIN sz USING (name) WHERE shared >= greatest(4, floor(0.6 * size)) GROUP BY did""",
)
def e22(t: Tables):
    f = word_freq(t).where("length(w) >= 4").select(F.col("ds").alias("name"), F.col("w").alias("word"))
    s = t.documents.select(F.col("doc_id").alias("did"), F.explode(tokens(F.col("text"))).alias("col"))
    return E.schema_mirrors(s, f)


@query(
    "e23_sieve_funnel",
    f"""WITH {HITS_SQL}, {WORDS_SQL}, {MIRROR_SQL}, hd AS (SELECT DISTINCT doc_id FROM hits), an AS (SELECT DISTINCT doc_id FROM hits JOIN cols USING (ds) WHERE length(col) >= 3 AND regexp_matches(sentence, '(^|[^A-Za-z0-9_])' || col || '([^A-Za-z0-9_]|$)')),
   fl AS (SELECT d.doc_id, hd.doc_id IS NOT NULL AS trig, NOT regexp_matches(text, '(?i)(token|secret)') AS real_, mir.doc_id IS NULL AS new_, d.doc_id % 5 > 0 AS readable, an.doc_id IS NOT NULL AS anch
      FROM documents d LEFT JOIN hd USING (doc_id) LEFT JOIN mir USING (doc_id) LEFT JOIN an USING (doc_id))
   SELECT 0 AS step, 'swept' AS stage, count(*) AS n FROM fl UNION ALL SELECT 1, 'triggered', count(*) FILTER (WHERE trig) FROM fl UNION ALL SELECT 2, 'not synthetic', count(*) FILTER (WHERE trig AND real_) FROM fl
   UNION ALL SELECT 3, 'no re-upload', count(*) FILTER (WHERE trig AND real_ AND new_) FROM fl UNION ALL SELECT 4, 'readable schema', count(*) FILTER (WHERE trig AND real_ AND new_ AND readable) FROM fl
   UNION ALL SELECT 5, 'anchored', count(*) FILTER (WHERE trig AND real_ AND new_ AND readable AND anch) FROM fl""",
)
def e23(t: Tables):
    h = kept_hits(t)
    a = E.anchor(h.select("doc_id", "pos", "ds", "sentence"), columns(t), ["doc_id", "pos"], 3)
    per = a.groupBy("doc_id").agg(F.bool_or(F.size("columns") > 0).alias("anch"))
    mir = E.mirrors(*mirror_inputs(t)).select("doc_id", F.lit(False).alias("new"))
    flags = E.synthetic(t.documents, r"(?i)(token|secret)").select("doc_id", F.col("synthetic").isNull().alias("real")).join(per, "doc_id", "left").join(mir, "doc_id", "left")
    stages = {
        "swept": F.lit(True), "triggered": F.col("anch").isNotNull(), "not synthetic": F.col("real"), "no re-upload": F.coalesce("new", F.lit(True)),
        "readable schema": F.col("doc_id") % 5 > 0, "anchored": F.col("anch"),
    }
    return E.funnel(flags, stages)


@query("e24_populated_field_guard", "SELECT lang, count(*) AS n FROM documents WHERE trim(text) <> '' GROUP BY lang")
def e24(t: Tables):
    """The yield per language, refused if no text were filled."""
    E.require_populated(t.documents, "text")
    return t.documents.where(F.trim("text") != "").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(
    "e25_gate_comparison",
    f"""WITH {SENTS_SQL}, a AS (SELECT DISTINCT doc_id, pos FROM sents WHERE regexp_matches(sentence, '{WARN}')), b AS (SELECT DISTINCT doc_id, pos FROM sents WHERE regexp_matches(sentence, '{WARN}') AND length(sentence) < 60 OR regexp_matches(sentence, '{DEFINE}')),
   j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NOT NULL AS in_a, b.doc_id IS NOT NULL AS in_b FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.pos = b.pos)
   SELECT in_a, in_b, count(*) AS n_hits, count(DISTINCT doc_id) AS n_docs FROM j GROUP BY ALL""",
)
def e25(t: Tables):
    s = sents(t)
    x = F.col("sentence")
    return E.gate_comparison(s.where(x.rlike(WARN)), s.where((x.rlike(WARN) & (F.length(x) < 60)) | x.rlike(DEFINE)), ["doc_id", "pos"])


@query(
    "e26_scarcity",
    f"""WITH {SENTS_SQL}, h AS (SELECT DISTINCT lang AS population, doc_id AS ds FROM sents WHERE regexp_matches(sentence, '{WARN}') UNION SELECT DISTINCT lang, doc_id FROM sents WHERE regexp_matches(sentence, '{DEFINE}')),
   v AS (SELECT lang AS population, doc_id AS ds, CASE doc_id % 6 WHEN 0 THEN 'TARGET_LEAK' WHEN 1 THEN 'GROUP' WHEN 2 THEN 'CONTAMINATION' WHEN 3 THEN 'IDENTIFIER' WHEN 4 THEN 'OUT' END AS verdict FROM documents WHERE doc_id % 6 < 5),
   g AS (SELECT population, count(*) AS hit, count(*) FILTER (WHERE verdict = 'TARGET_LEAK') AS target_leak, count(*) FILTER (WHERE verdict = 'GROUP') AS "group", count(*) FILTER (WHERE verdict = 'CONTAMINATION') AS contamination,
     count(*) FILTER (WHERE verdict = 'IDENTIFIER') AS identifier, count(*) FILTER (WHERE verdict = 'OUT') AS "out" FROM h LEFT JOIN v USING (population, ds) GROUP BY population),
   n AS (SELECT lang AS population, count(DISTINCT doc_id) AS swept FROM documents GROUP BY lang)
   SELECT population, swept, coalesce(hit, 0) AS hit, coalesce(target_leak, 0) AS target_leak, coalesce("group", 0) AS "group", coalesce(contamination, 0) AS contamination, coalesce(identifier, 0) AS identifier, coalesce("out", 0) AS "out",
   round(coalesce(target_leak, 0) / swept, 6)::DOUBLE AS rate FROM n LEFT JOIN g USING (population)""",
)
def e26(t: Tables):
    s = sents(t).select(F.col("lang").alias("population"), F.col("doc_id").alias("ds"), "sentence")
    k = F.col("doc_id") % 6
    v = t.documents.where("doc_id % 6 < 5").select(
        F.col("lang").alias("population"), F.col("doc_id").alias("ds"),
        F.element_at(F.array(*[F.lit(x) for x in ("TARGET_LEAK", "GROUP", "CONTAMINATION", "IDENTIFIER", "OUT")]), (k + 1).cast("int")).alias("verdict"),
    )
    swept = t.documents.select(F.col("lang").alias("population"), F.col("doc_id").alias("ds"))
    return rounded(E.scarcity([s.where(F.col("sentence").rlike(WARN)), s.where(F.col("sentence").rlike(DEFINE))], v, swept), "rate")


@query(
    "e27_quote_verification",
    r"""WITH r AS (SELECT doc_id, source AS ds, 'n' || (doc_id % 40) AS col, CASE WHEN doc_id % 9 = 0 THEN 'never said this' ELSE replace(text, ' ', '  ') END AS quote, text FROM documents), hd AS (SELECT DISTINCT source AS ds, 'n' || (doc_id % 39) AS col FROM documents),
   n AS (SELECT *, lower(trim(regexp_replace(replace(text, '’', ''''), '\s+', ' ', 'g'))) AS a, lower(trim(regexp_replace(replace(quote, '’', ''''), '\s+', ' ', 'g'))) AS b FROM r)
   SELECT ds, col, doc_id, 'quote not in source' AS problem FROM n WHERE NOT contains(a, b) UNION ALL SELECT ds, col, doc_id, 'column not in header' FROM r ANTI JOIN hd USING (ds, col)""",
)
def e27(t: Tables):
    d = t.documents
    rec = d.select("doc_id", F.col("source").alias("ds"), F.concat(F.lit("n"), (F.col("doc_id") % 40).cast("string")).alias("col"), F.when(F.col("doc_id") % 9 == 0, "never said this").otherwise(F.regexp_replace("text", " ", "  ")).alias("quote"))
    head = d.select(F.col("source").alias("ds"), F.concat(F.lit("n"), (F.col("doc_id") % 39).cast("string")).alias("col")).distinct()
    return E.verify_quotes(rec, d.select("doc_id", "text"), head, ["doc_id"])


@query(
    "e28_dataset_frame",
    """WITH k AS (SELECT p_name AS name, p_partkey AS did, p_size, p_retailprice AS usage FROM part WHERE p_size >= 5 AND p_retailprice >= 950), o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY name ORDER BY usage DESC, did) = 1)
   SELECT name, did, p_size, usage, row_number() OVER (ORDER BY usage DESC, did) AS rank FROM o ORDER BY usage DESC, did LIMIT 40""",
)
def e28(t: Tables):
    reg = t.part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("did"), "p_size", F.col("p_retailprice").alias("usage"))
    f = E.build_frame(reg, (F.col("p_size") >= 5) & (F.col("usage") >= 950), "usage", 40)
    return f.withColumn("rank", F.col("rank").cast("long"))


@query(
    "e29_review_funnel",
    rf"""WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN [] ELSE ['c_' || doc_id, CASE WHEN doc_id % 50 = 1 THEN 'license_no' ELSE 'x' END] END AS c FROM documents),
   f AS (SELECT *, len(list_filter(list_transform(string_split(regexp_replace(text, '([.;\n])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: length(s) BETWEEN 1 AND 400 AND (regexp_matches(s, '{MARK}') OR regexp_matches(s, '{MWARN}')))) > 0 AS x,
      len(list_filter(c, lambda s: regexp_matches(replace(s, '_', ' '), '{MARK}'))) > 0 AS y FROM d)
   SELECT 'considered' AS what, count(*) AS n FROM f UNION ALL SELECT 'no_columns', count(*) FILTER (WHERE len(c) = 0) FROM f UNION ALL SELECT 'no_description', count(*) FILTER (WHERE length(text) < 200) FROM f UNION ALL SELECT 'with_candidates', count(*) FILTER (WHERE x OR y) FROM f""",
)
def e29(t: Tables):
    k = F.col("doc_id")
    cols = F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("c_"), k.cast("string")), F.when(k % 50 == 1, "license_no").otherwise("x")))
    return E.review_funnel(t.documents.select("text", cols.alias("columns")), 200, MARK, MWARN)


@query(
    "e38_text_length_profile",
    """SELECT lang, count(*) AS n, round(avg((length(text) > 200)::INT), 6)::DOUBLE AS substantive, round(avg((length(text) > 0)::INT), 6)::DOUBLE AS non_empty, median(length(text))::DOUBLE AS median_length FROM documents GROUP BY lang""",
)
def e38(t: Tables):
    return rounded(E.text_profile(t.documents, ["lang"]), "substantive", "non_empty")


@query(
    "e39_candidate_list",
    f"""WITH {HITS_SQL} SELECT doc_id, count(*) AS n_hits, count(DISTINCT left(sentence, 60)) AS n_sentences, min(sentence) AS example FROM hits GROUP BY doc_id ORDER BY n_hits DESC, doc_id LIMIT 30""",
)
def e39(t: Tables):
    return E.candidate_list(hits(t), "doc_id", 30)


@query(
    "e40_schema_exposure",
    """SELECT count(*) AS swept, count(*) FILTER (WHERE quality IS NOT NULL) AS has_schema, count(*) FILTER (WHERE quality = 1) AS anchored, count(*) FILTER (WHERE quality IS NULL) AS unreadable FROM documents LEFT JOIN labels USING (doc_id)""",
)
def e40(t: Tables):
    d = t.documents.join(t.labels, "doc_id", "left").select(F.col("quality").isNotNull().alias("has_schema"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("anchored"))
    return E.exposure(d, t.pages.select("page_id"), t.pages.select("page_id"))[0]


@query("e40_pages_never_received", "SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) ANTI JOIN (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system') USING (conv_id)")
def e40b(t: Tables):
    expected = t.conversations.select("conv_id").distinct()
    flags = t.documents.select(F.lit(True).alias("has_schema"), F.lit(True).alias("anchored"))
    return E.exposure(flags, expected, t.conversations.where("role = 'system'").select("conv_id").distinct())[1]


@query(
    "a17_card_preclean",
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""",
)
def a17(t: Tables):
    """Tags stripped from whole pages."""
    from colprov.sources.landing import strip_html

    return t.pages.select("page_id", strip_html(F.col("html")).alias("text"))
