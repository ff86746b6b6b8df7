"""The documentation sieve: find the sentences that say a column leaks.

Documents are ``(doc_id, field, text)`` with any further columns passed through.
Whole texts are read. Column names meet sentences through an equi-join on tokens;
only names that are no single token fall back to a pattern test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colprov.functions import vocab as V
from colprov.functions.joins import join_dim
from colprov.functions.special import ratio
from colprov.functions.text import (
    bind,
    escaped,
    first_match,
    matches,
    occurrences,
    squeeze,
    tokens,
    whole_token,
)
from colprov.operators.score import count_if
from colprov.operators.screens import MARKERS

SPLIT = r"(?<=[.!?;])\s+|\n+"
PLAIN = r"^[A-Za-z0-9_]+$"


def sentences(docs: DataFrame, lo: int = 15, hi: int = 600, text: str = "text", split: str = SPLIT) -> DataFrame:
    """One row per sentence of lo..hi characters, white space squeezed, with its position."""
    rest = [c for c in docs.columns if c != text]
    each = docs.select(*rest, F.posexplode(F.split(text, split)).alias("pos", "raw"))
    return each.select(*rest, "pos", squeeze(F.col("raw")).alias("sentence")).where(F.length("sentence").between(lo, hi))


def fan_out(records: DataFrame, id_col: str, texts: list[str], maps: list[str], structs: dict[str, list[str]], arrays: list[str]) -> DataFrame:
    """(id, field, text) for every non-empty prose field of a nested record: plain
    text columns, string maps, chosen struct fields, and arrays of (name, description)."""
    empty = F.array().cast("array<struct<field:string,text:string>>")
    parts = [F.array(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("text"))) for c in texts]
    for m in maps:
        named = F.transform(F.map_entries(m), lambda e: F.struct(F.concat(F.lit(f"{m}."), e["key"]).alias("field"), e["value"].alias("text")))
        parts.append(F.coalesce(named, empty))
    for s, fields in structs.items():
        parts.append(F.array(*[F.struct(F.lit(f"{s}.{f}").alias("field"), F.col(f"{s}.{f}").cast("string").alias("text")) for f in fields]))
    for a in arrays:
        named = F.transform(a, lambda e: F.struct(F.concat(F.lit(f"{a}["), e["name"], F.lit("]")).alias("field"), e["description"].alias("text")))
        parts.append(F.coalesce(named, empty))
    out = records.select(id_col, F.explode(F.flatten(F.array(*parts))).alias("e")).select(id_col, "e.field", "e.text")
    return out.where(F.trim(F.coalesce("text", F.lit(""))) != "")


# ------------------------------------------------------------ classification


def classify(
    sents: DataFrame,
    warn: str = V.alternation(V.WARN),
    define: str = V.alternation(V.DEFINE),
    condition: str = V.FLAGS + V.CONDITION,
    assign: str = V.FLAGS + V.ASSIGN,
    limit: int = 60,
) -> DataFrame:
    """Sentences of a family, WARN before DEFINE before CONDSET, with what triggered it."""
    s = F.col("sentence")
    family = F.when(s.rlike(warn), "WARN").when(s.rlike(define), "DEFINE").when(s.rlike(condition) & s.rlike(assign), "CONDSET")
    trigger = (
        F.when(F.col("family") == "WARN", F.regexp_extract(s, warn, 0))
        .when(F.col("family") == "DEFINE", F.regexp_extract(s, define, 0))
        .otherwise(F.regexp_extract(s, assign, 0))
    )
    return sents.withColumn("family", family).where("family IS NOT NULL").withColumn("trigger", F.substring(trigger, 1, limit))


def target_names(roles: DataFrame, declared: DataFrame) -> DataFrame:
    """Every plausible name of what a dataset predicts, at least 3 characters: columns
    with role Target, the declared target, and both with blanks for underscores."""
    t = (
        roles.where(F.lower("role") == "target").select("ds", F.col("col").alias("target"))
        .unionByName(declared.select("ds", F.trim("target").alias("target")))
        .where("target IS NOT NULL AND target <> ''")
    )
    human = t.select("ds", F.regexp_replace("target", r"[_\-]+", " ").alias("target"))
    return t.unionByName(human).distinct().where(F.length("target") >= 3)


def _after_name(sents: DataFrame, targets: DataFrame, need: Column, width: int) -> DataFrame:
    """Sentences that pass ``need`` and contain a target name of their dataset, with
    the text windows that follow its occurrences."""
    near = join_dim(sents.where(need), targets, ["ds"]).where(F.instr(F.lower("sentence"), F.lower("target")) > 0)
    pattern = F.concat(whole_token(F.col("target"), True), F.lit(f"(?=(.{{0,{width}}}))"))
    return near.withColumn("_windows", F.regexp_extract_all(F.col("sentence"), pattern, F.lit(1)))


def define_by_target(sents: DataFrame, targets: DataFrame, verb: str = V.DEFINE_VERB, width: int = 90) -> DataFrame:
    """Sentences where the dataset's own target is said to be built: its name, then
    within ``width`` characters the verb phrase. The constant pattern is tested first."""
    pat = V.FLAGS + verb
    hit = _after_name(sents, targets, F.col("sentence").rlike(pat), width).withColumn(
        "_w", F.get(F.filter("_windows", lambda w: w.rlike(pat)), F.lit(0))
    )
    said = F.concat("target", F.regexp_extract("_w", f"(?s){V.FLAGS}^.*?(?:{verb})", 0))
    return hit.where("_w IS NOT NULL").withColumns({"family": F.lit("DEFINE"), "trigger": said}).drop("_windows", "_w")


def condset_by_target(
    sents: DataFrame, targets: DataFrame, condition: str = V.CONDITION, verb: str = V.ASSIGN_VERB, width: int = 60
) -> DataFrame:
    """A condition, and the target's name directly followed (an optional noun
    between) by an assignment."""
    pat = V.FLAGS + "^" + verb
    hit = _after_name(sents, targets, F.col("sentence").rlike(V.FLAGS + condition), width)
    return hit.where(F.exists("_windows", lambda w: w.rlike(pat))).withColumn("family", F.lit("CONDSET_NAMED")).drop("_windows")


# --------------------------------------------------------------- anchoring


def longest_token(name: Column) -> Column:
    """The longest run of letters, digits and underscores in a name; '' if it has none."""
    runs = F.transform(tokens(name), lambda x: F.struct(F.length(x).alias("n"), x.alias("t")))
    return F.coalesce(F.array_max(runs)["t"], F.lit(""))


def anchor(hits: DataFrame, columns: DataFrame, key: list[str], min_len: int = 2, ignore_case: bool = False, text: str = "sentence") -> DataFrame:
    """Add ``columns``: the names of the dataset's columns that occur in the text as
    whole tokens, longest first. ``key`` identifies a hit; both sides carry ``ds``.

    Names and texts meet by equi-join on a token. A name of several tokens meets on
    its longest and is then verified in the text.
    """
    low = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    names = columns.where(F.length("col") >= min_len).select("ds", "col").distinct().withColumn("tok", longest_token(low(F.col("col"))))
    # a blank text holds the empty token, so that names without any token are still tried
    words = hits.select(*dict.fromkeys([*key, "ds"]), F.explode(F.array_union(tokens(low(F.col(text))), F.array(F.lit("")))).alias("tok"))
    plain = F.col("col").rlike(PLAIN)
    found = join_dim(words, names.where(plain), ["ds", "tok"]).select(*key, "col")
    other = names.where(~plain)
    if not other.isEmpty():
        near = join_dim(words, other, ["ds", "tok"]).select(*key, "col")
        odd = near.join(hits.select(*key, text), key).where(F.rlike(F.col(text), whole_token(F.col("col"), ignore_case)))
        found = found.unionByName(odd.select(*key, "col"))
    every = found.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_set(F.struct((-F.length("col")).alias("l"), F.col("col").alias("c")))), lambda x: x["c"]).alias("columns")
    )
    return hits.join(every, key, "left").withColumn("columns", F.coalesce("columns", F.array().cast("array<string>")))


def anchor_inline(hits: DataFrame, columns: DataFrame, min_len: int = 2, ignore_case: bool = False, text: str = "sentence") -> DataFrame:
    """``anchor`` without a shuffle of the hits, for streams: the names of a dataset
    travel as one array, as long as a table is wide, and are tested in the row."""
    per = columns.where(F.length("col") >= min_len).groupBy("ds").agg(F.collect_set("col").alias("_names"))
    low = (lambda c: F.lower(c)) if ignore_case else (lambda c: c)
    words = tokens(low(F.col(text)))
    j = join_dim(hits, per, ["ds"], "left")
    hit = F.filter(
        F.coalesce("_names", F.array().cast("array<string>")),
        lambda n: F.when(n.rlike(PLAIN), F.array_contains(words, low(n))).otherwise(F.rlike(F.col(text), whole_token(n, ignore_case))),
    )
    order = F.array_sort(F.transform(hit, lambda n: F.struct((-F.length(n)).alias("l"), n.alias("c"))))
    return j.withColumn("columns", F.transform(order, lambda x: x["c"])).drop("_names")


def self_anchor(hits: DataFrame) -> DataFrame:
    """A field variables[x] is about column x even when its text does not repeat the name."""
    own = F.regexp_extract("field", r"^variables\[(.+)\]$", 1)
    return hits.withColumn("columns", F.when(own != "", F.array_union(F.array(own), "columns")).otherwise(F.col("columns")))


# ------------------------------------------------------------ heading blocks


def is_heading(line: Column) -> Column:
    """Structure only: a short line with a word that is no numbered or statistics row."""
    s = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
    return (
        (s != "")
        & (F.length(s) <= 130)
        & ~s.rlike(V.NUMBERED_ROW)
        & ~s.rlike(V.STATISTICS_ROW)
        & ~line.contains("\t")
        & s.rlike("[A-Za-z]{4}")
    )


def heading_blocks(docs: DataFrame, outcome: str | None = V.FLAGS + V.OUTCOME_HEADING, text: str = "text") -> DataFrame:
    """(.., heading, n_lines, body) of every block; a block ends at any next heading.
    With ``outcome`` only blocks under an outcome heading are kept. The blocks are
    cut out of the row itself, nothing is shuffled."""
    rest = [c for c in docs.columns if c != text]
    d = docs.withColumn("_lines", F.split(text, r"\r?\n"))
    d = d.withColumn(
        "_at", F.filter(F.transform("_lines", lambda x, i: F.when(is_heading(x), i)), lambda i: i.isNotNull())
    )
    block = F.transform(
        "_at",
        lambda h, i: F.struct(
            F.trim(F.element_at("_lines", h + 1)).alias("heading"),
            F.slice("_lines", h + 2, F.coalesce(F.get("_at", i + 1), F.size("_lines")) - h - 1).alias("body"),
        ),
    )
    out = d.select(*rest, F.posexplode(block).alias("block", "b")).select(
        *rest, "block", "b.heading", F.size("b.body").alias("n_lines"), F.array_join("b.body", "\n").alias("body")
    )
    return out.where(F.col("heading").rlike(outcome)) if outcome else out


# --------------------------------------------------------------- dictionaries

MARKER_PATTERN = V.alternation(MARKERS)
DICTIONARY_WARN = V.alternation(V.DICTIONARY_WARN)


def dictionary_screen(rows: DataFrame, text: str = "description", marker: str = MARKER_PATTERN, warn: str = DICTIONARY_WARN) -> DataFrame:
    """Dictionary rows with post-outcome wording: the markers found and the tier it hints at."""
    found = F.array_sort(F.array_distinct(F.transform(matches(F.col(text), marker), lambda x: F.lower(x))))
    w = F.col(text).rlike(warn)
    out = rows.withColumns({"markers": found, "tier_hint": F.when(w, "E2").otherwise("E1")})
    return out.where((F.size("markers") > 0) | w)


def two_source_sieve(
    structured: DataFrame, prose: DataFrame, columns: DataFrame, marker: str = MARKER_PATTERN, warn: str = DICTIONARY_WARN
) -> DataFrame:
    """Candidates (ds, col, via, tier_hint, text): a column's own description wins,
    else the first prose fragment of at most 400 characters that names it and
    carries a marker. ``structured``: (ds, col, description); ``prose``: (ds, text)."""
    s = dictionary_screen(structured, "description", marker, warn).select(
        "ds", "col", F.lit("structured").alias("via"), "tier_hint", F.col("description").alias("text"), F.lit(0).alias("_p"), F.lit(0).alias("_f"), F.lit(0).cast("long").alias("_d")
    )
    frags = sentences(prose.withColumn("_d", F.xxhash64("ds", "text")) if "doc_id" not in prose.columns else prose.withColumn("_d", F.col("doc_id").cast("long")), 1, 400, split=r"(?<=[.;\n])\s+")
    carried = dictionary_screen(frags, "sentence", marker, warn)
    named = anchor(carried.select("ds", "_d", "pos", "sentence", "tier_hint"), columns, ["ds", "_d", "pos"], 3, True)
    p = named.select("ds", F.explode("columns").alias("col"), F.lit("prose").alias("via"), "tier_hint", F.col("sentence").alias("text"), F.lit(1).alias("_p"), F.col("pos").alias("_f"), "_d")
    top = F.min_by(F.struct("via", "tier_hint", "text"), F.struct("_p", "_d", "_f", "text"))
    return s.unionByName(p).groupBy("ds", "col").agg(top.alias("t")).select("ds", "col", "t.*")


def explicit_quotes(rows: DataFrame, text: str = "description", patterns: list[tuple[str, str]] | None = None, reach: int = 60) -> DataFrame:
    """The first pattern of the ordered list that matches: kind, matched text, and a
    quotation of ``reach`` characters to either side."""
    patterns = patterns or V.EXPLICIT
    d = squeeze(F.col(text))
    kind, hit = F.lit(None).cast("string"), F.lit(None).cast("string")
    for p, k in reversed(patterns):
        found = d.rlike(V.FLAGS + p)
        kind = F.when(found, k).otherwise(kind)
        hit = F.when(found, F.regexp_extract(d, V.FLAGS + p, 0)).otherwise(hit)
    out = rows.withColumns({"kind": kind, "matched": hit}).where("kind IS NOT NULL")
    at = F.instr(d, F.col("matched"))
    start = F.greatest(at - reach, F.lit(1))
    return out.withColumn("quote", F.trim(F.substr(d, start, at + F.length("matched") + reach - start)))


def closed_world(
    rows: DataFrame, post: str = V.alternation(V.CLOSED_POST), derived: str = V.alternation(V.CLOSED_DERIVED), text: str = "description"
) -> DataFrame:
    """TARGET for the stated target, LEAKY when a phrase licenses it, else CLEAN. A
    phrase behind 'at (the)' names a reference point and is passed over."""
    d = F.trim(F.coalesce(text, F.lit("")))

    def licensed(pattern):
        both = F.struct(d.alias("d"), occurrences(d, pattern).alias("m"))
        ok = bind(
            both,
            lambda b: F.filter(
                b["m"],
                lambda m: ~F.lower(F.substr(b["d"], F.greatest(m["at"] - 7, F.lit(1)), F.least(m["at"], F.lit(8)))).rlike(r"\bat (?:the )?$"),
            ),
        )
        return F.lower(F.get(ok, F.lit(0))["hit"])

    phrase = F.coalesce(licensed(post), licensed(derived))
    out = rows.withColumn("phrase", F.when(~F.col("is_target"), phrase))
    return out.withColumn("verdict", F.when(F.col("is_target"), "TARGET").when(F.col("phrase").isNotNull(), "LEAKY").otherwise("CLEAN"))


def complete_dictionaries(rows: DataFrame, text: str = "description") -> DataFrame:
    """Datasets all of whose columns have a description: only there is silence informative."""
    full = F.bool_and(F.trim(F.coalesce(text, F.lit(""))) != "")
    return rows.groupBy("ds").agg(full.alias("complete"), F.count(F.lit(1)).alias("n_cols"))


def closed_world_report(labelled: DataFrame, truth: DataFrame) -> DataFrame:
    """Over complete dictionaries: columns, LEAKY and TARGET apart, the rate, and the
    recall on known positives in scope."""
    scope = complete_dictionaries(labelled).where("complete").select("ds")
    inside = labelled.join(scope, "ds", "left_semi")
    flagged = inside.agg(
        F.count_distinct("ds").alias("n_ds"),
        F.count(F.lit(1)).alias("n_cols"),
        count_if(F.col("verdict") == "LEAKY").alias("n_leaky"),
        count_if(F.col("verdict") == "TARGET").alias("n_target"),
    )
    pos = truth.where("is_pos").select("ds", "col").join(scope, "ds", "left_semi").join(inside.select("ds", "col", "verdict"), ["ds", "col"], "left")
    recall = pos.agg(F.count(F.lit(1)).alias("n_pos"), count_if(F.coalesce(F.col("verdict"), F.lit("CLEAN")) == "LEAKY").alias("n_hit"))
    return flagged.withColumns({"n_pos": recall.select("n_pos").scalar(), "n_hit": recall.select("n_hit").scalar()}).withColumns(
        {"flag_rate": ratio(F.col("n_leaky"), F.col("n_cols")), "recall": ratio(F.col("n_hit"), F.col("n_pos"))}
    )


def documentation_coverage(columns: DataFrame, prose: DataFrame) -> DataFrame:
    """Per dataset: share of columns described, share whose name occurs in the prose.
    ``columns``: (ds, col, description); ``prose``: (ds, text)."""
    words = prose.select("ds", F.explode(tokens(F.lower("text"))).alias("tok")).distinct()
    named = columns.where((F.length("col") >= 3) & F.col("col").rlike(PLAIN)).select("ds", "col", F.lower("col").alias("tok"))
    hit = named.join(words, ["ds", "tok"], "left_semi").select("ds", "col", F.lit(True).alias("in_prose"))
    j = columns.join(hit, ["ds", "col"], "left")
    return j.groupBy("ds").agg(
        F.count(F.lit(1)).alias("n_cols"),
        F.avg((F.trim(F.coalesce("description", F.lit(""))) != "").cast("double")).alias("described"),
        F.avg(F.coalesce("in_prose", F.lit(False)).cast("double")).alias("in_prose"),
    )


# -------------------------------------------------------------- page texts


def statements(pages: DataFrame, lo: int = 25, hi: int = 600, action: str = V.ACTION, reason: str = V.REASON,
               timing: str = V.STATEMENT_TIMING, identifier: str = V.IDENTIFIER, named: str = V.NAMED_COLUMN, column_like: str = V.COLUMN_LIKE) -> DataFrame:
    """What a sentence of a paper can license: TIMING_CLAIM, EXCLUSION, IDENTIFIER,
    TIMING_NO_COLUMN or GENERIC. An action alone needs a column-like token beside it."""
    text = F.regexp_replace(F.regexp_replace("text", "-\n", ""), r"\s+", " ")
    s = sentences(pages.withColumn("text", text), lo, hi, split=r"(?<=[.;:])\s+(?=[A-Z(])")
    q = F.col("sentence")
    s = s.withColumns(
        {
            "action": F.lower(first_match(q, V.FLAGS + action)),
            "reason": F.lower(first_match(q, V.FLAGS + reason)),
            "column_like": F.array_sort(F.array_distinct(matches(q, column_like))),
        }
    ).where(F.col("reason").isNotNull() | (F.col("action").isNotNull() & (F.size("column_like") > 0)))
    late, ident = q.rlike(V.FLAGS + timing), q.rlike(V.FLAGS + identifier)
    has_name = (F.size("column_like") > 0) | q.rlike(V.FLAGS + named)
    return s.withColumn(
        "kind",
        F.when(ident & ~late, "IDENTIFIER")
        .when(late & has_name, "TIMING_CLAIM")
        .when(F.col("action").isNotNull() & has_name, "EXCLUSION")
        .when(late, "TIMING_NO_COLUMN")
        .otherwise("GENERIC"),
    )


def dictionary_rows(pages: DataFrame, row: str = V.DICTIONARY_ROW, marker: str = MARKER_PATTERN, extra: str = V.FLAGS + V.ROW_EXTRA) -> DataFrame:
    """(ds, source, col, description, marker, is_target_row): name/description rows
    found in page text whose description carries a marker, one per (ds, source, col)."""
    t = F.regexp_replace(F.regexp_replace("text", "-\n", ""), r"\s+", " ")
    # the pattern is slow, so it is run once: a row becomes a line of name, tab and description (the
    # squeezed text has neither), and the outer explode lets Spark infer no filter that would run it again
    rows = F.filter(F.split(F.regexp_replace(t, row, "\n$1\t$2\n"), "\n"), lambda x: F.contains(x, F.lit("\t")))
    each = pages.select("ds", "source", "page", F.explode_outer(rows).alias("r")).where("r IS NOT NULL")
    r = each.select("ds", "source", "page", F.split("r", "\t")[0].alias("col"), F.trim(F.split("r", "\t")[1]).alias("description"))
    r = r.where((F.length("col") >= 2) & ~F.lower("col").isin(V.ROW_STOP_NAMES))
    r = r.withColumn("marker", F.lower(F.coalesce(first_match(F.col("description"), marker), first_match(F.col("description"), extra)))).where("marker IS NOT NULL")
    r = r.withColumn("is_target_row", F.col("description").rlike(V.FLAGS + V.ROW_TARGET))
    top = F.min_by(F.struct("col", "page", "description", "marker", "is_target_row"), F.struct("page", "col", "description"))
    return r.groupBy("ds", "source", F.lower("col").alias("_k")).agg(top.alias("t")).select("ds", "source", "t.*")


def anchored_windows(
    pages: DataFrame, columns: DataFrame, before: int = 170, after: int = 230,
    marker: str = MARKER_PATTERN, timing: str = V.FLAGS + V.ANCHOR_TIMING, reason: str = V.FLAGS + V.ANCHOR_REASON, dictish: str = V.FLAGS + V.DICTIONARY_LIKE,
) -> DataFrame:
    """The text around a column's name where it carries a marker, the most
    dictionary-like window per (ds, source, col).

    Names of fewer than 5 characters must match exactly and sit in dictionary-like
    text; longer ones also match with blank, hyphen or nothing for an underscore.
    Pages and columns meet on shared tokens before any window is cut.
    """
    t = F.regexp_replace(F.regexp_replace("text", "-\n", ""), r"\s+", " ")
    p = pages.withColumn("_t", t)
    low = F.lower("col")
    starts = F.array_distinct(F.array(low, F.regexp_replace(low, "_", ""), F.get(F.split(low, "[^a-z0-9]+"), F.lit(0))))
    names = columns.select("ds", "col", F.explode(starts).alias("tok")).where("tok <> ''").distinct()
    words = p.select("ds", "source", "page", F.explode(tokens(F.lower("_t"), "a-z0-9")).alias("tok")).unionByName(
        p.select("ds", "source", "page", F.explode(tokens(F.lower("_t"), "a-z0-9_")).alias("tok"))
    )
    near = join_dim(words, names, ["ds", "tok"]).select("ds", "source", "page", "col").distinct()
    j = near.join(p, ["ds", "source", "page"])
    short = F.length("col") < 5
    form = F.when(short, escaped(F.col("col"))).otherwise(F.regexp_replace(escaped(F.col("col")), "_", r"[ _\\-]?"))
    pattern = F.concat(F.lit(r"(?i)(?<![A-Za-z0-9\-])(?:"), form, F.lit(r")(?![A-Za-z0-9\-])"))

    def window(m):
        start = F.greatest(m["at"] - before, F.lit(0))
        return F.substr(F.col("_t"), start + 1, m["at"] + after - start)

    cut = j.withColumn("_w", F.transform(occurrences(F.col("_t"), pattern), window))
    ok = F.filter(
        "_w", lambda w: (w.rlike(marker) | w.rlike(timing) | w.rlike(reason)) & (~short | w.rlike(dictish))
    )
    hit = cut.select("ds", "source", "page", "col", F.trim(F.get(ok, F.lit(0))).alias("quote")).where("quote IS NOT NULL")
    hit = hit.withColumn("dictish", F.col("quote").rlike(dictish))
    top = F.min_by(F.struct("page", "quote", "dictish"), F.struct(~F.col("dictish"), F.col("page")))
    return hit.groupBy("ds", "source", "col").agg(top.alias("t")).select("ds", "source", "col", "t.*")


def corroborated(hits: DataFrame, at_least: int = 2) -> DataFrame:
    """Columns named by several sources."""
    return hits.groupBy("ds", "col").agg(F.count_distinct("source").alias("n_sources")).where(F.col("n_sources") >= at_least)


def adjudicate_licence(
    cands: DataFrame, temporal: str = V.FLAGS + V.TEMPORAL_LICENCE, reason: str = V.FLAGS + V.REASON_LICENCE, prose: str = V.FLAGS + V.PROSE_LICENCE
) -> DataFrame:
    """Admit or reject a candidate (col, quote, dictish, is_target) with the reason.

    A temporal licence must lie in the column's own description, the span from its
    name to the next row; a reason licence in the sentence that names it.
    """
    name = F.concat(F.lit(r"(?i)(?<![A-Za-z0-9])"), F.regexp_replace(escaped(F.col("col")), "_", r"[ _\\-]?"), F.lit(r"(?![A-Za-z0-9])"))
    c = cands.withColumn("_first", F.get(occurrences(F.col("quote"), name), F.lit(0)))
    tail = F.substr(F.col("quote"), F.col("_first.at") + F.length("_first.hit") + 1, F.lit(200))
    c = c.withColumn("_desc", F.coalesce(F.get(F.split(tail, V.NEXT_NAME, 2), F.lit(0)), F.lit("")))
    c = c.withColumn("_sent", F.coalesce(F.get(F.filter(F.split("quote", r"(?<=[.;])\s+"), lambda s: F.rlike(s, name)), F.lit(0)), F.lit("")))
    mid = ~F.col("_desc").rlike(r"^[\s\-–—:()]*[A-Z0-9(]")
    dash = F.col("_desc").rlike(r"^\s*[-–—]\s+[A-Za-z]")
    c = c.withColumns({"_t": first_match(F.col("_desc"), temporal), "_r": first_match(F.col("_sent"), reason)})
    lic = F.coalesce("_t", "_r")
    reject = (
        F.when(F.col("is_target"), "IS_TARGET")
        .when(lic.isNotNull() & F.col("_r").isNull() & (mid | ~(F.col("dictish") | dash)) & ~F.col("_desc").rlike(prose), "prose context without an unambiguous availability phrase")
        .when(lic.isNull() & F.col("quote").rlike(temporal), "no licensing phrase in the column's own description")
        .when(lic.isNull(), "no licensing phrase")
    )

    def words(t, n):
        return F.array_join(F.slice(F.split(squeeze(t), " "), 1, n), " ")

    return c.withColumns(
        {
            "reject": reject,
            "licence_kind": F.when(reject.isNull(), F.when(F.col("_r").isNotNull(), "REASON").otherwise("TEMPORAL")),
            "licensing_phrase": F.when(reject.isNull(), F.lower(lic)),
            "licensed_quote": F.when(reject.isNull(), F.when(F.col("_r").isNotNull(), words(F.col("_sent"), 30)).otherwise(words(F.col("_desc"), 25))),
        }
    ).drop("_first", "_desc", "_sent", "_t", "_r")


# ------------------------------------------------------- synthetic and mirrors


def synthetic(docs: DataFrame, pattern: str = V.FLAGS + V.SYNTHETIC, configs: str | None = None) -> DataFrame:
    """Adds ``synthetic`` (the phrase) and ``synthetic_scope``: whole, or scoped when a
    sibling configuration is the generated one and the match may belong to it."""
    phrase = first_match(F.col("text"), pattern)
    out = docs.withColumn("synthetic", phrase)
    sibling = F.lit(False)
    if configs:
        sibling = F.exists(configs, lambda c: c.rlike("(?i)synth")) & (F.size(F.array_distinct(configs)) > 1)
    return out.withColumn("synthetic_scope", F.when(F.col("synthetic").isNotNull(), F.when(sibling, "scoped").otherwise("whole")))


def mirrors(docs: DataFrame, fingerprints: DataFrame, credits: DataFrame, share: float = 0.25, least: int = 4, short_least: int = 6) -> DataFrame:
    """(doc_id, mirror, rule, n_long, n_short): documents that look like a re-upload of
    a known dataset, by the first rule that fires and the first dataset in ``rank``.

    ``docs`` (doc_id, title, text); ``fingerprints`` (name, rank, word, kind) with kind
    long, short or target; ``credits`` (name, rank, phrase). Each text is split into
    tokens once and the words meet it by equi-join.
    """
    hay = F.lower(F.concat_ws(" ", "title", "text"))
    d = docs.select("doc_id", hay.alias("_hay"))
    words = d.select("doc_id", F.explode(tokens(F.col("_hay"), "a-z0-9_")).alias("word"))
    plain = F.col("word").rlike(r"^[a-z0-9_]+$")
    fp = fingerprints.select("name", "rank", F.lower("word").alias("word"), "kind").distinct()
    cr = credits.select("name", "rank", F.lower("phrase").alias("word"), F.lit("credit").alias("kind")).distinct()
    every = fp.unionByName(cr.where(plain)).withColumn("tok", longest_token(F.col("word")))
    words = words.withColumnRenamed("word", "tok")
    hit = join_dim(words, every.where(plain), ["tok"]).select("doc_id", "name", "rank", "kind")
    other = every.where(~plain)
    if not other.isEmpty():
        # a name of several tokens meets on its longest and is verified in the text
        near = join_dim(words, other, ["tok"]).join(d, "doc_id")
        whole = F.concat(F.lit("(?<![a-z0-9_])"), escaped(F.col("word")), F.lit("(?![a-z0-9_])"))
        hit = hit.unionByName(near.where(F.rlike(F.col("_hay"), whole)).select("doc_id", "name", "rank", "kind"))
    # credited phrases are substrings, so they are looked for in the text itself: a
    # hand-written list, a few per known dataset
    phrases = cr.where(~plain).agg(F.collect_set(F.struct("name", "rank", "word"))).scalar()
    credited = d.withColumn("_phrases", phrases).select(
        "doc_id", F.explode(F.filter("_phrases", lambda w: F.contains(F.col("_hay"), w["word"]))).alias("w")
    ).select("doc_id", "w.name", "w.rank", F.lit("credit").alias("kind"))
    sizes = fp.where("kind = 'long'").groupBy("name").agg(F.count(F.lit(1)).alias("size"))
    per = hit.unionByName(credited).groupBy("doc_id", "name", "rank").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("long", "short", "target", "credit")]
    )
    per = join_dim(per, sizes, ["name"], "left")
    enough = F.greatest(F.lit(least), F.floor(F.lit(share) * F.col("size")))
    rule = (
        F.when(F.col("n_credit") > 0, "source name")
        .when(F.col("n_long") >= enough, "column overlap")
        .when(F.col("n_short") >= short_least, "short names")
        .when((F.col("n_target") > 0) & (F.col("n_long") + F.col("n_short") >= 2), "target and two names")
    )
    fired = per.withColumn("rule", rule).where("rule IS NOT NULL")
    top = F.min_by(F.struct(F.col("name").alias("mirror"), "rule", "n_long", "n_short"), F.struct("rank", "name"))
    return fired.groupBy("doc_id").agg(top.alias("t")).select("doc_id", "t.*")


def schema_mirrors(schemas: DataFrame, fingerprints: DataFrame, share: float = 0.6, least: int = 4) -> DataFrame:
    """(did, mirror, shared): schemas that share at least max(4, 60%) of a known
    dataset's columns of four characters or more."""
    fp = fingerprints.where(F.length("word") >= 4).select("name", F.lower("word").alias("col")).distinct()
    s = schemas.where(F.length("col") >= 4).select("did", F.lower("col").alias("col")).distinct()
    sizes = fp.groupBy("name").agg(F.count(F.lit(1)).alias("size"))
    shared = join_dim(s, fp, ["col"]).groupBy("did", "name").agg(F.count(F.lit(1)).alias("shared"))
    ok = join_dim(shared, sizes, ["name"]).where(F.col("shared") >= F.greatest(F.lit(least), F.floor(F.lit(share) * F.col("size"))))
    return ok.groupBy("did").agg(F.min_by(F.struct(F.col("name").alias("mirror"), "shared"), F.col("name")).alias("t")).select("did", "t.*")


# ------------------------------------------------------------------ reports


def funnel(flags: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """(step, stage, n): each stage counts what passed all stages before it too."""
    so_far, aggs = F.lit(True), []
    for i, c in enumerate(stages.values()):
        so_far = so_far & F.coalesce(c, F.lit(False))
        aggs.append(count_if(so_far).alias(f"s{i}"))
    each = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("stage"), F.col(f"s{i}").alias("n")) for i, n in enumerate(stages)])
    return flags.agg(*aggs).select(F.explode(each).alias("e")).select("e.*")


def require_populated(df: DataFrame, field: str) -> None:
    """Refuse to report a yield over a field that nobody filled."""
    if df.where(F.trim(F.coalesce(F.col(field).cast("string"), F.lit(""))) != "").limit(1).count() == 0:
        raise RuntimeError(f"'{field}' is empty everywhere: refusing to report a yield from it")


def gate_comparison(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Two gates over one corpus side by side: what each and both let through."""
    x = a.select(*key).distinct().withColumn("in_a", F.lit(True))
    y = b.select(*key).distinct().withColumn("in_b", F.lit(True))
    j = x.join(y, key, "full").select(*key, F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"))
    return j.groupBy("in_a", "in_b").agg(F.count(F.lit(1)).alias("n_hits"), F.count_distinct(key[0]).alias("n_docs"))


def scarcity(passes: list[DataFrame], verdicts: DataFrame, swept: DataFrame) -> DataFrame:
    """Datasets hit by any pass (a union, not a sum) per population with the tally of
    their hand verdicts and the leak rate. Keys: (population, ds)."""
    hit = passes[0].select("population", "ds")
    for p in passes[1:]:
        hit = hit.unionByName(p.select("population", "ds"))
    hit = hit.distinct().join(verdicts, ["population", "ds"], "left")
    per = hit.groupBy("population").agg(
        F.count(F.lit(1)).alias("hit"), *[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("TARGET_LEAK", "GROUP", "CONTAMINATION", "IDENTIFIER", "OUT")]
    )
    n = swept.groupBy("population").agg(F.count_distinct("ds").alias("swept"))
    out = n.join(per, "population", "left").fillna(0)
    return out.withColumn("rate", ratio(F.col("target_leak"), F.col("swept")))


def verify_quotes(records: DataFrame, sources: DataFrame, header: DataFrame, key: list[str]) -> DataFrame:
    """(.., problem) for quotes that are not in their source and columns that are not
    in the file. ``sources``: (key.., text); ``header``: (ds, col)."""
    def norm(c):
        return F.lower(squeeze(F.replace(F.col(c), F.lit("’"), F.lit("'"))))

    j = records.join(sources.select(*key, "text"), key, "left")
    bad_quote = j.where(~F.coalesce(F.contains(norm("text"), norm("quote")), F.lit(False))).select("ds", "col", *key, F.lit("quote not in source").alias("problem"))
    bad_col = records.join(header.select("ds", "col"), ["ds", "col"], "left_anti").select("ds", "col", *key, F.lit("column not in header").alias("problem"))
    return bad_quote.unionByName(bad_col)


def build_frame(registry: DataFrame, keep: Column, usage: str, n: int, key: str = "did") -> DataFrame:
    """The n most used datasets that pass ``keep``, one per name, ranked."""
    rest = [c for c in registry.columns if c != "name"]
    top = F.max_by(F.struct(*rest), F.struct(F.col(usage), -F.col(key)))
    one = registry.where(keep).groupBy("name").agg(top.alias("t")).select("name", "t.*")
    first = one.orderBy(F.desc(usage), key).limit(n)
    from pyspark.sql import Window

    # the window sees the n rows of the report only
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(usage), key)))


def review_funnel(docs: DataFrame, short: int = 200, marker: str = MARKER_PATTERN, warn: str = DICTIONARY_WARN) -> DataFrame:
    """Considered, without columns, without description, with candidates. ``docs``:
    (ds, text, columns array)."""
    frags = F.filter(F.transform(F.split("text", r"(?<=[.;\n])\s+"), squeeze), lambda s: F.length(s).between(1, 400))
    in_text = F.exists(frags, lambda s: s.rlike(marker) | s.rlike(warn))
    in_name = F.exists("columns", lambda c: F.regexp_replace(c, "_", " ").rlike(marker))
    row = docs.agg(
        F.count(F.lit(1)).alias("considered"),
        count_if(F.size("columns") == 0).alias("no_columns"),
        count_if(F.length(F.coalesce("text", F.lit(""))) < short).alias("no_description"),
        count_if(F.coalesce(in_text, F.lit(False)) | F.coalesce(in_name, F.lit(False))).alias("with_candidates"),
    )
    names = ["considered", "no_columns", "no_description", "with_candidates"]
    return row.select(F.stack(F.lit(len(names)), *[x for n in names for x in (F.lit(n), F.col(n))]).alias("what", "n"))


def text_profile(docs: DataFrame, by: list[str], text: str = "text", substantive: int = 200) -> DataFrame:
    """Median length, share with substantive prose, share not empty, per population.
    Lengths are whole numbers, so the exact median comes from their counts."""
    from colprov.functions.ranks import exact_median

    n = F.length(F.coalesce(text, F.lit("")))
    d = docs.select(*by, n.alias("_len"))
    stats = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("_len") > substantive).cast("double")).alias("substantive"), F.avg((F.col("_len") > 0).cast("double")).alias("non_empty")
    )
    med = exact_median(d, by, "_len", name="median_length")
    return stats.join(med, by)


def candidate_list(hits: DataFrame, key: str, n: int, prefix: int = 60) -> DataFrame:
    """Datasets by number of hits, and their sentences told apart by the first 60 characters."""
    per = hits.groupBy(key).agg(F.count(F.lit(1)).alias("n_hits"), F.count_distinct(F.expr(f"left(sentence, {prefix})")).alias("n_sentences"), F.min("sentence").alias("example"))
    return per.orderBy(F.desc("n_hits"), key).limit(n)


def exposure(swept: DataFrame, expected: DataFrame, got: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Swept, with a readable schema, anchored; and the expected pages that never came."""
    counts = swept.agg(
        F.count(F.lit(1)).alias("swept"), count_if(F.col("has_schema")).alias("has_schema"), count_if(F.col("has_schema") & F.col("anchored")).alias("anchored"), count_if(~F.col("has_schema")).alias("unreadable")
    )
    return counts, expected.join(got, expected.columns, "left_anti")
