"""Check a corpus of written reports against the metrics they quote.

A report is one row ``(report_id, text)``; a window over its lines is therefore
never larger than a row that a task already held. A checker that finds nothing to
look at must say so: missing patterns, unmapped rows and missing reports are
failures, never passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colprov.functions import vocab as V
from colprov.functions.joins import join_dim
from colprov.functions.text import squeeze
from colprov.session import cut


def lines(reports: DataFrame, text: str = "text") -> DataFrame:
    """(report_id, line_no from 1, line)"""
    return reports.select("report_id", F.posexplode(F.split(text, r"\r?\n")).alias("i", "line")).select(
        "report_id", (F.col("i") + 1).alias("line_no"), "line"
    )


def prose_sentences(reports: DataFrame, lo: int = 25) -> DataFrame:
    """(report_id, line_no, sentence) of prose only: no fences, tables, headings or
    quotations. Lines run on until one ends a sentence; repeats (same first 80
    characters) keep their first place."""
    w = Window.partitionBy("report_id").orderBy("line_no")
    t = F.trim("line")
    l = lines(reports).withColumn("t", t).withColumn("fence", F.col("t").startswith("```"))
    l = l.withColumn("open", F.sum(F.col("fence").cast("int")).over(w) % 2 == 1)
    skip = F.col("fence") | F.col("open") | (F.col("t") == "") | F.col("t").rlike(r"^(\||#|>|\*\[)")
    l = l.withColumn("skip", skip)
    ends = F.lag(F.col("skip") | F.col("t").rlike(r"[.!?]$"), 1, True).over(w)
    l = l.withColumn("para", F.sum((ends | F.col("skip")).cast("int")).over(w)).where("NOT skip")
    p = l.groupBy("report_id", "para").agg(
        F.min("line_no").alias("line_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "t"))), lambda x: x["t"]), " ").alias("p")
    )
    s = p.select("report_id", "line_no", F.posexplode(F.split("p", r"(?<=[.!?])\s+")).alias("k", "sentence")).where(
        (F.length("sentence") > lo) & F.col("sentence").rlike(r"[.!?]$")
    )
    top = F.min_by(F.struct("line_no", "sentence"), F.struct("line_no", "k"))
    return s.groupBy("report_id", F.expr("left(sentence, 80)").alias("_k")).agg(top.alias("t")).select("report_id", "t.*")


def tagged_claims(sents: DataFrame, priority: str = V.FLAGS + V.PRIORITY_CLAIM, universal: str = V.FLAGS + V.UNIVERSAL_CLAIM, causal: str = V.FLAGS + V.CAUSAL_CLAIM) -> DataFrame:
    """Sentences that claim priority, universality or a cause."""
    s = F.col("sentence")
    tags = F.filter(
        F.array(F.when(s.rlike(priority), "PRIORITY"), F.when(s.rlike(universal), "UNIVERSAL"), F.when(s.rlike(causal), "CAUSAL")), lambda x: x.isNotNull()
    )
    return sents.withColumn("tags", F.array_join(tags, ",")).where("tags <> ''")


DECIMAL = r"(?<![\w.])(\d+\.\d{2,3})(?![\w])"
DERIVED_TOLERANCE = 0.0015


#: Parts of a report's sources at most; claims of a report meet each part in a task of its own.
PARTS = 64
#: Sources up to which a report has one part.
PART_ROWS = 64


def derived_claims(claims: DataFrame, sources: DataFrame, tolerance: float = DERIVED_TOLERANCE, parts: int = PARTS) -> DataFrame:
    """The claims (report_id, x) that are a difference of two different sources (report_id, s).

    Every claim is added to every source of its report, and the sums meet the sources in
    buckets of the width of the tolerance and their two neighbours, so the numbers of a
    report are rows, never one list. A claim needs a single pair: one part of the
    sources goes first, and only claims without a pair there meet the others. A report with
    few sources has one part, so its claims are not multiplied.
    """
    report, bucket = "report_id", lambda v: F.floor(v / tolerance)
    have = sources.select(report, "s").distinct()
    parted = have.groupBy(report).agg(F.least(F.lit(parts), F.ceil(F.count(F.lit(1)) / PART_ROWS)).cast("int").alias("k"))
    near = have.select(report, F.col("s").alias("partner"), F.explode(F.array(*[bucket(F.col("s")) + d for d in (-1, 0, 1)])).alias("b"))
    have = have.join(parted, report).select(report, "s", F.pmod(F.xxhash64("s"), F.col("k")).cast("int").alias("part"))

    def found(left: DataFrame) -> DataFrame:
        shifts = left.join(have, [report, "part"]).withColumn("b", bucket(F.col("s") + F.col("x")))
        fits = (F.col("partner") > F.col("s")) & (F.abs(F.col("partner") - F.col("s") - F.col("x")) < tolerance)
        return shifts.join(near, [report, "b"]).where(fits).select(report, "x").distinct()

    claims = claims.select(report, "x").distinct()
    first = cut(found(claims.withColumn("part", F.lit(0))))
    rest = claims.join(first, [report, "x"], "left_anti").join(parted.where("k > 1"), report)
    return first.unionByName(found(rest.withColumn("part", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))))


def number_provenance(sents: DataFrame, sources: DataFrame) -> DataFrame:
    """(report_id, value, status): each decimal DIRECT (as written in the sources),
    DERIVED (a difference of two sources within .0015) or UNSOURCED.
    ``sources``: (report_id, value as text); texts that are no number only count as written."""
    said = sents.select("report_id", F.explode(F.regexp_extract_all("sentence", F.lit(DECIMAL), F.lit(1))).alias("value")).distinct()
    known = cut(sources.select("report_id", "value").distinct())
    told = cut(said.join(known.withColumn("direct", F.lit(True)), ["report_id", "value"], "left").withColumn("x", F.col("value").cast("double")))
    have = known.select("report_id", F.col("value").try_cast("double").alias("s")).where("s IS NOT NULL")
    derived = derived_claims(told.where("direct IS NULL"), have).withColumn("derived", F.lit(True))
    status = F.when(F.col("direct"), "DIRECT").when(F.col("derived"), "DERIVED").otherwise("UNSOURCED")
    return told.join(derived, ["report_id", "x"], "left").select("report_id", "value", status.alias("status"))


# ------------------------------------------------------------- arithmetic

NUM = r"(\d\.\d{2,4})"
SIGNED = r"([+-]?\d\.\d{2,4})"


def normalised(c: Column) -> Column:
    """Typographic minus and dash, bold marks and hard blanks as plain text."""
    out = F.replace(F.replace(c, F.lit("−"), F.lit("-")), F.lit("–"), F.lit("-"))
    return F.replace(F.replace(out, F.lit("**"), F.lit("")), F.lit(" "), F.lit(" "))


def unit(*quoted: Column) -> Column:
    """One unit in the last place of the most precise quoted value."""
    places = [F.length(F.regexp_extract(q, r"\.(\d+)", 1)) for q in quoted]
    most = F.greatest(*places) if len(places) > 1 else places[0]
    return F.pow(F.lit(10.0), -most) * 1.01


def arithmetic(report_lines: DataFrame) -> DataFrame:
    """(report_id, line_no, relation, lhs, rhs, ok): every stated relation of a line
    whose numbers must agree to one unit in the last place."""
    l = report_lines.withColumn("t", normalised(F.col("line")))
    t = F.col("t")

    def groups(pattern, n):
        parts = [F.regexp_extract_all(t, F.lit(pattern), F.lit(i + 1)).alias(f"g{i}") for i in range(n)]
        return l.select("report_id", "line_no", "t", F.explode(F.arrays_zip(*parts)).alias("m")).select("report_id", "line_no", "t", "m.*")

    def out(df, name, lhs, rhs, tol):
        return df.select("report_id", "line_no", F.lit(name).alias("relation"), lhs.alias("lhs"), rhs.alias("rhs"), (F.abs(lhs - rhs) <= tol).alias("ok"))

    d = lambda c: F.col(c).cast("double")
    arrow = groups(rf"(?<![\d.]){NUM}\s*(?:→|->|to)\s*{NUM}", 2)
    delta_pat = rf"(?:(?:Δ|d)F1\s*(?:=|of|is)?\s*|\bdrop of\s*|\bdecrement[^.]{{0,24}}?|\bgain is\s*|\bloses\s*){SIGNED}"
    a = arrow.withColumn("dl", F.regexp_extract("t", delta_pat, 1)).where("dl <> ''")
    diff = d("g1") - d("g0")
    parts = [out(a, "arrow-delta", d("dl"), F.when(F.col("dl").rlike("^[+-]"), diff).otherwise(F.abs(diff)), unit(F.col("g0"), F.col("g1"), F.col("dl")))]
    k = groups(rf"(?i)keep-all[^\d]{{0,12}}{NUM}[^\d]{{0,24}}oracle[^\d]{{0,12}}{NUM}[^\d]{{0,28}}?([+-]\d\.\d{{2,4}})", 3)
    parts.append(out(k, "keep-minus-oracle", d("g2"), d("g0") - d("g1"), unit(F.col("g0"), F.col("g1"), F.col("g2"))))
    r = groups(rf"\|\s*{NUM}\s*\|\s*{NUM}\s*\|\s*([+-]\d\.\d{{2,4}})\s*\|", 3)
    fwd = d("g0") - d("g1")
    best = F.when(F.abs(d("g2") - fwd) <= F.abs(d("g2") + fwd), fwd).otherwise(-fwd)
    parts.append(out(r, "row-delta", d("g2"), best, unit(F.col("g0"), F.col("g1"), F.col("g2"))))
    q = groups(r"(\d[\d,]*)\s*(?:in|of|/)\s*([\d,]{2,})[^.()%]{0,28}?[—\-–=:(]?\s*(\d+\.\d+)\s*%", 3)
    n0, n1 = (F.replace(F.col(c), F.lit(","), F.lit("")).try_cast("double") for c in ("g0", "g1"))
    q = q.where(n1 > 0)
    parts.append(out(q, "rate", d("g2"), 100.0 * n0 / n1, unit(F.col("g2"))))
    f = groups(r"(?<![\d/])(\d{1,3})\s*/\s*(\d{1,3})\s*=?\s*(\d{1,3})\s*%", 3).where("cast(g1 as int) > 0 AND cast(g0 as int) <= cast(g1 as int)")
    parts.append(out(f, "fraction", d("g2"), 100.0 * d("g0") / d("g1"), F.lit(1.01)))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


# ----------------------------------------------------------------- tables


def table_rows(reports: DataFrame) -> DataFrame:
    """(report_id, line_no, label, cond, values): markdown rows with a condition and
    at least three numbers; an empty first cell repeats the last label above it."""
    l = lines(reports).where(F.trim("line").startswith("|"))
    inner = F.regexp_replace(F.trim("line"), r"^\|+|\|+$", "")
    cells = F.transform(F.split(inner, r"\|"), lambda c: F.trim(F.regexp_replace(c, r"[`*†]", "")))
    l = l.withColumn("c", cells).where(F.size("c") >= 4)
    w = Window.partitionBy("report_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    l = l.withColumn("label", F.last(F.when(F.col("c")[0] != "", F.col("c")[0]), ignorenulls=True).over(w))
    nums = F.filter(F.transform(F.slice("c", 3, F.size("c")), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    return l.withColumns({"cond": F.regexp_extract(F.col("c")[1], r"^C(\d)$", 1).try_cast("int"), "values": F.slice(nums, 1, 3)}).where(
        "cond IS NOT NULL AND label IS NOT NULL AND size(values) = 3"
    ).select("report_id", "line_no", "label", "cond", "values")


def reconcile(rows: DataFrame, aliases: DataFrame, source: DataFrame, tol: float = 0.0011) -> DataFrame:
    """Each table row against its source row: ok, MISMATCH, NO SOURCE or UNMAPPED.
    ``aliases``: (label, model); ``source``: (model, cond, p, r, f1), possibly several per key."""
    j = join_dim(rows, aliases, ["label"], "left")
    s = source.groupBy("model", "cond").agg(F.collect_set(F.array("p", "r", "f1")).alias("_s"))
    j = join_dim(j, s, ["model", "cond"], "left")
    match = F.exists("_s", lambda v: F.forall(F.arrays_zip(v.alias("a"), F.col("values").alias("b")), lambda z: F.abs(z["a"] - z["b"]) < tol))
    status = F.when(F.col("model").isNull(), "UNMAPPED").when(F.col("_s").isNull(), "NO SOURCE").when(match, "ok").otherwise("MISMATCH")
    return j.withColumn("status", status).drop("_s")


# ------------------------------------------------------------------- pins


def pinned_claims(reports: DataFrame, pins: DataFrame) -> DataFrame:
    """(report_id, pin, stated, want, status): the value a pattern captures against
    the recomputed one; a pattern that is no longer there is a failure.
    ``pins``: (report_id, pin, pattern, want as text)."""
    flat = reports.select("report_id", "text", squeeze(F.col("text")).alias("flat"))
    j = pins.join(flat, "report_id", "left")
    hit = lambda c: F.regexp_substr(F.col(c), F.col("pattern"))
    src = F.when(hit("text").isNotNull(), F.col("text")).otherwise(F.col("flat"))
    # the value is the capture, read from the one match
    stated = F.when(F.coalesce(hit("text"), hit("flat")).isNotNull(), F.get(F.regexp_extract_all(src, F.col("pattern"), F.lit(1)), F.lit(0)))
    return j.withColumn("stated", stated).withColumn(
        "status", F.when(F.col("stated").isNull(), "MISSING").when(F.col("stated") == F.col("want"), "ok").otherwise("FAIL")
    ).select("report_id", "pin", "stated", "want", "status")


AS_OF = "[as-of]"


def stale_values(reports: DataFrame, patterns: list[tuple[str, str]], marker: str = AS_OF) -> DataFrame:
    """(report_id, line_no, pattern, should): outdated figures, unless the line or a
    neighbour carries the as-of marker."""
    w = Window.partitionBy("report_id").orderBy("line_no")
    near = F.concat_ws(" ", F.lag("line").over(w), F.col("line"), F.lead("line").over(w))
    l = lines(reports).withColumn("near", near)
    found = F.filter(
        F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(p).alias("pattern"), F.lit(s).alias("should"))) for p, s in patterns]), lambda x: x.isNotNull()
    )
    return l.where(~F.contains("near", F.lit(marker))).select("report_id", "line_no", F.explode(found).alias("f")).select("report_id", "line_no", "f.*")


def missing_reports(expected: DataFrame, reports: DataFrame) -> DataFrame:
    return expected.select("report_id").join(reports.select("report_id"), "report_id", "left_anti")


def dangling_sections(reports: DataFrame, source: DataFrame) -> DataFrame:
    """(report_id, section): cited as [N §x] but not a numbered section of the
    report's source text. ``source``: (report_id, text)."""
    cited = reports.select("report_id", F.explode(F.regexp_extract_all("text", F.lit(r"\[N ((?:§\d+(?:, )?)+)\]"), F.lit(1))).alias("g")).select(
        "report_id", F.explode(F.regexp_extract_all("g", F.lit(r"(\d+)"), F.lit(1))).alias("section")
    ).distinct()
    have = source.select("report_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^(\d+)\. [A-Z]"), F.lit(1))).alias("section")).distinct()
    return cited.join(have, ["report_id", "section"], "left_anti")


def extract_metrics(reports: DataFrame, patterns: dict[str, str], expected: DataFrame | None = None) -> DataFrame:
    """(report_id, metric, value, status): the first capture of each named pattern as
    a number; a pattern without a match and a report that is not there are marked."""
    each = F.array(*[F.struct(F.lit(k).alias("metric"), F.regexp_extract("text", f"(?m){p}", 1).alias("s")) for k, p in patterns.items()])
    r = reports.select("report_id", "text") if expected is None else expected.select("report_id").join(reports.select("report_id", "text"), "report_id", "left")
    out = r.select("report_id", F.col("text").isNull().alias("gone"), F.explode(each).alias("e"))
    value = F.replace(F.col("e.s"), F.lit(","), F.lit("")).try_cast("double")
    return out.select(
        "report_id", "e.metric", value.alias("value"),
        F.when(F.col("gone"), "MISSING REPORT").when(value.isNull(), "MISSING").otherwise("ok").alias("status"),
    )
