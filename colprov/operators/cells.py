"""Verdict cells: from raw completions to one trusted verdict per column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprov.functions.joins import join_dim
from colprov.functions.text import bind
from colprov.session import cut, kept


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record per key by ``order``. An aggregate rather than a window, so
    a key with very many records is folded map-side."""
    rest = [c for c in df.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(top.alias("_top")).select(*keys, "_top.*").select(*df.columns)


CELL = ["model", "ds", "cond", "seed"]
VERDICTS = ["AVAILABLE", "UNAVAILABLE", "ABSTAIN"]

ANSWER = "struct<columns: array<struct<name: string, verdict: string, confidence: double, reason: string>>>"
COLUMNS = "array<struct<name: string, verdict: string, confidence: double, reason: string>>"


def newest_with_count(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``newest`` plus how many records each kept one replaced."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_top"), F.count(F.lit(1)).alias("_n"))
    return g.select(*keys, "_top.*", (F.col("_n") - 1).alias("superseded"))


def parse_answers(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``columns`` and ``mode``: the whole answer as JSON, else the outermost
    object that speaks of columns, else name/verdict pairs salvaged from the text
    (first mention of a name wins), else none. Salvage never invents a verdict."""
    text = F.trim(F.regexp_replace(F.trim(F.col(raw)), r"(?m)^```(?:json)?|```$", ""))
    whole = F.from_json(text, ANSWER)["columns"]
    inner = F.from_json(F.regexp_extract(text, r'(?s)^[^{]*+(\{.*"columns".*\})', 1), ANSWER)["columns"]
    pair = r'(?s)"name"\s*:\s*"([^"]+)".{0,400}?"verdict"\s*:\s*"(AVAILABLE|UNAVAILABLE|ABSTAIN)"'

    # sorted by name, then place: a repeat stands right behind the mention it repeats
    def first_wins(b):
        placed = F.array_sort(F.transform(b["n"], lambda n, i: F.struct(n.alias("name"), i.alias("i"), b["v"][i].alias("verdict"))))
        firsts = bind(placed, lambda s: F.filter(s, lambda x, j: (j == 0) | (F.get(s, j - 1)["name"] != x["name"])))
        back = F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["name"].alias("name"), x["verdict"].alias("verdict"))))
        return F.transform(back, lambda x: F.struct(x["name"].alias("name"), x["verdict"].alias("verdict"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("reason")))

    pairs = F.struct(F.regexp_extract_all(text, F.lit(pair), 1).alias("n"), F.regexp_extract_all(text, F.lit(pair), 2).alias("v"))
    saved = bind(pairs, lambda b: F.when(F.size(b["n"]) > 0, first_wins(b)))
    # one struct column: the text is read once, whatever is asked of the result
    found = F.coalesce(
        bind(whole, lambda c: F.when(c.isNotNull(), F.struct(c.alias("columns"), F.lit("json").alias("mode")))),
        bind(inner, lambda c: F.when(c.isNotNull(), F.struct(c.alias("columns"), F.lit("json").alias("mode")))),
        bind(saved, lambda c: F.when(c.isNotNull(), F.struct(c.alias("columns"), F.lit("salvage").alias("mode")))),
        F.struct(F.lit(None).cast(COLUMNS).alias("columns"), F.lit("none").alias("mode")),
    )
    return df.withColumn("_found", found).withColumns({"columns": F.col("_found.columns"), "mode": F.col("_found.mode")}).drop("_found")


def explode_verdicts(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per judged column; entries without a name are no verdicts."""
    return (
        parsed.select(*keys, F.explode("columns").alias("c"))
        .select(*keys, F.col("c.name").alias("col"), "c.verdict", "c.confidence", "c.reason")
        .where(F.col("col").isNotNull() & (F.col("col") != ""))
    )


def usable(cells: DataFrame, raw: str = "raw", status: str = "status") -> DataFrame:
    """Empty and failed answers never become verdicts."""
    return cells.where((F.trim(F.coalesce(F.col(raw), F.lit(""))) != "") & ~F.coalesce(F.col(status).startswith("ERROR"), F.lit(False)))


def truth_sizes(truth: DataFrame) -> DataFrame:
    return truth.groupBy("ds").agg(
        F.count(F.lit(1)).alias("n_cols"), F.count_if("is_pos").alias("n_pos")
    )


def cell_tally(verdicts: DataFrame, truth: DataFrame, cell: list[str] | None = None) -> DataFrame:
    """Every cell against the truth of its dataset: n_cols, n_pos, n_verdicts,
    n_matched, tp, fp, fn, abstained.

    A column the cell did not answer counts as not flagged. That needs no row per
    unanswered column: fn is the dataset's positives less tp.
    """
    cell = cell or CELL
    j = join_dim(verdicts.select(*cell, "col", "verdict"), truth.select("ds", "col", "is_pos"), ["ds", "col"], "left")
    flagged, known = F.col("verdict") == "UNAVAILABLE", F.col("is_pos").isNotNull()
    per = j.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n_verdicts"),
        F.count_if(known).alias("n_matched"),
        F.count_if(flagged & F.col("is_pos")).alias("tp"),
        F.count_if(flagged & ~F.col("is_pos")).alias("fp"),
        F.count_if(known & (F.col("verdict") == "ABSTAIN")).alias("abstained"),
    )
    return join_dim(per, truth_sizes(truth), ["ds"]).withColumn("fn", F.col("n_pos") - F.col("tp"))


def with_coverage(tally: DataFrame, floor: float = 0.9) -> DataFrame:
    """Answered share of the truth's columns, and whether the cell is covered enough."""
    return tally.withColumn("coverage", F.col("n_matched") / F.col("n_cols")).withColumn(
        "scored", F.col("coverage") >= floor
    )


def join_failures(tally: DataFrame) -> DataFrame:
    """Cells none of whose verdicts names a column of the truth: a bug, not a zero."""
    return tally.where("n_matched = 0 AND n_verdicts > 0")


def guarded(tally: DataFrame) -> DataFrame:
    return tally.where("n_matched > 0 OR n_verdicts = 0")


def with_truncation(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Cut off by us (last character no closer, or braces left open) or complete.
    Looked at on every text, parseable or not."""
    tail = F.right(F.rtrim(F.regexp_replace(F.col(raw), r"\s+$", "")), F.lit(1))
    length = F.length(raw)
    opened = length - F.length(F.replace(F.col(raw), F.lit("{")))
    closed = length - F.length(F.replace(F.col(raw), F.lit("}")))
    whole = tail.isin("}", "]", "`", '"') & (opened - closed <= 1)
    return df.withColumn("truncated", ~F.coalesce(whole, F.lit(False)))


def never_restored(quarantined: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Quarantined cells without a live replacement."""
    return quarantined.select(*keys).distinct().join(live.select(*keys).distinct(), keys, "left_anti")


def provisional_models(lost: DataFrame) -> DataFrame:
    return lost.groupBy("model").agg(F.count(F.lit(1)).alias("n_missing"))


def missing_cells(cells: DataFrame, by: list[str], axes: list[str]) -> DataFrame:
    """Cells of the expected grid that are absent. The grid is, per ``by``, every
    combination of the values each axis takes anywhere: an explode of short lists."""
    present = cells.select(*by, *axes).distinct()
    grid = present.select(*by).distinct()
    for a in axes:
        values = present.agg(F.array_sort(F.collect_set(a))).scalar()
        grid = grid.withColumn("_values", values).withColumn(a, F.explode("_values")).drop("_values")
    return grid.join(present, by + axes, "left_anti")


def answer_problems(rows: DataFrame, truth: DataFrame, cell: list[str]) -> DataFrame:
    """(cell.., col, problem): invented and unjudged columns, bad verdicts, a column
    judged twice within a cell. ``rows`` are raw verdict rows, one per judgment.

    The rows are read once, their fold per cell and column is kept. Unjudged columns are found
    per column, as the cells of its dataset less those that judged it, so that the grid of
    cells and columns is written out where it is found and never moved.
    """
    per = kept(
        rows.groupBy(*cell, "col").agg(
            F.count(F.lit(1)).alias("k"), F.bool_or(~F.coalesce(F.col("verdict").isin(VERDICTS), F.lit(False))).alias("bad")
        ),
        "judged",
    )
    known = join_dim(per, truth.select("ds", "col", F.lit(True).alias("known")), ["ds", "col"], "left")
    tests = F.array(
        F.when(F.col("known").isNull(), "invented column"),
        F.when(F.col("k") > 1, "judged more than once"),
        F.when(F.col("bad"), "bad verdict"),
    )
    said = known.select(*cell, "col", F.explode(F.filter(tests, lambda x: x.isNotNull())).alias("problem"))
    cells = per.select(*cell).distinct()
    # a cell that judged every column has nothing missing: only the others are expanded
    full = known.where("known").groupBy(*cell).agg(F.count(F.lit(1)).alias("k"))
    short = cut(
        cells.join(full, cell, "left").join(truth_sizes(truth), "ds").where(F.coalesce("k", F.lit(0)) < F.col("n_cols")).select(*cell, F.monotonically_increasing_id().alias("_cell"))
    )
    judged = join_dim(per.select(*cell, "col"), short, cell).groupBy("ds", "col").agg(F.collect_set("_cell").alias("_judged"))
    asked = short.groupBy("ds").agg(F.collect_list("_cell").alias("_asked"))
    left = join_dim(truth.select("ds", "col").join(judged, ["ds", "col"], "left"), asked, ["ds"])
    missing = F.when(F.col("_judged").isNull(), F.col("_asked")).otherwise(F.array_except("_asked", "_judged"))
    unjudged = join_dim(left.select("col", F.explode(missing).alias("_cell")), short, ["_cell"]).select(*cell, "col")
    return said.unionByName(unjudged.select(*cell, "col", F.lit("unjudged column").alias("problem")))


def accept_models(rows: DataFrame, problems: DataFrame) -> DataFrame:
    """All or nothing per model: any problem refuses the model's whole batch."""
    return rows.join(problems.select("model").distinct(), "model", "left_anti")


def vote(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Strict majority over seeds: flagged when more than half of the answers flag."""
    flag = (F.col("verdict") == "UNAVAILABLE").cast("long")
    return verdicts.groupBy(*keys, "col").agg(F.sum(flag).alias("u"), F.count(F.lit(1)).alias("n")).withColumn(
        "flagged", 2 * F.col("u") > F.col("n")
    )


def most_complete(cells: DataFrame, keys: list[str], size: str, tie: list[str]) -> DataFrame:
    """The cell with the most answered columns per key; ties by the smallest ``tie``."""
    rest = [c for c in cells.columns if c not in keys]
    top = F.min_by(F.struct(*rest), F.struct(-F.col(size), *[F.col(c) for c in tie]))
    return cells.groupBy(*keys).agg(top.alias("_top")).select(*keys, "_top.*")


def cache_statistics(cells: DataFrame) -> DataFrame:
    """Cells by condition, by provider, by model, by paraphrase, and in all."""
    per = cells.groupBy("cond", "provider", "model", "paraphrase").agg(F.count(F.lit(1)).alias("n"))
    axes = {
        "condition": F.col("cond").cast("string"),
        "provider": F.col("provider"),
        "model": F.col("model"),
        "paraphrase": F.col("paraphrase").cast("string"),
        "all": F.lit("ALL"),
    }
    each = F.array(*[F.struct(F.lit(k).alias("what"), v.alias("level")) for k, v in axes.items()])
    return per.select("n", F.explode(each).alias("e")).groupBy("e.what", "e.level").agg(F.sum("n").alias("n"))


def coverage_summary(covered: DataFrame, by: str) -> DataFrame:
    """Cells, complete share and mean coverage per level of ``by``, and for ALL."""
    return (
        covered.rollup(by)
        .agg(
            F.count(F.lit(1)).alias("cells"),
            F.avg((F.col("n_matched") == F.col("n_cols")).cast("double")).alias("complete"),
            F.avg("coverage").alias("mean_coverage"),
        )
        .select(F.coalesce(F.col(by).cast("string"), F.lit("ALL")).alias("level"), "cells", "complete", "mean_coverage")
    )


def token_cost(cells: DataFrame, prices: DataFrame, text: str = "raw", prompt: str = "prompt") -> DataFrame:
    """Tokens by the four-characters rule and their cost between two prices per
    million: model, n, tokens_in, tokens_out, cost_low, cost_high."""
    def tokens(c):
        return F.floor((F.length(c) + 3) / 4)

    per = cells.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.sum(tokens(prompt)).alias("tokens_in"), F.sum(tokens(text)).alias("tokens_out")
    )
    j = per.join(prices, "model", "left")
    return j.select(
        "model",
        "n",
        "tokens_in",
        "tokens_out",
        ((F.col("tokens_in") * F.col("in_low") + F.col("tokens_out") * F.col("out_low")) / 1e6).alias("cost_low"),
        ((F.col("tokens_in") * F.col("in_high") + F.col("tokens_out") * F.col("out_high")) / 1e6).alias("cost_high"),
    )


def back_map(verdicts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Verdicts on aliases carried back to the original column names; a verdict on
    a name that is no alias keeps a null column and is left to the join guard."""
    a = aliases.select("ds", F.col("alias").alias("col"), F.col("col").alias("original"))
    return join_dim(verdicts, a, ["ds", "col"], "left").withColumns({"shown_as": F.col("col"), "col": F.col("original")}).drop("original")
