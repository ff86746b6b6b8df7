"""Evidence governance: validate records, settle one label per column, keep the
ground truth whole, and say what is out of scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colprov.functions.joins import join_dim
from colprov.functions.ranks import dense_codes
from colprov.operators.score import count_if
from colprov.operators.screens import MARKERS, any_of

# ---- fixed values: the record vocabulary
REQUIRED = [
    "dataset_id",
    "dataset_url",
    "column",
    "label",
    "evidence_tier",
    "source_type",
    "source_citation",
    "source_locator",
    "quote",
    "coder",
    "date",
    "scope",
]
SCOPES = ["FULL_COLUMN_SET", "EXCLUSION_LIST_ONLY"]
LABELS = ["LABEL_DERIVED", "LEGITIMATE", "CONTESTED"]
SUBTYPES = ["REASON", "CONSEQUENCE", "TIMING"]
TIERS = ["E1", "E2", "E3", "E4"]
SOURCES = ["DOCUMENTATION", "PEER_REVIEWED", "PREPRINT", "COMPETITION"]
QUOTE_WORDS = 25


def blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def record_problems(records: DataFrame, index: str) -> DataFrame:
    """(index, problem): one row per broken rule of a record; index -1 for rules
    over several records. No rows means the file is clean."""
    text = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce("quote", F.lit("")), r"\s+", " ")), " +", " ")
    words = F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))
    derived = F.col("label") == "LABEL_DERIVED"

    def bad(c, known):
        return F.when(~F.coalesce(F.col(c).isin(known), F.lit(False)), F.concat(F.lit(f"bad {c} "), F.coalesce(F.col(c), F.lit("None"))))

    tests = [F.when(blank(c), F.lit(f"missing required field '{c}'")) for c in REQUIRED]
    tests += [bad("label", LABELS)]
    tests += [F.when(F.col("subtype").isNotNull() & ~F.col("subtype").isin(SUBTYPES), F.concat(F.lit("bad subtype "), "subtype"))]
    tests += [bad("evidence_tier", TIERS), bad("source_type", SOURCES), bad("scope", SCOPES)]
    tests += [
        F.when(derived & (words == 0), "LABEL_DERIVED with no quote"),
        F.when(derived & (words > QUOTE_WORDS), F.concat(F.lit("quote is "), words.cast("string"), F.lit(f" words, limit {QUOTE_WORDS}"))),
        F.when(derived & F.col("subtype").isNull(), "LABEL_DERIVED requires a subtype"),
        F.when(F.col("evidence_tier").isin("E1", "E2") & (F.col("source_type") != "DOCUMENTATION"), "E1/E2 must come from DOCUMENTATION"),
        F.when((F.col("evidence_tier") == "E3") & (F.col("source_type") != "PEER_REVIEWED"), "E3 must come from PEER_REVIEWED"),
    ]
    own = records.select(
        F.col(index).cast("long").alias("index"), F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("problem")
    )
    twice = records.groupBy("dataset_id", "column", "source_citation").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(
        F.lit(-1).cast("long").alias("index"),
        F.concat(F.lit("duplicate record x"), F.col("k").cast("string"), F.lit(" for "), F.concat_ws("/", "dataset_id", "column", "source_citation")).alias("problem"),
    )
    scopes = records.groupBy("dataset_id", "source_citation").agg(F.count_distinct("scope").alias("k")).where("k > 1").select(
        F.lit(-1).cast("long").alias("index"),
        F.concat(F.lit("source "), F.concat_ws("/", "dataset_id", "source_citation"), F.lit(" declares conflicting scopes")).alias("problem"),
    )
    return own.unionByName(twice).unionByName(scopes)


def adjudicate(records: DataFrame) -> DataFrame:
    """One label per (dataset_id, column): the best tier decides, disagreement at
    that tier is CONTESTED, and backing is counted in distinct sources."""
    key = ["dataset_id", "column"]
    per_tier = records.groupBy(*key, "evidence_tier").agg(
        F.min("label").alias("lo"),
        F.max("label").alias("hi"),
        F.min_by("subtype", F.struct("source_citation", "source_locator")).alias("subtype"),
    )
    best = per_tier.groupBy(*key).agg(F.min_by(F.struct("evidence_tier", "lo", "hi", "subtype"), "evidence_tier").alias("b"))
    sources = records.groupBy(*key).agg(F.count_distinct("source_citation").alias("n_sources"))
    agreed, doc = F.col("b.lo") == F.col("b.hi"), F.col("b.evidence_tier").isin("E1", "E2")
    return best.join(sources, key).select(
        *key,
        F.when(agreed, F.col("b.lo")).otherwise("CONTESTED").alias("label"),
        F.when(agreed, F.col("b.subtype")).alias("subtype"),
        F.when(agreed, F.when(doc, "documentation").otherwise("sources agree"))
        .otherwise(F.when(doc, "documentation sources disagree").otherwise("sources disagree"))
        .alias("basis"),
        "n_sources",
        F.col("b.evidence_tier").alias("tier"),
    )


def materialise(columns: DataFrame, settled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every column of every dataset with a label, LEGITIMATE by default; and, apart,
    the settled columns that the distributed file does not have."""
    key = ["dataset_id", "column"]
    full = columns.join(settled, key, "left").withColumns(
        {
            "basis": F.when(F.col("label").isNull(), "default (no source named it)").otherwise(F.col("basis")),
            "n_sources": F.coalesce("n_sources", F.lit(0).cast("long")),
            "label": F.coalesce("label", F.lit("LEGITIMATE")),
        }
    )
    return full, settled.join(columns, key, "left_anti")


def require_known(unknown: DataFrame) -> None:
    left = [f"{r[0]}.{r[1]}" for r in unknown.select("dataset_id", "column").limit(20).collect()]
    if left:
        raise ValueError(f"records name columns absent from the distributed file: {left}")


def overlay(truth: DataFrame, audit: DataFrame) -> DataFrame:
    """The audited ground truth: withdrawn columns are no positives, re-licensed
    ones keep their label with the better quotation. Applied once, here."""
    a = audit.select("ds", "col", F.col("action").alias("_action"), F.col("quote").alias("_quote"))
    return join_dim(truth, a, ["ds", "col"], "left").withColumns(
        {
            "is_pos": F.col("is_pos") & (F.coalesce("_action", F.lit("")) != "withdraw"),
            "audited": F.coalesce("_action", F.lit("unchanged")),
            "licence": F.when(F.col("_action") == "relicense", F.col("_quote")),
        }
    ).drop("_action", "_quote")


def code_subtypes(truth: DataFrame, codes: DataFrame) -> DataFrame:
    """Positives with their mechanism code; a positive without one is a hole."""
    return join_dim(truth.where("is_pos").select("ds", "col"), codes.select("ds", "col", "code"), ["ds", "col"], "left").withColumn(
        "hole", F.col("code").isNull()
    )


def evidence_summary(positives: DataFrame, records: DataFrame) -> DataFrame:
    """How well the positives are backed: with a record, quoted, and by tier."""
    r = records.groupBy(F.col("dataset_id").alias("ds"), F.col("column").alias("col")).agg(
        F.min_by(F.struct("evidence_tier", "quote"), F.struct("evidence_tier", "source_citation", "source_locator")).alias("r")
    )
    j = positives.join(r, ["ds", "col"], "left")
    rows = F.array(
        F.struct(F.lit("positives").alias("what"), F.lit(True).alias("hit")),
        F.struct(F.lit("with a record").alias("what"), F.col("r").isNotNull().alias("hit")),
        F.struct(F.lit("quoted").alias("what"), (F.coalesce(F.trim("r.quote"), F.lit("")) != "").alias("hit")),
        *[F.struct(F.lit(f"tier {t}").alias("what"), F.coalesce(F.col("r.evidence_tier") == t, F.lit(False)).alias("hit")) for t in TIERS],
    )
    return j.select(F.explode(rows).alias("e")).groupBy("e.what").agg(count_if(F.col("e.hit")).alias("n"))


def attrition(candidates: DataFrame, datasets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rejections by reason, and datasets that were read and yielded nothing."""
    why = candidates.where("reject IS NOT NULL").groupBy("reject").agg(F.count(F.lit(1)).alias("n"))
    zero = datasets.join(candidates.where("reject IS NULL").select("ds").distinct(), "ds", "left_anti")
    return why, zero


def corpus_summary(truth: DataFrame) -> DataFrame:
    """Columns and positives per dataset, per stratum (TOTAL) and overall (COMBINED)."""
    per = truth.rollup("stratum", "ds").agg(
        F.count(F.lit(1)).alias("n_cols"), F.count_if("is_pos").alias("n_pos"), F.count_distinct("ds").alias("n_ds")
    )
    return per.select(
        F.coalesce("stratum", F.lit("COMBINED")).alias("stratum"),
        F.when(F.col("stratum").isNull(), "COMBINED").otherwise(F.coalesce("ds", F.lit("TOTAL"))).alias("ds"),
        "n_cols",
        "n_pos",
        "n_ds",
    )


def spec_problems(
    targets: DataFrame, columns: DataFrame, truth: DataFrame, data: DataFrame, sample: DataFrame
) -> DataFrame:
    """(ds, problem, severity, n): what is wrong with each dataset's specification."""
    key = ["ds", "col"]

    def found(df, problem, severity):
        return df.groupBy("ds").agg(F.count(F.lit(1)).alias("n")).select("ds", F.lit(problem).alias("problem"), F.lit(severity).alias("severity"), "n")

    uniq = columns.select(*key).distinct()
    parts = [
        found(uniq.join(targets.select("ds", F.col("target").alias("col")), key, "left_semi"), "target among the features", "hard"),
        found(truth.where("is_pos").join(data.select(*key), key, "left_anti"), "positive absent from the data file", "hard"),
        found(truth.join(uniq, key, "left_anti"), "truth names a column not listed", "hard"),
        found(uniq.join(truth.select(*key), key, "left_anti"), "listed column without truth", "hard"),
        found(columns.groupBy(*key).agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "duplicate column", "hard"),
        found(truth.where("is_pos AND subtype IS NULL"), "positive without a subtype", "hard"),
        found(uniq.join(sample.select(*key), key, "left_anti"), "column absent from the sample", "soft"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def partition_problems(arms: DataFrame, reserved: DataFrame) -> DataFrame:
    """Columns in both arms, and labels or identifiers in either. ``arms``: (ds, col, arm)."""
    both = arms.groupBy("ds", "col").agg(F.count_distinct("arm").alias("k")).where("k > 1").select("ds", "col", F.lit("in both arms").alias("problem"))
    held = arms.select("ds", "col").distinct().join(reserved.select("ds", "col"), ["ds", "col"], "left_semi").select(
        "ds", "col", F.lit("label or identifier in an arm").alias("problem")
    )
    return both.unionByName(held)


def split_groups(folds: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """Groups that span more than one fold."""
    return folds.groupBy(group).agg(F.count_distinct(fold).alias("n_folds")).where("n_folds > 1")


def alias_problems(columns: DataFrame, aliases: DataFrame, exempt: DataFrame) -> DataFrame:
    """(ds, col, check): C1 the map is total and one-to-one, C2 the alias is new and
    does not contain the name (exemptions never shelter a positive), C3 marker
    status is unchanged, C4 one alias carries one truth."""
    marker = any_of(MARKERS)
    j = join_dim(columns, aliases.select("ds", "col", "alias"), ["ds", "col"], "left")
    j = join_dim(j, exempt.select("ds", "col", F.lit(True).alias("exempt")), ["ds", "col"], "left")
    j = j.withColumn("exempt", F.coalesce("exempt", F.lit(False)))

    def hit(c):
        return F.regexp_replace(F.col(c), "_", " ").rlike(marker)

    contains = (F.length("col") > 3) & (F.instr(F.lower("alias"), F.lower("col")) > 0) & (F.col("alias") != F.col("col"))
    tests = F.array(
        F.when(F.col("alias").isNull(), "C1 unmapped"),
        F.when(F.col("alias") == F.col("col"), "C2 identical"),
        F.when(contains & ~F.col("exempt"), "C2 contains original"),
        F.when(contains & F.col("exempt") & F.col("is_pos"), "C2 positive exempted"),
        F.when(F.col("alias").isNotNull() & (hit("col") != hit("alias")), "C3 marker status changed"),
    )
    own = j.select("ds", "col", F.explode(F.filter(tests, lambda x: x.isNotNull())).alias("check"))
    extra = aliases.select("ds", "col").join(columns.select("ds", "col"), ["ds", "col"], "left_anti").withColumn("check", F.lit("C1 maps a column not in data"))
    clash = j.where("alias IS NOT NULL").groupBy("ds", "alias").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(
        "ds", F.col("alias").alias("col"), F.lit("C1 aliases collide").alias("check")
    )
    mixed = j.where("alias IS NOT NULL").groupBy("alias").agg(F.bool_or("is_pos").alias("any"), F.bool_and("is_pos").alias("all")).where("any AND NOT all").select(
        F.lit("*").alias("ds"), F.col("alias").alias("col"), F.lit("C4 conflicting truth").alias("check")
    )
    return own.unionByName(extra).unionByName(clash).unionByName(mixed)


def coder_sheet(columns: DataFrame, seed_order: Column) -> DataFrame:
    """One row per dataset: its columns in one field, the answer fields empty, and a
    seeded position that every renderer shares."""
    per = columns.groupBy("ds").agg(F.array_join(F.array_sort(F.collect_list("col")), "|").alias("columns"), F.count(F.lit(1)).alias("n_columns"))
    placed = dense_codes(per.withColumn("_o", seed_order), [], ["_o", "ds"], "item")
    return placed.select("ds", "columns", "n_columns", F.lit("").alias("answer"), F.lit("").alias("note"), (F.col("item") + 1).alias("item"))


def stale(table_time: DataFrame, input_time: DataFrame) -> DataFrame:
    """Derived tables older than the newest of their inputs. Both (table, mtime)."""
    newest = input_time.groupBy("table").agg(F.max("mtime").alias("input_mtime"))
    own = table_time.groupBy("table").agg(F.min("mtime").alias("mtime"))
    return own.join(newest, "table").withColumn("stale", F.col("mtime") < F.col("input_mtime"))


def require_fresh(stale_rows: DataFrame) -> None:
    old = [r["table"] for r in stale_rows.where("stale").select("table").limit(20).collect()]
    if old:
        raise RuntimeError(f"refusing to report: older than their inputs: {old}")


def positive_priority(columns: DataFrame, records: DataFrame) -> DataFrame:
    """Columns with the sources that call them label-derived, several sources first."""
    src = records.where("label = 'LABEL_DERIVED'").groupBy(F.col("dataset_id").alias("ds"), F.col("column").alias("col")).agg(
        F.array_sort(F.collect_set("source_citation")).alias("s")
    )
    j = columns.join(src, ["ds", "col"], "left")
    n = F.coalesce(F.size("s"), F.lit(0))
    return j.select("ds", "col", F.when(n > 0, n).otherwise(0).alias("n_sources"), F.coalesce(F.array_join("s", ","), F.lit("")).alias("sources"), (n >= 2).alias("multi_source"))


def backfill(rows: DataFrame, checks: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Founding records with the agreed defaults filled in and, per column, the
    sentence that states how the rule did on the data."""
    said = checks.select(
        "ds",
        "col",
        F.format_string("every row with %s=1 has the target (%d of %d, %s)", "col", "n_target", "n_flag", "verdict").alias("data_check"),
    )
    out = join_dim(rows, said, ["ds", "col"], "left")
    for k, v in defaults.items():
        out = out.withColumn(k, F.coalesce(F.col(k), F.lit(v)) if k in out.columns else F.lit(v))
    return out


def quote_counts(rows: DataFrame) -> DataFrame:
    q = F.coalesce(F.trim("quote"), F.lit("")) != ""
    return rows.agg(F.count(F.lit(1)).alias("n"), count_if(q).alias("with_quote"), count_if(~q).alias("without_quote"))


def scope_ledger(datasets: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Every dataset with its standing; an excluded one keeps its reason and is never in scope."""
    return datasets.join(exclusions.select("ds", "reason"), "ds", "left").withColumn("in_scope", F.col("reason").isNull())


def encoding_problems(df: DataFrame, clean: list[str], leaky: list[str], month: str | None = None) -> DataFrame:
    """After encoding: no all-null column, widths add up, no leak in the clean arm,
    and the month column is a gapless range."""
    cols = clean + leaky
    aggs = [F.count(F.col(c)).alias(f"k{i}") for i, c in enumerate(cols)]
    if month:
        aggs += [(F.max(month) - F.min(month) + 1 == F.count_distinct(month)).alias("gapless")]
    row = df.agg(*aggs)
    dead = F.array(*[F.when(F.col(f"k{i}") == 0, F.lit(c)) for i, c in enumerate(cols)])
    checks = [
        F.struct(F.lit("no column is all null").alias("check"), (F.size(F.filter(dead, lambda x: x.isNotNull())) == 0).alias("ok")),
        F.struct(F.lit("widths add up").alias("check"), F.lit(len(set(cols)) == len(cols) and set(cols) <= set(df.columns)).alias("ok")),
        F.struct(F.lit("no leak in the clean arm").alias("check"), F.lit(not set(clean) & set(leaky)).alias("ok")),
    ]
    if month:
        checks.append(F.struct(F.lit("months without gaps").alias("check"), F.col("gapless").alias("ok")))
    return row.select(F.explode(F.array(*checks)).alias("e")).select("e.*")


def yield_by_provenance(records: DataFrame) -> DataFrame:
    """Only what the sieve found counts towards its yield; nominated records stand apart."""
    sieve = F.col("provenance").startswith("SIEVE")
    return records.groupBy(F.when(sieve, "sieve").otherwise("nominated").alias("kind")).agg(
        F.count(F.lit(1)).alias("n_records"), F.count_distinct("ds").alias("n_datasets")
    )
