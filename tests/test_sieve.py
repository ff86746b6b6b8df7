"""Probe sentences and records with known outcome."""

import pytest
from pyspark.sql import functions as F

from colprov.functions import vocab as V
from colprov.operators import reports as P
from colprov.operators import sieve as E


def sents(spark, *texts):
    return spark.createDataFrame([(i, "D", 0, x) for i, x in enumerate(texts)], "doc_id int, ds string, pos int, sentence string")


@pytest.mark.parametrize(
    "text, family",
    [
        ("This column should be discarded if the intention is a realistic predictive model.", "WARN"),
        ("The class was then assigned by three experts using the score.", "DEFINE"),
        ("If any mode is true, the 'machine failure' label is set to 1.", "CONDSET"),
        ("The per capita violent crimes variable was calculated using population.", None),
        ("Sales of ice cream by flavour and month.", None),
    ],
)
def test_families(spark, text, family):
    got = E.classify(sents(spark, text)).collect()
    assert [r["family"] for r in got] == ([family] if family else [])


def test_define_by_own_target(spark):
    s = sents(spark, "The per capita violent crimes variable was calculated using population.", "Nothing of the kind was calculated using it.")
    roles = spark.createDataFrame([("D", "per_capita_violent_crimes", "Target"), ("D", "age", "Feature")], "ds string, col string, role string")
    targets = E.target_names(roles, spark.createDataFrame([], "ds string, target string"))
    got = E.define_by_target(s, targets).collect()
    assert [(r["doc_id"], r["target"]) for r in got] == [(0, "per capita violent crimes")]
    assert got[0]["trigger"].endswith("was calculated using")


def test_condset_by_target(spark):
    s = sents(spark, "If the pump stops, Machine failure label is set to 1.", "Machine failure label is set to 1.", "If so, another thing is set to 1.")
    targets = spark.createDataFrame([("D", "Machine failure")], "ds string, target string")
    assert [r["doc_id"] for r in E.condset_by_target(s, targets).collect()] == [0]


def test_sentences_are_split_and_bounded(spark):
    d = spark.createDataFrame([(1, "Short. This one is  long enough.\nAnd so is this line")], "doc_id int, text string")
    assert [r["sentence"] for r in E.sentences(d).orderBy("pos").collect()] == ["This one is long enough.", "And so is this line"]


def test_anchor_whole_tokens_and_names_of_several_tokens(spark):
    s = sents(spark, "The d.time and G3_grade of the average patient, 100 % fat")
    cols = spark.createDataFrame([("D", c) for c in ("age", "G3", "G3_grade", "d.time", "%", "E.time", "patient")], "ds string, col string")
    for f in (lambda: E.anchor(s, cols, ["doc_id", "pos"], 1), lambda: E.anchor_inline(s, cols, 1)):
        assert f().first()["columns"] == ["G3_grade", "patient", "d.time", "%"]


def test_anchor_case_and_length(spark):
    s = sents(spark, "the DURATION and the ab")
    cols = spark.createDataFrame([("D", "duration"), ("D", "ab")], "ds string, col string")
    assert E.anchor(s, cols, ["doc_id", "pos"], 2).first()["columns"] == ["ab"]
    assert E.anchor(s, cols, ["doc_id", "pos"], 3, True).first()["columns"] == ["duration"]


def test_heading_blocks(spark):
    text = "Complications and outcomes of myocardial infarction:\n1. Fibrillation (FIBR): Nominal\n2. Death (LET)\nAdmission data\n3. Age (AGE)"
    d = spark.createDataFrame([(1, "D", text)], "doc_id int, ds string, text string")
    b = E.heading_blocks(d).collect()
    assert len(b) == 1 and b[0]["n_lines"] == 2
    cols = spark.createDataFrame([("D", c) for c in ("FIBR", "LET", "AGE")], "ds string, col string")
    a = E.anchor(E.heading_blocks(d), cols, ["doc_id", "block"], 2, text="body").first()
    assert a["columns"] == ["FIBR", "LET"]


@pytest.mark.parametrize(
    "text, target, want",
    [
        ("measured at the time of transplantation", False, "CLEAN"),
        ("Time to neutrophils recovery", False, "LEAKY"),
        ("age of the donor", False, "CLEAN"),
        ("Time to neutrophils recovery", True, "TARGET"),
        ("given at the time of admission, only known after surgery", False, "LEAKY"),
    ],
)
def test_closed_world(spark, text, target, want):
    d = spark.createDataFrame([(text, target)], "description string, is_target boolean")
    assert E.closed_world(d).first()["verdict"] == want


def test_synthetic_scope(spark):
    d = spark.createDataFrame([("a synthetic set", ["chess", "chess_synth"]), ("a synthetic set", ["x"]), ("real", ["x"])], "text string, configs array<string>")
    assert [r["synthetic_scope"] for r in E.synthetic(d, configs="configs").collect()] == ["scoped", "whole", None]


FP = [("STUDENT", 1, w, "short") for w in ("G1", "G2", "sex")] + [("STUDENT", 1, "school", "long"), ("STUDENT", 1, "G3", "target"), ("STUDENT", 1, "d.time", "long")]
FP += [("COMPAS", 2, w, "long") for w in ("decile_score", "priors_count")]


def mirror(spark, title, text):
    docs = spark.createDataFrame([(1, title, text)], "doc_id int, title string, text string")
    fp = spark.createDataFrame(FP, "name string, rank int, word string, kind string")
    credits = spark.createDataFrame([("STUDENT", 1, "student performance"), ("COMPAS", 2, "compas")], "name string, rank int, phrase string")
    r = E.mirrors(docs, fp, credits).collect()
    return (r[0]["mirror"], r[0]["rule"]) if r else None


def test_mirrors(spark):
    note = "Important note: the target attribute G3 has a strong correlation with attributes G2 and G1."
    assert mirror(spark, "Student Performance Data Set", note) == ("STUDENT", "source name")
    assert mirror(spark, "grades", note) == ("STUDENT", "target and two names")
    assert mirror(spark, "Ice Cream", "Sales of ice cream by flavour and month.") is None
    assert mirror(spark, "x", "an encompassing view") is None
    assert mirror(spark, "x", "G3 next to d.time and the school") == ("STUDENT", "target and two names")


def test_licences(spark):
    rows = [
        ("ANCrecovery", "ANCrecovery Time to neutrophil recovery defined as 0.5 Rbodymass Mass of the body", True, False),
        ("Rbodymass", "Rbodymass - Mass of the recipient ANCrecovery - Time to neutrophils recovery", True, False),
        ("Bumps", "The faults are classified into 7 types. One of seven fault types is Bumps.", False, False),
        ("Disease", "survival of Disease, after the transplant procedure", False, False),
        ("y", "y is the target", True, True),
    ]
    d = spark.createDataFrame(rows, "col string, quote string, dictish boolean, is_target boolean")
    got = {r["col"]: (r["reject"], r["licence_kind"]) for r in E.adjudicate_licence(d).collect()}
    assert got["ANCrecovery"] == (None, "TEMPORAL")
    assert got["Rbodymass"][0].startswith("no licensing phrase in the column's own")
    assert got["Bumps"] == (None, "REASON")
    assert got["Disease"][0].startswith("prose context")
    assert got["y"][0] == "IS_TARGET"


def test_dictionary_rows_and_windows(spark):
    p = spark.createDataFrame([("D", "s", 1, "follow_up Days of follow-up after surgery in days age Years of life")], "ds string, source string, page int, text string")
    assert "follow_up" in {r["col"] for r in E.dictionary_rows(p).collect()}
    cols = spark.createDataFrame([("D", "follow_up"), ("D", "age")], "ds string, col string")
    w = {r["col"]: r["dictish"] for r in E.anchored_windows(p, cols).collect()}
    assert w["follow_up"] is True


def test_statements(spark):
    t = "The call duration variable is only known after the call. Patient_id and encounter_id were removed to prevent data leakage. We excluded the column age_days because it repeats."
    got = [r["kind"] for r in E.statements(spark.createDataFrame([(1, t)], "doc_id int, text string")).orderBy("pos").collect()]
    assert got[0] == "TIMING_CLAIM" or "TIMING_CLAIM" in got
    assert "IDENTIFIER" in got and "EXCLUSION" in got


def test_empty_field_is_refused(spark):
    d = spark.createDataFrame([("",), (None,)], "text string")
    with pytest.raises(RuntimeError):
        E.require_populated(d, "text")


def test_explicit_quotes_first_pattern_wins(spark):
    d = spark.createDataFrame([("value predicted by a model at discharge",)], "description string")
    r = E.explicit_quotes(d).first()
    assert (r["kind"], r["matched"]) == ("DERIVED", "predicted by a model")


def reports(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "report_id int, text string")


def test_arithmetic_relations(spark):
    lines = [
        "F1 0.500 -> 0.620, a gain is 0.120", "F1 0.500 to 0.620 with dF1 = +0.200", "| 0.90 | 0.80 | +0.10 |", "| 0.90 | 0.80 | +0.30 |",
        "8 of 64 positives (12.5%)", "8 of 56 positives (12.5%)", "23/40 58%", "keep-all 0.71 and oracle 0.60, so +0.11",
    ]
    d = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "report_id int, line_no int, line string")
    got = {(r["line_no"], r["relation"]): r["ok"] for r in P.arithmetic(d).collect()}
    assert got[(0, "arrow-delta")] and not got[(1, "arrow-delta")]
    assert got[(2, "row-delta")] and not got[(3, "row-delta")]
    assert got[(4, "rate")] and not got[(5, "rate")]
    assert got[(6, "fraction")] and got[(7, "keep-minus-oracle")]


def test_prose_skips_fences_tables_and_headings(spark):
    t = "# Head of the matter, long enough.\nWe are the first to do this with\nall the data we have.\n```\ncode that is not prose at all, really.\n```\n| a | table row that is long enough. |\nThis follows because it must be so."
    got = [r["sentence"] for r in P.prose_sentences(reports(spark, t)).orderBy("line_no").collect()]
    assert got == ["We are the first to do this with all the data we have.", "This follows because it must be so."]
    tags = [r["tags"] for r in P.tagged_claims(P.prose_sentences(reports(spark, t))).orderBy("line_no").collect()]
    assert tags == ["PRIORITY,UNIVERSAL", "CAUSAL"]


def test_number_provenance(spark):
    s = spark.createDataFrame([(1, "It rose from 0.500 to 0.620, by 0.120, not 0.777 at all.")], "report_id int, sentence string")
    src = spark.createDataFrame([(1, "0.500"), (1, "0.620")], "report_id int, value string")
    got = {r["value"]: r["status"] for r in P.number_provenance(s, src).collect()}
    assert got == {"0.500": "DIRECT", "0.620": "DIRECT", "0.120": "DERIVED", "0.777": "UNSOURCED"}


def test_stale_pins_sections_and_metrics(spark):
    r = reports(spark, "now 6,557 rows\nthen", "at 6,557 rows [as-of] May\n", "The rate is\n0.25 here, see [N §3, §9].")
    assert [(x["report_id"], x["line_no"]) for x in P.stale_values(r, [("6,557", "8,693")]).collect()] == [(0, 1)]
    pins = spark.createDataFrame([(2, "rate", r"rate is (\d\.\d+)", "0.25"), (2, "gone", r"nowhere (\d)", "1"), (2, "bad", r"is (0\.\d+)", "0.30")], "report_id int, pin string, pattern string, want string")
    assert {x["pin"]: x["status"] for x in P.pinned_claims(r, pins).collect()} == {"rate": "ok", "gone": "MISSING", "bad": "FAIL"}
    src = spark.createDataFrame([(2, "1. ONE\n3. THREE\n")], "report_id int, text string")
    assert [x["section"] for x in P.dangling_sections(r, src).collect()] == ["9"]
    m = P.extract_metrics(r, {"rows": r"(\d,\d+) rows"}, spark.createDataFrame([(0,), (2,), (7,)], "report_id int")).collect()
    assert {x["report_id"]: (x["value"], x["status"]) for x in m} == {0: (6557.0, "ok"), 2: (None, "MISSING"), 7: (None, "MISSING REPORT")}
    assert [x["report_id"] for x in P.missing_reports(spark.createDataFrame([(0,), (7,)], "report_id int"), r).collect()] == [7]


def test_vocabularies_compile(spark):
    one = spark.createDataFrame([("x",)], "t string")
    for p in (V.WARN, V.DEFINE, V.DICTIONARY_WARN, V.CLOSED_POST, V.CLOSED_DERIVED):
        one.where(F.col("t").rlike(V.alternation(p))).count()


def test_the_row_pattern_is_run_once(spark):
    text = "tenure_months Number of months the customer has stayed until the event follow_up Days until death or censoring. last_call Duration of the call"
    d = E.dictionary_rows(spark.createDataFrame([("d", "s", 1, text), ("d", "s", 2, None), ("d", "t", 3, "none here")], "ds string, source string, page long, text string"))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("{12,150}") == 1
    got = {r["col"]: r["description"] for r in d.collect()}
    assert got["follow_up"].startswith("Days until death")
