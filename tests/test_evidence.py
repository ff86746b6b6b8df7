"""Hand-worked evidence, coder and pair-metric cases."""

import pytest
from pyspark.sql import functions as F

from colprov.operators import evidence as I
from colprov.operators import stats as H
from colprov.sources.landing import coder_answers

BASE = dict(
    dataset_id="d", dataset_url="u", column="c", target="t", prediction_point="before", label="LABEL_DERIVED", subtype="REASON",
    evidence_tier="E1", source_type="DOCUMENTATION", source_citation="s1", source_locator="p1", quote="it is derived", coder="x", date="2026", scope="FULL_COLUMN_SET",
)
DDL = ", ".join(f"`{k}` string" for k in BASE) + ", i int"


def records(spark, *changes):
    return spark.createDataFrame([tuple((BASE | c).values()) + (i,) for i, c in enumerate(changes)], DDL)


def problems(spark, *changes):
    return {(r["index"], r["problem"]) for r in I.record_problems(records(spark, *changes), "i").collect()}


def test_clean_record(spark):
    assert problems(spark, {}) == set()


@pytest.mark.parametrize(
    "change, said",
    [
        ({"subtype": None}, "LABEL_DERIVED requires a subtype"),
        ({"quote": ""}, "LABEL_DERIVED with no quote"),
        ({"quote": "w " * 30}, "quote is 30 words, limit 25"),
        ({"source_type": "PREPRINT"}, "E1/E2 must come from DOCUMENTATION"),
        ({"scope": "SOME"}, "bad scope SOME"),
        ({"evidence_tier": "E9"}, "bad evidence_tier E9"),
        ({"coder": None}, "missing required field 'coder'"),
    ],
)
def test_problem_rows(spark, change, said):
    assert said in {p for _, p in problems(spark, change)}


def test_duplicates_and_conflicting_scopes(spark):
    said = {p for _, p in problems(spark, {}, {"source_locator": "p2"})}
    assert "duplicate record x2 for d/c/s1" in said
    said = {p for _, p in problems(spark, {}, {"column": "e", "scope": "EXCLUSION_LIST_ONLY"})}
    assert "source d/s1 declares conflicting scopes" in said


def settle(spark, *changes):
    return {r["column"]: r for r in I.adjudicate(records(spark, *changes)).collect()}


def test_documentation_outranks_a_paper(spark):
    paper = {"evidence_tier": "E3", "source_type": "PEER_REVIEWED", "label": "LEGITIMATE", "subtype": None, "source_citation": "s2"}
    assert settle(spark, {}, paper)["c"]["label"] == "LABEL_DERIVED"


@pytest.mark.parametrize("tier, kind", [("E1", "DOCUMENTATION"), ("E3", "PEER_REVIEWED")])
def test_disagreement_at_the_best_tier_is_contested(spark, tier, kind):
    a = {"evidence_tier": tier, "source_type": kind}
    out = settle(spark, a, a | {"label": "LEGITIMATE", "source_citation": "s2"})["c"]
    assert out["label"] == "CONTESTED" and out["subtype"] is None


def test_one_source_quoted_twice_is_one_source(spark):
    assert settle(spark, {}, {"source_locator": "p2"})["c"]["n_sources"] == 1


def test_negatives_are_defaults_and_unknown_columns_errors(spark):
    cols = spark.createDataFrame([("d", c) for c in ("c", "c2", "c3")], "dataset_id string, `column` string")
    full, unknown = I.materialise(cols, I.adjudicate(records(spark, {})))
    basis = {r["column"]: r["basis"] for r in full.collect()}
    assert basis["c"] == "documentation" and basis["c2"] == basis["c3"] == "default (no source named it)"
    I.require_known(unknown)
    _, unknown = I.materialise(cols, I.adjudicate(records(spark, {"column": "gone"})))
    with pytest.raises(ValueError):
        I.require_known(unknown)


@pytest.mark.parametrize(
    "a, b, kappa",
    [("abab", "abab", 1.0), ("aaaaaaaaaa", "aaaaaaaaaa", 1.0), ("aabb", "abab", 0.0)],
)
def test_kappa(spark, a, b, kappa):
    df = spark.createDataFrame(list(zip(a, b)), "a string, b string").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    assert H.cohen(df, "a", "b", "n", []).first()["kappa"] == pytest.approx(kappa)


def test_kappa_undefined_when_asked(spark):
    df = spark.createDataFrame([("a", "a", 10)], "a string, b string, n long")
    assert H.cohen(df, "a", "b", "n", [], degenerate=None).first()["kappa"] is None


PAIRS = list(zip(range(8), "AAABBBMM", "ABMBBAMM", "AAABAAMM"))


def test_pair_metrics(spark):
    df = spark.createDataFrame(PAIRS, "idx int, y string, clean string, leak string")
    c = H.pair_rates(df, "y", "clean", "M", ("A", "B")).first()
    assert (c["escaped"], c["kept"], c["wrong"], c["rate"]) == (1, 5, 2, 0.4)
    k = H.pair_rates(df, "y", "leak", "M", ("A", "B")).first()
    assert (k["kept"], k["wrong"]) == (6, 2)
    m = H.pair_common(df, "y", "clean", "leak", "M", ("A", "B")).first()
    assert (m["common"], m["wrong_clean"], m["wrong_leak"], m["broke"], m["fixed"]) == (5, 2, 2, 1, 1)
    assert m["wrong_clean"] - m["wrong_leak"] == m["fixed"] - m["broke"]
    same = H.pair_common(df, "y", "clean", "clean", "M", ("A", "B")).first()
    assert same["broke"] == same["fixed"] == 0


def test_pair_rates_need_three_classes(spark):
    df = spark.createDataFrame([("A", "A"), ("B", "B")], "y string, p string")
    with pytest.raises(Exception, match="three classes"):
        H.pair_rates(df, "y", "p", "M", ("A", "B")).collect()


def test_binomial_and_t(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (1, 10, 0.021484375), (5, 10, 1.0), (0, 5, 0.0625)], "b int, n int, want double")
    for r in df.withColumn("p", H.binomial_two_sided(F.col("b"), F.col("n"))).collect():
        assert r["p"] == pytest.approx(r["want"], abs=1e-9)
    # two-sided 5% points of Student's t
    t = spark.createDataFrame([(12.706205, 1), (4.302653, 2), (3.182446, 3), (2.228139, 10), (2.200985, 11)], "t double, d int")
    for r in t.withColumn("p", H.t_two_sided(F.col("t"), F.col("d"))).collect():
        assert r["p"] == pytest.approx(0.05, abs=1e-6)


def test_coder_lines(spark):
    lines = ["12 REASON Y", "13. c, N ?", "14) X", "# comment", "", "15 maybe", "what"]
    good, bad = coder_answers(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = {r["item"]: (r["category"], r["licensed"], r["unsure"]) for r in good.collect()}
    assert got == {12: ("REASON", True, False), 13: ("CONSEQUENCE", False, True), 14: ("CONTESTED", True, False)}
    assert {r["reason"] for r in bad.collect()} == {"unknown category", "unparsed line"}


def test_bootstrap_of_one_repeated_dataset_has_no_width(spark):
    rows = [("m", d, c, s, 3 + c, 1, 2) for d in "abc" for c in (1, 6) for s in (1,)]
    t = spark.createDataFrame(rows, "model string, ds string, cond int, seed int, tp int, fp int, fn int")
    r = H.cluster_bootstrap(t, 1, 6, draws=50).first()
    assert r["lo"] == pytest.approx(r["hi"]) and r["n_ds"] == 3 and r["n_draws"] == 50


def test_greedy_never_raises_the_gap(spark):
    rows = [("m1", "d", f"c{i}", "REASON" if i % 2 else "CONSEQUENCE", i % 3, 3) for i in range(8)]
    t = spark.createDataFrame(rows, "model string, ds string, col string, subtype string, h int, n int")
    start = H.gap_of(H.base_sums(t), []).first()["gap"]
    gaps = [r["gap"] for r in H.greedy_relabel(t, 3).orderBy("step").collect()]
    assert gaps and all(b < a for a, b in zip([start, *gaps], gaps))
    # the first step is the best single flip, tried one by one
    flips = []
    for r in rows:
        other = "REASON" if r[3] == "CONSEQUENCE" else "CONSEQUENCE"
        flips.append(H.gap_of(H.base_sums(t.withColumn("subtype", F.when(F.col("col") == r[2], other).otherwise(F.col("subtype")))), []).first()["gap"])
    assert gaps[0] == pytest.approx(min(flips))
