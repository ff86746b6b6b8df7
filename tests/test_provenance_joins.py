"""Difference search and source agreement against plain loops, with very long reports."""

import random
from itertools import combinations

import numpy as np

from colprov.operators import reports as P
from colprov.operators import stats as H


def brute(claims, sources, tol=P.DERIVED_TOLERANCE):
    s = np.unique(sources)
    out = set()
    for x in claims:
        at = np.searchsorted(s, s + x - tol, side="right")
        at = np.maximum(at, np.arange(len(s)) + 1)
        ok = at < len(s)
        if np.any(np.abs(s[at[ok]] - s[ok] - x) < tol):
            out.add(x)
    return out


def derived(spark, claims, sources):
    c = spark.createDataFrame([(1, float(x)) for x in claims], "report_id int, x double")
    s = spark.createDataFrame([(1, float(x)) for x in sources], "report_id int, s double")
    return {r["x"] for r in P.derived_claims(c, s).collect()}


def test_a_report_with_100_000_numbers(spark):
    rng = np.random.default_rng(1)
    sources = rng.uniform(0, 1e9, 100_000).round(3)
    claims = [round(float(sources[7] - sources[3]), 3), round(abs(float(sources[99_999] - sources[50_000])), 3), 0.0] + rng.uniform(1e8, 2e8, 9).round(3).tolist()
    claims[0] = abs(claims[0])
    got = derived(spark, claims, sources)
    assert got == brute(claims, sources) and len(got) >= 2


def test_dense_sources_and_many_claims(spark):
    rng = np.random.default_rng(2)
    sources = rng.integers(-3000, 3000, 300) / 1000 + 1e-5
    claims = sorted({round(v, 2) for v in rng.uniform(-1, 9, 600)})
    assert derived(spark, claims, sources) == brute(claims, sources)


def test_no_sources_one_source_and_texts(spark):
    s = spark.createDataFrame([(1, "It is 0.500 and 0.000."), (2, "It is 0.250.")], "report_id int, sentence string")
    src = spark.createDataFrame([(1, "0.500"), (1, "n/a"), (1, None)], "report_id int, value string")
    got = {(r["report_id"], r["value"]): r["status"] for r in P.number_provenance(s, src).collect()}
    # zero is no difference of two different sources
    assert got == {(1, "0.500"): "DIRECT", (1, "0.000"): "UNSOURCED", (2, "0.250"): "UNSOURCED"}


def test_source_agreement_against_loops(spark):
    rng = random.Random(3)
    rows = [(rng.choice("DE"), f"s{rng.randrange(6)}", f"c{rng.randrange(8)}", rng.choice(["LABEL_DERIVED", "CLEAN"]), None) for _ in range(150)]
    rows = [(d, s, c, label, "row" if s != "s5" else "table") for d, s, c, label, _ in rows]
    df = spark.createDataFrame(rows, "dataset_id string, source_citation string, column string, label string, scope string")
    got = {(r["dataset_id"], r["a"], r["b"]): r for r in H.source_agreement(df, salts=3).collect()}
    want = {}
    for d in "DE":
        cols = {c for x, _, c, _, _ in rows if x == d}
        named = {}
        for x, s, c, label, _ in rows:
            if x == d and label == "LABEL_DERIVED":
                named.setdefault(s, set()).add(c)
        for a, b in combinations(sorted(named), 2):
            A, B, n = named[a], named[b], len(cols)
            po = (len(A & B) + n - len(A | B)) / n
            pe = len(A) * len(B) / n**2 + (n - len(A)) * (n - len(B)) / n**2
            want[d, a, b] = (1.0 if pe >= 1 else (po - pe) / (1 - pe), len(A & B) / len(A | B), ",".join(sorted(A - B)), ",".join(sorted(B - A)))
    assert set(got) == set(want)
    for k, (kappa, jaccard, a, b) in want.items():
        r = got[k]
        if "s5" in k:
            assert r["kappa"] is None and r["skipped"].startswith("scope")
        else:
            assert abs(r["kappa"] - kappa) < 1e-9 and abs(r["jaccard"] - jaccard) < 1e-9 and (r["only_a"], r["only_b"]) == (a, b)


def test_claims_of_a_small_report_are_not_multiplied(spark):
    """Reports of 20, 64 and 200 sources against all pairs; parts follow the number of sources."""
    rng = random.Random(5)
    sources = [(k, round(rng.random() * 50, 2)) for k, n in ((1, 20), (2, 64), (3, 200)) for _ in range(n)]
    claims = [(k, round(rng.random() * 20, 2)) for k in (1, 2, 3, 4) for _ in range(60)]
    d = P.derived_claims(spark.createDataFrame(claims, "report_id long, x double"), spark.createDataFrame(sources, "report_id long, s double"))
    assert "[1,2,3,4,5,6" not in d._jdf.queryExecution().optimizedPlan().toString()
    held = {k: {s for r, s in sources if r == k} for k in (1, 2, 3, 4)}
    want = {(k, x) for k, x in claims if any(b > a and abs(b - a - x) < P.DERIVED_TOLERANCE for a in held[k] for b in held[k])}
    assert {(r["report_id"], r["x"]) for r in d.collect()} == want
