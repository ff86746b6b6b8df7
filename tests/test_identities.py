"""Additive identities against every signed subset of a small table's columns."""

from itertools import combinations

import numpy as np
import pytest

from colprov.operators import rules as R


def found(df, cols, targets=None, rule=None):
    rows = R.additive_identities(df, cols, targets).collect()
    return {(r["target"], r["columns"]): r for r in rows if rule in (None, r["rule"])}


@pytest.mark.parametrize("seed", range(3))
def test_sums_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    x = {c: rng.integers(0, 50, 200).astype(float) for c in "abcd"}
    x["s"] = x["a"] + x["b"] + x["c"]
    x["t"] = x["s"] + x["d"]
    x["u"] = rng.normal(size=200)
    cols = list(x)
    df = spark.createDataFrame(list(zip(*[v.tolist() for v in x.values()])), cols)
    want = {
        (t, "+".join(p))
        for t in cols
        for k in range(2, len(cols))
        for p in combinations([c for c in cols if c != t], k)
        if np.allclose(sum(x[c] for c in p), x[t])
    }
    assert set(found(df, cols, rule="sum")) == want == {("s", "a+b+c"), ("t", "a+b+c+d"), ("t", "d+s")}


def test_long_sum_weights_and_shift(spark):
    rng = np.random.default_rng(7)
    cols = [f"c{i}" for i in range(20)]
    x = rng.integers(0, 9, (300, 20)).astype(float)
    rows = [(*r, sum(r), 2.0 * r[0] - 0.5 * r[1] + 7.0, r[3]) for r in x.tolist()]
    df = spark.createDataFrame(rows, [*cols, "total", "mix", "copy"])
    got = found(df, cols, ["total", "mix", "copy"])
    assert got["total", "+".join(cols)]["rule"] == "sum"
    mix = got["mix", "c0+c1"]
    assert (mix["rule"], mix["weights"], mix["shift"]) == ("linear", [2.0, -0.5], 7.0)
    assert got["copy", "c3"]["rule"] == "identity"


def test_one_broken_row_refuses(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 99, (500, 2)).astype(float).tolist()
    rows = [(a, b, a + b + (1e-4 if i == 250 else 0.0)) for i, (a, b) in enumerate(x)]
    assert found(spark.createDataFrame(rows, ["a", "b", "y"]), ["a", "b"], ["y"]) == {}


def test_nulls_constants_and_empty_tables(spark):
    rows = [(1.0, 2.0, 3.0, 5.0, None), (2.0, 2.0, 4.0, 5.0, 4.0), (4.0, 3.0, 7.0, 5.0, 7.0)]
    df = spark.createDataFrame(rows, "a double, b double, y double, k double, z double")
    assert set(found(df, ["a", "b", "k", "z"], ["y"])) == {("y", "a+b")}
    assert found(df.where("a > 100"), ["a", "b"], ["y"]) == {}
    inf = spark.createDataFrame([(1.0, float("nan"), 3.0), (2.0, float("inf"), 4.0)], "a double, b double, y double")
    assert found(inf, ["b"], ["y"]) == {}


def test_sweep_has_sums_for_every_target(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (100, 3)).tolist()
    df = spark.createDataFrame([(a, b, c, a + b + c) for a, b, c in x], "a int, b int, c int, y int")
    got = {(r["rule"], r["columns"], r["target"]) for r in R.sweep_rules(df, ["a", "b", "c"], ["y", "c"]).collect()}
    assert ("sum", "a+b+c", "y") in got and not any(r == "sum" and t == "c" for r, _, t in got)
