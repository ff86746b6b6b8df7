"""The distributed order statistics against numpy, whatever the ranges are."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from colprov.functions.joins import join_dim
from colprov.functions.ranks import dense_codes, exact_median, exact_quantiles, running_before, with_range
from colprov.operators import screens as S
from colprov.operators.screens import class_auc


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    n = 4000
    # one key holds most rows and one value a third of them
    k = np.where(rng.random(n) < 0.8, "hot", rng.choice(["a", "b"], n))
    v = np.where(rng.random(n) < 0.33, 7.0, np.round(rng.lognormal(0, 2, n), 2))
    pdf = pd.DataFrame({"k": k, "v": v, "y": rng.choice(["p", "q", "r"], n)})
    return pdf, spark.createDataFrame(pdf).repartition(7)


@pytest.mark.parametrize("n", [1, 3, 16, 200])
def test_running_total(frame, n):
    pdf, df = frame
    d = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("w"))
    got = running_before(d, ["k"], ["v"], {"w": F.col("w")}, n).toPandas().sort_values(["k", "v"]).reset_index(drop=True)
    want = pdf.groupby(["k", "v"]).size().rename("w").reset_index()
    want["before"] = want.groupby("k").w.cumsum() - want.w
    assert (got.w_before.values == want.before.values).all()
    assert (got.w_total.values == want.groupby("k").w.transform("sum").values).all()


def test_ranges_follow_the_order_and_split_a_hot_key(frame):
    _, df = frame
    d = with_range(df.select("k", "v").distinct(), ["k", "v"], 16).toPandas().sort_values(["k", "v"])
    assert d._range.is_monotonic_increasing
    assert d[d.k == "hot"]._range.nunique() > 5


def test_quantiles_and_median(frame):
    pdf, df = frame
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r["k"]: r["q"] for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    for k, g in pdf.groupby("k"):
        assert np.allclose(got[k], np.quantile(g.v, probs))
    med = {r["k"]: r["median"] for r in exact_median(df, ["k"], "v").collect()}
    assert all(np.isclose(med[k], g.v.median()) for k, g in pdf.groupby("k"))


def test_codes_follow_sorted_order(frame):
    pdf, df = frame
    got = dense_codes(df.select("v").distinct(), [], ["v"]).toPandas().sort_values("v")
    assert (got.code.values == np.arange(len(got))).all()


def test_auc_is_that_of_all_pairs(frame):
    pdf, df = frame
    counts = df.groupBy("k", "v", "y").agg(F.count(F.lit(1)).alias("n"))
    for r in class_auc(counts, ["k"]).collect():
        g = pdf[pdf.k == r["k"]]
        pos, neg = g.v[g.y == r["y"]].values, g.v[g.y != r["y"]].values
        want = ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())
        assert np.isclose(r["auc"], want)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_the_plain_join(frame, spark, how):
    _, df = frame
    dim = spark.createDataFrame([("hot", 1), ("a", 2)], "k string, d int")
    salted = join_dim(df, dim, ["k"], how, max_rows=0, salts=4)
    plain = df.join(dim, ["k"], how)
    assert salted.columns == plain.columns
    assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0


def test_partitioning_does_not_matter(frame):
    _, df = frame
    counts = df.groupBy("k", "v", "y").agg(F.count(F.lit(1)).alias("n"))
    a = class_auc(counts.repartition(1), ["k"]).toPandas().sort_values(["k", "y"]).reset_index(drop=True)
    b = class_auc(counts.repartition(13), ["k"]).toPandas().sort_values(["k", "y"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


def test_a_salted_join_broadcasts_nothing(spark):
    """A dimension too large to broadcast is not broadcast in its salted copies either."""
    df = spark.range(100).selectExpr("id % 7 AS k", "id AS v")
    dim = spark.range(5).selectExpr("id AS k", "id * 10 AS w")
    joined = join_dim(df, dim, ["k"], max_rows=0)
    assert "BroadcastExchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == df.where("k < 5").count()


def test_screens_on_counts_kept_once(spark):
    """The AUC and the number of values, read from the same kept counts, are those of the table."""
    rows = [("d" if i % 3 else "e", "ab"[i % 2], float(i * 37 % 11), None if i % 5 == 0 else float(i * 13 % 7)) for i in range(200)]
    args = spark.createDataFrame(rows, "ds string, y string, u double, v double"), ["u", "v"], "y", ["ds"]
    moments = S.column_moments(*args)
    counts = S.filled_counts(*args, moments).localCheckpoint()
    got, want = S.column_features(*args, moments=moments, counts=counts), S.column_features(*args, moments=moments)
    key = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    assert key(got) == key(want) and got.count() == 4
    assert key(S.n_values(*args, moments, counts)) == key(S.n_values(*args, moments))
