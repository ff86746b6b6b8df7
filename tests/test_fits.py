"""Folds, fits and their store on small planted tables."""

import collections

import pytest
from pyspark.sql import functions as F

from colprov.operators import impact as J
from colprov.operators import stats as H
from colprov.operators.fits import Fit, Fits

SMALL = dict(trees=4, depth=3)


@pytest.fixture(scope="module")
def planted(spark):
    """Three classes; ``flag`` gives away one, ``code`` all; groups of up to four rows."""
    df = spark.range(900).select(
        "id", (F.col("id") / (1 + F.col("id") % 4)).cast("long").alias("g"), F.element_at(F.array(*[F.lit(c) for c in "aabcaacbc"]), (F.col("id") % 9 + 1).cast("int")).alias("y"), F.rand(3).alias("noise")
    )
    df = df.withColumn("flag", (F.col("y") == "c").cast("double")).withColumn("code", F.ascii("y").cast("double"))
    return J.stratified_folds(df, "id", "y", 3).cache()


@pytest.mark.parametrize("k", [2, 5])
def test_groups_stay_whole_and_folds_alike(planted, k):
    rows = J.grouped_stratified_folds(planted.drop("fold"), "g", "y", k).select("g", "y", "fold").collect()
    assert len(rows) == 900
    folds, kinds, counts = {}, collections.defaultdict(collections.Counter), collections.Counter()
    for r in rows:
        assert folds.setdefault(r.g, r.fold) == r.fold
        kinds[r.g][r.y] += 1
        counts[r.fold, r.y] += 1
    per_kind = collections.Counter((tuple(sorted(kinds[g].items())), f) for g, f in folds.items())
    for kind in {x for x, _ in per_kind}:
        n = [per_kind[kind, f] for f in range(k)]
        assert max(n) - min(n) <= 1
    for y in "abc":
        n = [counts[f, y] for f in range(k)]
        assert max(n) - min(n) <= sum(dict(x).get(y, 0) for x in {x for x, _ in per_kind})
        assert max(n) - min(n) <= 0.15 * sum(n) / k


def test_groups_are_used_only_where_they_repeat(planted):
    folds = J.assign_folds(planted.drop("fold"), "id", "y", 3, group="id")
    assert folds.groupBy("fold", "y").count().groupBy("y").agg((F.max("count") - F.min("count")).alias("d")).where("d > 1").isEmpty()


@pytest.mark.parametrize("kind", ["rf", "gb"])
def test_three_classes_over_given_folds(planted, kind):
    arms = {"clean": ["flag", "code"], "flag": ["noise", "code"], "code": ["noise", "flag"]}
    pred = J.run_arms(planted, ["noise", "flag", "code"], "y", arms, 3, kind, keep=["y"], **SMALL)
    assert pred.groupBy("arm").count().where("count <> 900").isEmpty()
    said = F.element_at(F.array(*[F.lit(c) for c in "abc"]), (F.col("pred") + 1).cast("int"))
    f1 = {(r["arm"], r["class"]): r["f1"] for r in J.class_report(pred.withColumn("p", said), "y", "p", ["arm"]).collect()}
    assert f1["flag", "c"] == f1["code", "accuracy"] == 1 and f1["clean", "accuracy"] < 0.6 and f1["flag", "accuracy"] > f1["clean", "accuracy"]
    total = F.aggregate("scores", F.lit(0.0), lambda a, b: a + b)
    assert pred.where((F.size("scores") != 3) | (F.abs(total - 1) > 1e-6)).isEmpty()


def test_fits_are_named_shared_and_resumed(spark, planted, tmp_path):
    fits = Fits(planted, ["noise", "flag"], "y", ["fold", "id"], str(tmp_path))
    jobs = [Fit(cols, f"fold <> {i}", f"fold = {i}", "rf", (("trees", 2), ("depth", 2))) for cols in (("noise",), ("flag",)) for i in range(3)]
    names = fits.run(jobs + jobs)
    assert len(set(names.values())) == 6 == len(list(tmp_path.iterdir()))
    stamps = {p.name: (p / "_SUCCESS").stat().st_mtime_ns for p in tmp_path.iterdir()}
    lost = tmp_path / names[jobs[0]] / "_SUCCESS"  # as if the driver had died before the fit ended
    lost.unlink()
    again = Fits(planted, ["noise", "flag"], "y", ["fold", "id"], str(tmp_path))
    assert again.run(jobs) == names
    now = {p.name: (p / "_SUCCESS").stat().st_mtime_ns for p in tmp_path.iterdir()}
    assert {n for n in now if now[n] != stamps[n]} == {names[jobs[0]]}
    other = Fits(planted.where("id > 0"), ["noise", "flag"], "y", ["fold", "id"], str(tmp_path))
    assert not set(other.name(j) for j in jobs) & set(names.values())


def test_thresholds_come_from_training_rows(planted):
    two = planted.withColumn("t", (F.col("y") == "c").cast("int"))
    pred = J.run_arms(two, ["noise", "flag"], "t", {"ALL": [], "GT": ["flag"]}, 3, inner=2, unit="id", **SMALL)
    assert pred.count() == 1800
    per = pred.groupBy("arm", "fold").agg(F.count_distinct("threshold").alias("n"), F.min("threshold").alias("low"), F.max("threshold").alias("high")).collect()
    assert len(per) == 6 and all(r.n == 1 and 0 <= r.low <= 1 for r in per)


def test_partitions_of_the_rows(planted):
    folds = {str(i): f"pmod(xxhash64(id, {i}), 2)" for i in range(3)}
    pred = J.run_arms(planted, ["noise", "flag"], "y", {"ALL": []}, 2, fold=folds, keep=["id"], **SMALL)
    assert pred.groupBy("part").agg(F.count_distinct("id").alias("n")).where("n <> 900").isEmpty() and pred.count() == 2700


def test_reference_subsets():
    every = H.reference_subsets(list("abcd"), 2, 6)
    assert sorted(map(tuple, every)) == [tuple(x) for x in ("ab", "ac", "ad", "bc", "bd", "cd")]
    names = [f"c{i}" for i in range(200)]
    some = H.reference_subsets(names, 20, 50, seed=1)
    assert len({tuple(s) for s in some}) == 50 and all(len(set(s)) == 20 for s in some)
    assert some != H.reference_subsets(names, 20, 50, seed=2)
    assert len({c for s in some for c in s}) > 150  # not the neighbours of one order
