"""Screens of columns of any type against plain Python."""

import math
import random
import re

import pytest

from colprov.operators import typed

KIND = "ds string, y string, num double, flag boolean, share string, level string, dead string, one string"


def rows_of(n, seed):
    r = random.Random(seed)
    for _ in range(n):
        y = r.choice("ab" if r.random() < 0.8 else "c")
        num = r.choice([None, float("nan"), r.gauss(y == "a", 1), 1.0])
        share = r.choice([f"{r.randrange(9)}%", "$1,0", " 7 " if r.random() < 0.02 else "3", "x" if r.random() < 0.01 else "4"])
        yield (r.choice(["p", "q"]), y, num, r.choice([None, True, False, y == "b"]), share, r.choice([None, y + r.choice("12"), "z"]), None, "k")


def parse(x):
    try:
        return float(re.sub("[%$,]", "", x))
    except (TypeError, ValueError):
        return None


def encode(col, raw):
    if col in ("num", "flag"):
        v = [None if x is None or x != x else float(x) for x in raw]
        return v, [x is None for x in v]
    v, gone = [parse(x) for x in raw], [x is None for x in raw]
    if sum(x is not None for x in v) <= 0.9 * len(raw):
        codes = {x: float(i) for i, x in enumerate(sorted({x for x in raw if x is not None}))}
        v = [codes.get(x, -1.0) for x in raw]
    return v, gone


def features(col, raw, ys):
    v, gone = encode(col, raw)
    known = sorted(x for x in v if x is not None)
    mid = known and (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2
    v = [mid if x is None else x for x in v]
    auc = cor = miss = 0.0
    classes = sorted(set(ys))
    if len(set(v)) > 1:
        mean = sum(v) / len(v)
        var = sum((x - mean) ** 2 for x in v)
        for c in classes:
            pos, neg = [x for x, y in zip(v, ys) if y == c], [x for x, y in zip(v, ys) if y != c]
            if not neg:
                continue
            a = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
            auc = max(auc, abs(a - 0.5) + 0.5)
            cov = sum(p - mean for p in pos)
            cor = max(cor, abs(cov) / math.sqrt(var * len(pos) * len(neg) / len(v)))
    if 0 < sum(gone) < len(gone):
        rates = [sum(g for g, y in zip(gone, ys) if y == c) / ys.count(c) for c in classes]
        miss = max(rates) - min(rates)
    return auc, cor, miss


@pytest.mark.parametrize("n, seed", [(400, 1), (40, 2), (3, 3)])
def test_features_of_any_type(spark, n, seed):
    rows = list(rows_of(n, seed))
    cols = [c.split()[0] for c in KIND.split(", ")][2:]
    df = spark.createDataFrame(rows, KIND).repartition(3)
    got = {(r.ds, r.col): (r.auc, r.cor, r.miss) for r in typed.column_features(df, cols, "y", ["ds"]).collect()}
    want = {}
    for ds in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == ds]
        for k, c in enumerate(cols):
            want[ds, c] = features(c, [r[2 + k] for r in own], [r[1] for r in own])
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-9), key


def test_empty_table(spark):
    assert typed.column_features(spark.createDataFrame([], KIND), ["num", "level"], "y", ["ds"]).count() == 0
