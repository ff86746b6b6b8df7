"""Verdict frames and answer problems on small tables with repeated and missing keys."""

import collections
import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from colprov.functions import joins
from colprov.operators import cells as C
from colprov.plans import frames as fr
from colprov.plans import score_queries as G
from colprov.plans import stat_queries as H
from colprov.plans.registry import Tables

DAY = datetime.datetime(2020, 1, 1)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Parts of two brands, of none, and twice of one; lines and orders without a key."""
    path = str(tmp_path_factory.mktemp("verdicts"))
    parts = [(k, f"Brand#{k % 3}", "NONE", k % 15) for k in range(30)] + [(3, "Brand#0", "NONE", 3), (4, "Brand#0", "NONE", 9), (5, None, "NONE", 2), (None, "Brand#1", "NONE", 2)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{path}/part.parquet")
    orders = [(k, "1-URGENT 2-HIGH 3-MEDIUM".split()[k % 3], "FO"[k % 2]) for k in range(60)] + [(60, None, "F"), (None, "1-URGENT", "O")]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string, o_orderstatus string").write.parquet(f"{path}/orders.parquet")
    lines = [
        (i * 7 % 62 if i % 50 else None, i * 11 % 31 if i % 41 else None, i % 6, 1 + i // 62 % 7, float(i % 50), float(i), "ANR"[i % 3] if i % 37 else None, "FO"[i // 2 % 2], DAY + datetime.timedelta(days=i % 13))
        for i in range(3000)
    ]
    kind = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(lines, kind).repartition(3).write.parquet(f"{path}/lineitem.parquet")
    return path


def some_tasks(monkeypatch, folder):
    """As if the lines were many: dealt over a dozen tasks."""
    size = sum(f.stat().st_size for f in Path(folder, "lineitem.parquet").iterdir())
    monkeypatch.setattr(fr, "LINES_BYTES", size // 12)


def bag(df):
    return collections.Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("large, wide", [(False, False), (True, False), (True, True)])
def test_verdicts_are_the_newest_records(spark, folder, monkeypatch, large, wide):
    t = Tables(spark, folder)
    names = ["model", "ds", "cond", "seed", "col", "verdict", "confidence"]
    order = ["ts", "tie1", "tie2"]
    plain = bag(C.newest(fr.records(t), fr.CELL + ["col"], order).select(*names))
    two = bag(C.newest(fr.records(t), ["paraphrase"] + fr.CELL + ["col"], order).select("paraphrase", *names[:-1]))
    if large:
        some_tasks(monkeypatch, folder)
    if wide:
        monkeypatch.setattr(fr, "is_small", lambda df: False)
    assert bag(fr.verdicts(t, "confidence").select(*names)) == plain and len(plain) > 500
    assert bag(fr.verdicts(t, by=["paraphrase"]).select("paraphrase", *names[:-1])) == two
    assert bag(C.newest(fr.records(t), fr.CELL + ["col"], order).select(*names)) == plain  # of a large lineitem


@pytest.mark.parametrize("query", [G.g5, G.g5b, G.g15, H.h1])
def test_records_are_sorted_out_once_a_query(spark, folder, monkeypatch, query):
    calls, found = [], fr.verdicts
    monkeypatch.setattr(fr, "verdicts", lambda t, *a, **k: calls.append(1) or found(t, *a, **k))
    query(Tables(spark, folder)).collect()
    assert len(calls) == 1


@pytest.mark.parametrize("query", [G.g13, G.g14b])
def test_lines_are_read_once_a_query(spark, folder, query):
    """Both queries read their tallies several times; the lines behind them are read once."""
    plan = query(Tables(spark, folder))._jdf.queryExecution().toString()
    assert "l_returnflag" not in plan


def test_moved_rows_hold_what_is_asked_for(spark, folder, monkeypatch):
    some_tasks(monkeypatch, folder)
    plan = fr.verdicts(Tables(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert "l_quantity" not in plan and "o_orderstatus" not in plan and "l_suppkey" not in plan


def answers(spark):
    rows = [("m", "d", 1, f"c{i}", "AVAILABLE") for i in range(4)] + [("m", "d", 2, "c1", "MAYBE"), ("m", "d", 2, "c1", "ABSTAIN"), ("m", "d", 2, "other", None)]
    rows += [(None, "d", 1, "c0", "AVAILABLE"), ("n", None, 1, "c0", "AVAILABLE"), ("n", "e", 1, None, "AVAILABLE"), ("n", "f", 1, "c0", "AVAILABLE"), ("n", "e", 2, "c0", "UNAVAILABLE")]
    truth = [("d", f"c{i}") for i in range(4)] + [("d", "c3"), ("e", "c0"), ("e", None), (None, "c0")]
    return rows, truth


@pytest.mark.parametrize("most", [200_000, 0])
def test_answer_problems(spark, monkeypatch, most):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", most)
    monkeypatch.setattr(joins.join_dim, "__defaults__", ("inner", most, joins.SALTS))
    rows, truth = answers(spark)
    want = collections.Counter()
    per = collections.Counter(r[:4] for r in rows)
    for key, k in per.items():
        known = sum(x == (key[1], key[3]) for x in truth) if None not in (key[1], key[3]) else 0
        bad = any(r[4] not in C.VERDICTS for r in rows if r[:4] == key)
        for on, what in ((known == 0, "invented column"), (k > 1, "judged more than once"), (bad, "bad verdict")):
            want[(*key, what)] += on * max(1, known)
    for cell in {r[:3] for r in rows}:
        asked = [c for d, c in truth if d == cell[1] and d is not None]
        # a column judged by a cell counts once for each of its rows in the truth
        full = sum(1 for k in per for d, c in truth if k[:3] == cell and None not in cell and (d, c) == (k[1], k[3]) and c is not None)
        if full < len(asked):
            for c in asked:
                if None in cell or c is None or (*cell, c) not in per:
                    want[(*cell, c, "unjudged column")] += 1
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(v):
        read.add(1)
        return v

    df = spark.createDataFrame(rows, "model string, ds string, cond int, col string, v string").select("model", "ds", "cond", "col", seen.asNondeterministic()("v").alias("verdict"))
    got = C.answer_problems(df, spark.createDataFrame(truth, "ds string, col string").withColumn("is_pos", F.lit(True)), ["model", "ds", "cond"])
    assert bag(got) == +want
    assert read.value == len(rows)
