"""The keyed snapshot of newest verdicts: replays, late rows, what a batch reads and leaves."""

import random
from functools import reduce

from pyspark.sql import functions as F

from colprov.streaming import jobs as L

SHAPE = "model string, ds string, cond int, seed int, col string, verdict string, ts long"


def batches(spark, n, rows=60, seed=1):
    rng = random.Random(seed)
    return [
        spark.createDataFrame([(f"m{rng.randrange(2)}", f"d{rng.randrange(3)}", 0, 0, f"c{rng.randrange(9)}", rng.choice("AUX"), rng.randrange(10**9)) for _ in range(rows)], SHAPE)
        for _ in range(n)
    ]


def brute(frames):
    best = {}
    for r in (r for f in frames for r in f.collect()):
        key = tuple(r[:5])
        if key not in best or r["ts"] > best[key]["ts"]:
            best[key] = r
    return sorted(tuple(r) for r in best.values())


def read(spark, sink, version=None):
    return sorted(tuple(r) for r in L.current_verdicts(spark, sink, SHAPE, ["ts"], version).collect())


def test_versions_replay_and_late_rows(spark, tmp_path):
    sink, frames = str(tmp_path / "s"), batches(spark, 5)
    for i, f in enumerate(frames):
        L.upsert_verdicts(f, i, sink, ["ts"], buckets=4, deltas=2)
        L.upsert_verdicts(f, i, sink, ["ts"], buckets=4, deltas=2)
        assert read(spark, sink) == brute(frames[: i + 1])
    L.upsert_verdicts(frames[1], 1, sink, ["ts"], buckets=4, deltas=2)
    assert read(spark, sink) == brute(frames)
    assert read(spark, sink, 2) == brute(frames[:3])
    assert all(len(p) <= 2 for p in L._files(spark, sink, 4).values())


def test_only_buckets_of_the_batch_change(spark, tmp_path):
    sink, frames = str(tmp_path / "s"), batches(spark, 3)
    one = frames[2].limit(1)
    for i, f in enumerate([frames[0], frames[1], one]):
        L.upsert_verdicts(f, i, sink, ["ts"], buckets=8, deltas=1)
    before, after = L._files(spark, sink, 1), L._files(spark, sink, 2)
    assert len([b for b in after if after[b] != before.get(b)]) == 1


def test_old_versions_go_with_their_files(spark, tmp_path):
    sink, frames = str(tmp_path / "s"), batches(spark, 5)
    for i, f in enumerate(frames):
        L.upsert_verdicts(f, i, sink, ["ts"], buckets=2, deltas=1, keep=2)
    assert L.versions(spark, sink) == [3, 4]
    assert read(spark, sink) == brute(frames) and read(spark, sink, 3) == brute(frames[:4])
    assert not [p for p in (tmp_path / "s" / "data" / "delta=0").glob("bucket=*")]


def test_crash_before_publishing_and_empty_batches(spark, tmp_path):
    sink, frames = str(tmp_path / "s"), batches(spark, 2)
    assert read(spark, sink) == []
    L.upsert_verdicts(frames[0].limit(0), 0, sink, ["ts"])
    assert read(spark, sink) == []
    L.upsert_verdicts(frames[0], 1, sink, ["ts"], buckets=2)
    # files of a batch that was never published are not read, and are replaced when it runs
    L._write_buckets(frames[1].withColumn("bucket", F.lit(0)), f"{sink}/data/delta=2")
    assert read(spark, sink) == brute(frames[:1])
    L.upsert_verdicts(frames[1], 2, sink, ["ts"], buckets=2)
    assert read(spark, sink) == brute(frames)


def test_many_batches_read_like_one(spark, tmp_path):
    sink, frames = str(tmp_path / "s"), batches(spark, 4, rows=20, seed=5)
    for i, f in enumerate(frames):
        L.upsert_verdicts(f, i, sink, ["ts"], buckets=1, deltas=1)
    assert read(spark, sink) == brute([reduce(lambda a, b: a.union(b), frames)])
