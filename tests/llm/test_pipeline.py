"""Stages of the pipeline against brute force, with planted rows."""

import collections
import re

import numpy as np

import corpus_pipeline
from colprov.llm import decontaminate

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def kept_by_brute_force(rows):
    """One row of each group of linked texts: smallest id, null last."""
    texts = sorted({(r[0] is None, r[0] or 0, r[1] or "", r[1] is None) for r in rows})
    sets, up = [shingles(t[2]) for t in texts], list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    best = {}
    for i, t in enumerate(texts):
        best[find(i)] = min(best.get(find(i), t[:2]), t[:2])
    return collections.Counter((None if b[0] else b[1]) for b in best.values())


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)], KIND).repartition(3)


def test_one_row_of_each_group_stays(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 500, 60))) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " more") for i in range(20)] + [(5, "another text under the id of five, clean")] + [(7, rows[7][1])] * 2
    rows += [(None, rows[3][1]), (None, "nameless words of its own here"), (None, "nameless words of its own here"), (200, None), (201, ""), (201, "")]
    out = corpus_pipeline.jaccard_stage(spark, table(spark, rows), SF)
    assert out.columns == [c.split()[0] for c in KIND.split(", ")]
    assert collections.Counter(r.doc_id for r in out.collect()) == kept_by_brute_force(rows)


def test_suffix_stage_drops_what_starts_twice(spark):
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(1, "a " + passage + " b"), (2, "c " + passage), (3, "clean text"), (4, None), (None, "d " + passage)]
    left = {r.doc_id: r.text or "" for r in corpus_pipeline.suffix_stage(spark, table(spark, rows), SF).collect()}
    assert left == {1: "a b", 2: "c", 3: "clean text", 4: "", None: "d"}


def test_items_of_any_length_bear_a_substitution(spark):
    rng = np.random.default_rng(1)
    bench, docs = [], []
    for n in (10, 11, 12, 13, 15, 20, 40, 60):
        words = [f"b{n}x{i}" for i in range(n)]
        bench.append((n, " ".join(words)))
        copy = list(words)
        copy[int(rng.integers(0, 2)) * (n - 1)] = "other"  # at an end, where a seed of ten words still fits
        docs += [(n, "some words before " + " ".join(copy) + " and after"), (1000 + n, "clean " + " ".join(f"c{x}" for x in rng.integers(0, 99, n)))]
    docs += [(5000, None), (5001, "")]
    frame = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, matched int, n_items int, item_id int")
    out = decontaminate.verdicts(frame, spark.createDataFrame(bench, "item_id long, text string"))
    got = {r.doc_id: r.contaminated for r in out.collect()}
    assert got == {i: 11 <= i < 1000 for i, _ in docs} | {10: got[10]}


def test_empty_documents(spark):
    empty = table(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_run_keeps_clean_documents(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    out = corpus_pipeline.run(spark, SF).collect()
    assert 0.5 * n < len(out) <= n and len({r.doc_id for r in out}) == len(out)
