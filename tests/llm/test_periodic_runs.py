"""Periodic runs against a search over all stretches and lags."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from colprov.llm import periodic_runs as pr

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, runs int, h int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rewound(i, w):
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(w)
    if i is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def brute(w, least=6, power=4):
    """Maximal stretches for every lag; a stretch counts for its smallest lag."""
    found = {}
    for q in range(1, len(w) // power + 1):
        k = 0
        while k < len(w) - q:
            if w[k] != w[k + q]:
                k += 1
                continue
            s = k
            while k < len(w) - q and w[k] == w[k + q]:
                k += 1
            if k - s + q >= max(least, power * q):
                found.setdefault((s, k + q), q)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def collapsed(w, runs):
    gone = set()
    for s, length, q in runs:
        gone.update(range(s + q, s + length))
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def got(spark, rows, **opts):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], KIND)
    return [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in pr.collapse(df, **opts).collect()]


def wanted(rows, least=6, power=4):
    return [(i, len(w), runs := brute(w, least, power), collapsed(w, runs)) for i, t in rows for w in [words(t)]]


def agree(a, b):
    assert sorted(a, key=repr) == sorted(b, key=repr)


CASES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "a a a a a"), (6, "a a a a a a"), (6, "a a a a a a"), (None, "x y x y x y x y"),
    (7, "x a b a b a b a b a y"), (8, "a a a a a a b " * 5), (9, "é é  é\té é é ü"), (10, "a b c " * 3 + "a b"),
    (11, "a b c " * 4), (12, "a b c " * 4 + "a"), (13, "A a " * 6), (14, ("a a b " * 4 + "c ") * 4), (15, "p " * 7 + "q " * 6 + "p q " * 5),
    (16, " ".join("abaababaabaababaababa")),
]


def test_cases(spark):
    agree(got(spark, CASES), wanted(CASES))


def test_random_words_of_small_alphabets(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        w = rng.integers(0, 2 + i % 4, rng.integers(1, 120)).tolist()
        for _ in range(i % 4):  # a stretch told again and again, with a part of itself
            a, q, n = int(rng.integers(0, len(w))), int(rng.integers(1, 12)), int(rng.integers(1, 60))
            w[a:a] = (w[a : a + q] * n)[:n]
        rows.append((i, " ".join(f"w{x}" for x in w)))
    agree(got(spark, rows), wanted(rows))
    agree(got(spark, rows, least=3, power=3), wanted(rows, 3, 3))
    agree(got(spark, rows, least=20, power=5), wanted(rows, 20, 5))


def test_tables_as_the_contract_has_them(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(i, t) for i, t in CASES], "doc_id long, text string")
    docs = docs.unionByName(extra).repartition(5)
    want = []
    for r in docs.collect():
        w = rewound(r.doc_id, words(r.text))
        runs = brute(w)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r.doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha(lines), sha(collapsed(w, runs))))
    rows = pr.digests(pr.collapse(pr.rewound(docs))).drop("n_words").collect()
    agree([tuple(r) for r in rows], want)
    assert sum(x[1] > 0 for x in want) >= 10


def test_splitting_leaves_no_rare_word():
    rng = np.random.default_rng(2)
    h = pr.mix(rng.integers(0, 40, 3000).astype(np.uint64))
    row = np.repeat(np.arange(10), 300)
    for a, b in zip(*pr.surviving(h, row)):
        assert b - a >= 6 and len(set(row[a:b])) == 1 and np.unique(h[a:b], return_counts=True)[1].min() >= 4


@pytest.mark.parametrize("text, count", [("a " * 200_000, 1), ("a b c " * 60_000, 1), ("a a a a a a b " * 20_000, 20_001)])
def test_long_repetitive_texts(spark, text, count):
    (row,) = got(spark, [(1, text)])
    assert len(row[2]) == count
    assert max(x[1] for x in row[2]) == row[1]


def test_empty_table(spark):
    assert got(spark, []) == []
