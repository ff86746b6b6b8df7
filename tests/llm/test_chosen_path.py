"""Groups of the chosen-path join against all pairs."""

import re

import numpy as np
import pytest

from colprov.llm import chosen_path as cp

SF = "/root/testdata/sf0.001"


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n=4, num=80, den=100):
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    held = {}
    for i, s in enumerate(sets):
        for g in s:
            held.setdefault(g, []).append(i)
    common = {}
    for members in held.values():
        for k, i in enumerate(members):
            for j in members[:k]:
                common[j, i] = common.get((j, i), 0) + 1
    for (i, j), c in common.items():
        if den * c >= num * (len(sets[i]) + len(sets[j]) - c):
            up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low.get(find(i)), d == low.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def got(spark, rows, **opts):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, component int, s int").repartition(3)
    return sorted((tuple(r) for r in cp.groups(df, **opts).collect()), key=repr)


def changed(rng, words, k):
    out = list(words)
    for i in rng.integers(0, len(out), k):
        out[i] = f"z{rng.integers(1 << 30)}"
    return " ".join(out)


CASES = [
    (1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "a b c d e f g h"), (7, "a b c d e f g h"),
    (8, "A b c d e f g h"), (None, "a b c d e f g h"), (None, "lone words that are not elsewhere"), (9, "É b c d"), (10, "é b c d"), (9, "other words under one id"),
]


def test_cases(spark):
    assert got(spark, CASES) == brute(CASES)


def test_documents_and_planted_near_copies(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    n = 100_000
    for k in range(40):
        words = [f"v{x}" for x in rng.integers(0, 400, 150)]
        for _ in range(int(rng.integers(2, 6))):
            n += 1
            rows.append((n, changed(rng, words, int(rng.integers(0, 8)))))
    want = brute(rows)
    out = got(spark, rows)
    wrong = sum(a != b for a, b in zip(out, want))
    assert wrong <= len(want) // 1000
    assert sum(not r[3] for r in want) > 40


@pytest.mark.parametrize("k", [2, 5])
def test_large_groups_branch_and_are_met_by_hubs(spark, k, monkeypatch):
    """300 near copies of one text, 300 documents with one passage, all more than a small node holds."""
    monkeypatch.setattr(cp, "SMALL", 16)
    rng = np.random.default_rng(k)
    words, passage = [f"a{i}" for i in range(120)], [f"p{i}" for i in range(60)]
    rows = [(i, changed(rng, words, k)) for i in range(300)]
    rows += [(1000 + i, " ".join(passage + [f"o{x}" for x in rng.integers(0, 1 << 30, 30)])) for i in range(300)]
    out, want = got(spark, rows), brute(rows)
    assert sum(a != b for a, b in zip(out, want)) <= 2
    assert [r for r in out if r[0] >= 1000] == [r for r in want if r[0] >= 1000]


def test_other_thresholds(spark):
    rng = np.random.default_rng(4)
    words = [f"a{i}" for i in range(100)]
    rows = [(i, changed(rng, words, i % 12)) for i in range(60)]
    assert got(spark, rows, n=2, num=60, den=100) == brute(rows, 2, 60, 100)
    assert got(spark, rows, n=5, num=95, den=100) == brute(rows, 5, 95, 100)


def test_tokens_agree_as_often_as_sets():
    rng = np.random.default_rng(0)
    both, own = rng.integers(0, 1 << 62, 800).astype(np.uint64), rng.integers(0, 1 << 62, (200, 200)).astype(np.uint64)
    agree = []
    for k in range(0, 200, 2):
        x, y = np.sort(np.concatenate([both, own[k][:100]])), np.sort(np.concatenate([both, own[k + 1][:100]]))
        m = cp.minwise(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]))
        agree.append((m[0] == m[1]).mean())
    assert abs(np.mean(agree) - 0.8) < 0.02 and cp.fewest_shared(80, 100) >= 15


def test_empty_table(spark):
    assert got(spark, []) == []
