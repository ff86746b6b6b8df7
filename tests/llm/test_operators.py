"""The dealt operators against brute force on small tables, with the awkward cases."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest

from colprov.llm import ann, bpe, decontaminate, fm_dedup, jaccard_join, sharding, suffix_dedup, toxicity, training_order, warc

SF = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"p{i}" for i in range(70))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n = 10_000
    rows += [
        (n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "One two"), (n + 4, "one TWO"), (n + 5, "x" * 5000),
        (n + 6, "a b " + PASSAGE), (n + 7, "c " + PASSAGE + " d"), (n + 8, PASSAGE), (n + 8, PASSAGE), (None, PASSAGE), (n + 9, "é" * 300 + " ü"),
    ]
    # an extra column whose name an operator uses itself
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, h int").repartition(4).cache()


def pairs_of(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_suffix_dedup(docs):
    rows = [(i, (t or "").encode()) for i, t in pairs_of(docs)]
    starts = {}
    for _, b in rows:
        for k in range(len(b) - 199):
            starts[b[k : k + 200]] = starts.get(b[k : k + 200], 0) + 1
    want = []
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if starts[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in suffix_dedup.removal_digests(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_suffix_order_is_the_transform():
    """Columns of aligned pieces: the order is that of the suffixes, ends those of their common prefixes."""
    rng = np.random.default_rng(3)
    table = rng.integers(97, 99, (12, 40)).astype(np.uint8)
    state = suffix_dedup.ColumnOrder()
    state.enter(np.arange(40, dtype=np.int32), 12)
    for column in range(11, -1, -1):
        state.insert(table[column], column)
        suffixes = [table[column:, i].tobytes() for i in state.order]
        assert suffixes == sorted(suffixes)
        for k in range(1, 40):
            common = next((j for j in range(12 - column) if suffixes[k][j] != suffixes[k - 1][j]), 12 - column)
            assert state.ends[k] == column + common


def test_fm_dedup(docs):
    rows = [(i, words(t)) for i, t in pairs_of(docs)]
    first = {}
    for i, w in rows:
        for k in range(len(w) - 49):
            key = " ".join(w[k : k + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    want = []
    for i, w in rows:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[" ".join(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in fm_dedup.kept_digests(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_jaccard_join(docs):
    rows = pairs_of(docs)
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = []
    for i, t in rows:
        w = words((t or "").translate(lower))
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    want = [(i, len(sets[k]), low.get(find(k))) for k, (i, _) in enumerate(rows)]
    got = [tuple(r) for r in jaccard_join.join(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_bpe(docs):
    import tiktoken

    content, pattern = bpe.public_vocabulary()
    ranks = bpe.read_ranks(content)
    encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in pairs_of(docs):
        ids = np.array(encoder.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in bpe.digests(docs, content, pattern).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    few = docs.where("doc_id >= 10000 or doc_id < 20")
    back = bpe.decode(bpe.encode(few, content, pattern), content)
    assert sorted((r.doc_id, bytes(r.bytes)) for r in back.where("doc_id is not null").collect()) == sorted(
        (i, (t or "").encode()) for i, t in pairs_of(few) if i is not None
    )


def test_sharding(docs):
    rows = pairs_of(docs)
    got = sharding.assign(docs, 4).collect()
    assert len(got) == len(rows)
    sizes = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sizes
    total = [0] * 4
    for r in got:
        total[r.shard] += r.size
    assert max(total) < 1.1 * sum(total) / 4
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_decontamination(spark):
    text = "The quick brown fox jumps over the lazy dog while seven wizards quietly mix strange potions tonight"
    items = spark.createDataFrame([(1, text), (2, "only four short words"), (3, None), (4, "five words are just enough")], "item_id long, text string")
    swapped = text.replace("lazy", "sleepy").replace("seven", "eight")
    rows = [
        (1, f"before it. {text.upper()}! after"), (2, f"x {swapped} y"), (3, "the quick brown fox sat on the mat all day long"), (4, None), (5, ""),
        (6, "only four short words"), (7, "so: five words are just enough, then"),
    ]
    got = decontaminate.verdicts(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {r.doc_id: r.item_id for r in got if r.contaminated} == {1: 1, 2: 1, 7: 4} and len(got) == 7
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert decontaminate.verdicts(empty, items).count() == 0


def test_decontamination_tries_every_run(spark):
    rng = np.random.default_rng(5)
    for _ in range(400):
        same = rng.random(int(rng.integers(0, 40))) < rng.choice([0.5, 0.8, 0.9])
        runs = [(int(same[a:b].sum()), b - a) for a in range(len(same)) for b in range(a + 1, len(same) + 1)]
        good = [(m, -n) for m, n in runs if m and 5 * m >= 4 * n]
        matched, length = decontaminate.best_run(same)
        assert (matched, -length) == max(good, default=(0, 0))
    item = [f"w{i}" for i in range(15)]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    rows = [(k, " ".join(["before", *item[:k], "other", *item[k + 1 :], "after"])) for k in range(15)]
    got = decontaminate.verdicts(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    hit = {r.doc_id for r in got if r.contaminated}
    assert {2, 11, 12} <= hit and all(r.matched == 14 for r in got if r.contaminated)


def test_toxicity(spark):
    rows = [(i, f"plain words number {i} here" + (" grunk vile" if i % 5 == 0 else "")) for i in range(200)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(120)] + [(121, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.assess(docs, labels).collect()}
    assert {i for i, r in got.items() if r.toxic} == {i for i in range(200) if i % 5 == 0}
    assert got[5].expected_severity > got[6].expected_severity
    kept = toxicity.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 162
    assert not any(r.toxic for r in toxicity.assess(docs, labels.limit(0)).collect())


def test_ann(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(600, 24)).astype("f4")
    v[300:340] = v[300]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(700, None), (701, [0.0] * 24), (702, [float("nan")] * 24), (720, [None] * 24)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), ann.F.col("vec_id") % 20 == 0, 5, block=64).collect()
    w = v.astype("f8")
    found = 0
    for q in range(0, 600, 20):
        s = w @ w[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(600), -s))[:5]
        mine = [r for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q]
        found += len({r.vec_id for r in mine} & set(want.tolist()))
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in mine)
    assert found >= 0.9 * 5 * 30 and {r.query_id for r in got} == set(range(0, 600, 20))


def ann_recall(spark, v, k=5, **options):
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), ann.F.col("vec_id") % 20 == 0, k, **options).collect()
    found, queries = 0, range(0, len(v), 20)
    for q in queries:
        s = v @ v[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(v)), -s))[: min(k, len(v) - 1)]
        found += len({r.vec_id for r in got if r.query_id == q} & set(want.tolist()))
    return found / (min(k, len(v) - 1) * len(queries))


def test_ann_norms(spark):
    """Recall does not depend on the norms: one long vector, skewed norms."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(40, 24))[rng.integers(0, 40, 1200)] + 0.5 * rng.normal(size=(1200, 24))
    v /= np.linalg.norm(v, axis=1)[:, None]
    outlier = v.copy()
    outlier[7] *= 100
    assert ann_recall(spark, outlier, block=64) >= 0.9
    assert ann_recall(spark, v * np.exp(rng.normal(size=1200))[:, None], block=64) >= 0.9


def test_ann_small_tables(spark):
    """All candidates where there are fewer than k, hashed or not, and k otherwise."""
    rng = np.random.default_rng(4)
    for n in (2, 15, 30):
        v = rng.normal(size=(n, 16))
        v /= np.linalg.norm(v, axis=1)[:, None]
        assert ann_recall(spark, v, 20) == 1
        # a single table and probe: nearly every query has to be compared with all
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
        got = ann.nearest(df, ann.F.lit(True), 20, tables=1, probes=1, block=1).groupBy("query_id").count().collect()
        assert {r.query_id: r["count"] for r in got} == dict.fromkeys(range(n), min(20, n - 1))


def test_warc(spark):
    rows = [(1, "a", "x" * 200_000), (2, None, "x" * 200_000), (3, "c\nd", None), (4, "c", ""), (5, "q", "é"), (6, "q", "z" * 65536)]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, h in rows:
        b = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()) and got[i].sound
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {1: 2, 3: 4}


def test_training_order(spark, tmp_path):
    for n in (1, 2, 3, 100, 4097):
        assert sorted(training_order.feistel(np.arange(n), n)) == list(range(n))
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame([(1, "some text " * 900), (2, None), (3, ""), (3, "")], "doc_id long, text string").write.parquet(path)
    content, pattern = bpe.public_vocabulary()
    rows = training_order.write(spark.read.parquet(path), content, pattern, str(tmp_path / "out")).toPandas()
    assert sorted(rows.slot) == list(range(len(rows)))
    encode, end = training_order.encoder(content, pattern)
    ids = encode.encode_ordinary("some text " * 900) + [end]
    for r in rows[rows.doc_id == 1].to_dict("records"):
        assert next(training_order.read(str(tmp_path / "out"), r, 1)).tolist() == ids[r["part"] * 512 : r["part"] * 512 + 512]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.removal_digests(empty).count() == 0
    assert fm_dedup.kept_digests(empty).count() == 0
    assert jaccard_join.join(empty).count() == 0
    assert bpe.digests(empty, *bpe.public_vocabulary()).count() == 0
    assert sharding.assign(empty).count() == 0
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), ann.F.col("vec_id") % 20 == 0).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == before.columns, name
        assert docs.count() <= before.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
