"""Common members of pairs: a hub's pairs are dealt over tasks, and each pair is counted once."""

from pyspark.sql import functions as F

from colprov.llm import jaccard_join as J


def test_a_hub_with_many_pairs(spark, monkeypatch):
    monkeypatch.setattr(J, "PARTNERS", 4)
    base = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(base[: 30 + i] + [f"own{i}"] * (i % 3)) for i in range(20)}
    rows = [(i, t) for i, t in texts.items()] + [(7, texts[7]), (100, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = J.summaries(docs, 4).select("s", "doc_id", "n_shingles")
    classes = sets.groupBy("s").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").cast("int").alias("size"))
    name = {r["doc_id"]: r["s"] for r in classes.collect()}
    hub = name[0]
    pairs = spark.createDataFrame([(s, hub) for i, s in name.items() if i] + [(name[5], name[6])], "a long, b long")
    got = {(r["a"], r["b"]): r["common"] for r in J.overlaps(docs, pairs, classes, 4, 8).collect()}

    def grams(i):
        w = texts[i].split()
        return {tuple(w[j : j + 4]) for j in range(len(w) - 3)}

    want = {(s, hub): len(grams(i) & grams(0)) for i, s in name.items() if i} | {(name[5], name[6]): len(grams(5) & grams(6))}
    assert got == want and len(want) == 20
