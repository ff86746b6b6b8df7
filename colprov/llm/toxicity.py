"""Severity of toxic text by cumulative-link ordinal regression on sparse word features.

One weight vector serves all ordered thresholds: P(grade > k) = sigmoid(w . x - theta_k)
with theta_0 < theta_1 < ...; x marks which words a text holds. The expected severity is
the sum of these probabilities. The model is fitted on a bounded sample: the ``sample``
labelled documents with the smallest id hashes (``SAMPLE`` rows, whatever the corpus),
equal texts once. Features are whole words and the first ``BEGINNINGS`` bytes of words; of
those whose presence goes with a grade above 0 (z score at least ``Z``) the model takes
the ``MOST`` strongest, with weights of 0 or more. Labels that only say whether a text is toxic
make two grades of toxic: those of the sample with more such features than the median
are severe. Every document is scored on its whole text.

Words are runs of ASCII letters and digits and non-ASCII characters in lower case. Labels
without a grade are left out; a document labelled twice counts with its highest grade.
Null and empty texts have no features and get the bare thresholds. Without any labels, or
with labels of one grade only, nothing is known: all probabilities are 0. Rows come back
one for one; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprov.llm.common import BYTE, P, U, mix, prepare, slices
from colprov.llm.decontaminate import read_words
from colprov.session import cut

SAMPLE = 12_000
LEAST_TEXTS = 5
Z = 5.0
MOST = 512
BEGINNINGS = (4, 5, 6)
RIDGE = 2e-5
ROUNDS = 600


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > k) for every row and threshold."""
        return 1 / (1 + np.exp(self.thresholds - eta[:, None]))


def marks(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash) of every word and word beginning of the texts."""
    w, h = read_words(part)
    rows, found = [w.row_of], [h]
    roll, size = np.zeros(len(w), U), w.ends - w.starts
    for k in range(max(BEGINNINGS)):
        at = np.minimum(w.starts + k, max(0, len(w.data) - 1))
        roll = roll * P + (BYTE[w.data[at]] if len(w) else roll)
        if k + 1 in BEGINNINGS:
            long = np.flatnonzero(size > k)
            rows.append(w.row_of[long])
            found.append(mix(roll[long] + U(k)))
    return np.concatenate(rows), np.concatenate(found)


def eta(part: pa.RecordBatch, model: Model) -> np.ndarray:
    """w . x of every row."""
    out, n = np.zeros(part.num_rows), len(model.words)
    if n:
        row, h = marks(part)
        at = np.minimum(np.searchsorted(model.words, h), n - 1)
        hit = np.flatnonzero(model.words[at] == h)
        pair = np.unique(row[hit] * n + at[hit])
        np.add.at(out, pair // n, model.weights[pair % n])
    return out


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows (grade, text) of the bounded sample. ``labels`` has doc_id and grade."""
    best = labels.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    chosen = best.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = chosen.withColumnRenamed("doc_id", "__id")
    joined = docs.join(F.broadcast(chosen), docs["doc_id"] == F.col("__id"))  # at most ``sample`` rows
    rows = joined.select(F.xxhash64("text").alias("t"), "grade", F.lower("text").alias("text")).where("text is not null")
    return rows.dropDuplicates(["t"]).select("grade", "text")


def features(rows: DataFrame) -> DataFrame:
    """Rows (grade, words): the distinct feature hashes of each text."""

    def work(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                row, h = marks(part)
                by = np.argsort(row, kind="stable")
                at = np.searchsorted(row[by], np.arange(part.num_rows + 1))
                lists = [np.unique(h[by[a:b]]).view(np.int64) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([part.column("grade"), pa.array(lists, pa.list_(pa.int64()))], names=["grade", "words"])

    return prepare(rows).mapInArrow(work, "grade int, words array<long>")


def screen(rows: DataFrame, n: int, base: float) -> np.ndarray:
    """The features that go most with grades above 0, counted in Spark; at most ``MOST``, sorted."""
    texts, z = F.col("texts"), (F.col("hits") - F.col("texts") * base) / F.sqrt(F.col("texts") * max(base * (1 - base), 1e-12))
    counts = rows.select((F.col("grade") > 0).cast("int").alias("hit"), F.explode("words").alias("word")).groupBy("word")
    counts = counts.agg(F.count("*").alias("texts"), F.sum("hit").alias("hits")).where(texts >= LEAST_TEXTS).withColumn("z", z)
    best = counts.where(F.col("z") >= Z).orderBy(F.desc("z"), "word").limit(MOST).select("word").collect()
    return np.sort(np.array([r.word for r in best], np.int64).view(U))


def fit(grade: np.ndarray, x: np.ndarray, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the cumulative-link likelihood, by Adam on all rows."""
    n, d = x.shape
    share = np.array([(grade > k).mean() for k in range(grades - 1)]).clip(1 / (n + 2), 1 - 1 / (n + 2))
    start = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    p = np.concatenate([np.zeros(d), start[:1], gaps])
    m, v = np.zeros_like(p), np.zeros_like(p)
    low, high = grade > 0, grade < grades - 1
    for step in range(1, ROUNDS + 1):
        theta = p[d] + np.concatenate([[0], np.cumsum(np.exp(p[d + 1 :]))])
        eta = x @ p[:d]
        s = 1 / (1 + np.exp(np.clip(eta[:, None] - theta, -40, 40)))  # P(grade <= k)
        edge = np.concatenate([np.zeros((n, 1)), s, np.ones((n, 1))], axis=1)
        slope = np.concatenate([np.zeros((n, 1)), s * (1 - s), np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        prob = np.maximum(edge[at, grade + 1] - edge[at, grade], 1e-12)
        up, down = slope[at, grade + 1] / prob, slope[at, grade] / prob
        g_eta = up - down  # of the negative log likelihood
        g_theta = np.zeros(grades - 1)
        np.add.at(g_theta, grade[high], -up[high])
        np.add.at(g_theta, grade[low] - 1, down[low])
        g = np.concatenate([x.T @ g_eta, [g_theta.sum()], [g_theta[k + 1 :].sum() * np.exp(p[d + 1 + k]) for k in range(grades - 2)]]) / n
        g[:d] += RIDGE * p[:d]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        p[:d] = np.maximum(p[:d], 0)
    return p[:d], p[d] + np.concatenate([[0], np.cumsum(np.exp(p[d + 1 :]))])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the bounded sample; the driver sees at most ``sample`` rows of the chosen features."""
    rows = cut(features(labelled(docs, labels, sample)))
    n, base, levels = rows.agg(F.count("*"), F.avg((F.col("grade") > 0).cast("double")), F.count_distinct("grade")).first()
    if levels < 2:
        return Model(np.zeros(0, U), np.zeros(0), np.array([np.inf]))
    known = screen(rows, n, base)
    wanted = F.array(*[F.lit(x) for x in known.view(np.int64).tolist()]).cast("array<long>")
    got = rows.select("grade", F.array_intersect("words", wanted).alias("words")).toPandas()
    grade = got["grade"].to_numpy(np.int64)
    lists = [np.asarray(x, np.int64).view(U) for x in got["words"]]
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    column = np.searchsorted(known, np.concatenate(lists))
    x = np.zeros((len(grade), len(known)), np.float64)
    x[row, column] = 1
    if grade.max() == 1 and len(known):  # labels say only whether: the heavier half is severe
        marked = x.sum(axis=1)
        grade[(grade == 1) & (marked > np.median(marked[grade == 1]))] = 2
    weights, thresholds = fit(grade, x, int(grade.max()) + 1)
    return Model(known, weights, thresholds)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``tid`` of every row with p_toxic, expected_severity and the likeliest grade."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most as many words as the sample has

    def work(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                above = model.above(eta(part, model))
                level = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1)
                grade = np.argmax(level[:, :-1] - level[:, 1:], axis=1)
                columns = [part.column("doc_id"), part.column("tid"), pa.array(above[:, 0]), pa.array(above.sum(axis=1)), pa.array(grade.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tid", "p_toxic", "expected_severity", "grade"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), F.lower("text").alias("text"))
    return prepare(rows).mapInArrow(work, "doc_id long, tid long, p_toxic double, expected_severity double, grade int")


def grades(labels: DataFrame) -> DataFrame:
    """The grades that the driver's labels hold: 0 not toxic, 1 toxic."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("grade"))


def assess(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """Every document's severity, and whether it is toxic at all with probability ``limit`` or more."""
    model = train(docs.select("doc_id", "text"), grades(labels))
    return score(docs, model).drop("tid").withColumn("toxic", F.col("p_toxic") >= limit)


def accepted(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are not toxic, columns unchanged."""
    model = train(docs.select("doc_id", "text"), grades(labels))
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch, "__lower"):
                texts = part.select(["__lower"]).rename_columns(["text"])
                keep = model.above(eta(texts, model))[:, 0] < limit
                yield part.select(names).filter(pa.array(keep))

    return prepare(docs.withColumn("__lower", F.lower("text")).select(*names, "__lower")).mapInArrow(work, docs.schema)
