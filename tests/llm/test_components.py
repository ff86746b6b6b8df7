"""Components of a graph: edges are reduced to stars inside bounded tasks, rounds of joins are for the rest."""

import numpy as np
import pytest

from colprov.llm import chosen_path as cp
from colprov.llm import common


def brute(edges):
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return sorted((i, find(i)) for i in up)


def got(spark, edges):
    return sorted(tuple(r) for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect())


def graph(seed):
    rng = np.random.default_rng(seed)
    name = rng.integers(-(1 << 62), 1 << 62, 400)
    pairs = [(int(name[i]), int(name[j])) for i, j in rng.integers(0, 200, (120, 2)) if i != j]
    return pairs + [(int(name[i]), int(name[i + 1])) for i in range(200, 399)] + pairs[:30]


def test_few_edges_need_no_join(spark, monkeypatch):
    """A group's links all meet in one task; before, every round joined each of them."""
    monkeypatch.setattr(common, "star_rounds", None, raising=False)
    edges = graph(0)
    assert got(spark, edges) == brute(edges)
    dense = [(i, j) for i in range(60) for j in range(i)]
    assert got(spark, dense) == [(i, 0) for i in range(60)]
    assert got(spark, [(1, 1)]) == []


@pytest.mark.parametrize("most", [20, 100])
def test_more_edges_than_a_task_takes(spark, monkeypatch, most):
    monkeypatch.setattr(common, "EDGES", most)
    edges = graph(1)
    assert got(spark, edges) == brute(edges)


def test_members_of_open_nodes_keep_their_component(spark, monkeypatch):
    """Labels are looked up for the members of all rounds once; before, four times in each round."""
    monkeypatch.setattr(cp, "SMALL", 16)
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"o{x}" for x in rng.integers(0, 1 << 30, 30)])) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain, seen = type(docs).join, []

    def join(self, other, on=None, how=None):
        seen.append(isinstance(on, str) and (on, how))
        return plain(self, other, on, how)

    monkeypatch.setattr(type(docs), "join", join)
    assert cp.groups(docs).where("kept").count() == 100
    assert seen.count(("s", "left")) <= 3
