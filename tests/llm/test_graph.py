"""Components against a union-find."""

import random

import pytest

from tidemark.llm.graph import connected_components, joined_components
from tidemark.llm.storage import Scratch


def smallest(edges):
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {x: find(x) for x in label}


def frame(spark, edges):
    return spark.createDataFrame(edges, "a long, b long")


CASES = {
    "random": [(random.Random(k).randint(0, 60), random.Random(k + 1000).randint(0, 60)) for k in range(45)],
    "chain": [(k, k + 1) for k in range(33)],
    "backward chain": [(40 - k, 41 - k) for k in range(30)],
    "star with a large centre": [(99, k) for k in range(20)],
    "two stars that touch": [(1, k) for k in range(10, 20)] + [(2, k) for k in range(19, 30)],
    "repeated": [(1, 2), (2, 1), (1, 2)],
}


@pytest.mark.parametrize("name", CASES)
def test_components(spark, name):
    edges = [e for e in CASES[name] if e[0] != e[1]]
    got = connected_components(frame(spark, CASES[name]), Scratch(spark, "test"))
    assert sorted((r.node, r.component) for r in got.collect()) == sorted(smallest(edges).items())


def test_nulls_loops_and_nothing(spark):
    got = connected_components(frame(spark, [(1, None), (None, 2), (3, 3), (None, None), (5, 4)]), Scratch(spark, "test"))
    assert sorted((r.node, r.component) for r in got.collect()) == [(4, 4), (5, 4)]
    assert connected_components(frame(spark, []), Scratch(spark, "test")).count() == 0


def test_further_links_join_components(spark):
    scratch = Scratch(spark, "test")
    first, more = [(5, 6), (6, 7), (10, 11), (20, 21)], [(7, 11), (30, 31), (31, 3), (21, 40)]
    one = scratch.save(connected_components(frame(spark, first), scratch))
    got = joined_components(one, frame(spark, more), scratch)
    assert sorted((r.node, r.component) for r in got.collect()) == sorted(smallest(first + more).items())
    assert sorted(map(tuple, joined_components(one, frame(spark, []), scratch).collect())) == sorted(smallest(first).items())
