"""Communities on planted partitions and odd graphs."""

import random

import pytest

from loregraph.operators.communities import communities, connected_parts, modularity_of, undirected


def table(spark, edges):
    return spark.createDataFrame([(a, b, "T") for a, b in edges], "from_node string, to_node string, edge_type string")


def plain_modularity(edges, named):
    m = len(edges)
    inside, ends = {}, {}
    for a, b in edges:
        inside[named[a]] = inside.get(named[a], 0) + (named[a] == named[b])
        for x in (a, b):
            ends[named[x]] = ends.get(named[x], 0) + 1
    return sum(inside.get(c, 0) / m - (ends[c] / (2 * m)) ** 2 for c in ends)


def test_planted_partition(spark):
    rng = random.Random(4)
    group = {f"n{i:02d}": i // 12 for i in range(48)}
    nodes = sorted(group)
    edges = [(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if rng.random() < (0.7 if group[a] == group[b] else 0.02)]
    found = communities(table(spark, edges))
    named = {r["id"]: r["community"] for r in found.rows.collect()}
    assert set(named) == {x for e in edges for x in e}
    planted = {n: min(m for m in nodes if group[m] == group[n]) for n in nodes}
    assert named == {n: planted[n] for n in named}
    assert all(a <= b + 1e-12 for a, b in zip(found.history, found.history[1:]))
    assert found.modularity == pytest.approx(plain_modularity(edges, named)) == pytest.approx(found.history[-1])


def test_parts_are_connected(spark):
    """A community of two halves without an edge between them falls apart; a long path stays whole."""
    path = [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(30)]
    edges = [("a", "b"), ("c", "d"), ("b", "x")]
    links = undirected(table(spark, edges + path))
    names = {n: "one" for n in "abcd"} | {"x": "two"} | {f"p{i:02d}": "path" for i in range(31)}
    named = spark.createDataFrame(sorted(names.items()), "id string, community string")
    parts = {r["id"]: r["community"] for r in connected_parts(links, named).collect()}
    assert parts == {"a": "a", "b": "a", "c": "c", "d": "c", "x": "x"} | {f"p{i:02d}": "p00" for i in range(31)}
    whole = 2.0 * len(edges + path)
    split = spark.createDataFrame(sorted(parts.items()), "id string, community string")
    assert modularity_of(links, split, whole) >= modularity_of(links, named, whole)


def test_no_edges(spark):
    found = communities(table(spark, []))
    assert found.rows.collect() == [] and found.modularity == 0.0
