"""Snapshot differences, cascading deletes and merges; graph loading and impact on small cases."""

import datetime

import pytest

from loregraph.operators import graph as G
from loregraph.operators import maintain as M
from loregraph.plans import queries as Q
from loregraph.schema import QueryError

NODE = "id string, kind string, layer string, source_hash string, fields_text map<string,string>"
EDGE = "edge_seq bigint, from_node string, to_node string, edge_type string, source_file string, layer_violation boolean"


def nodes(spark, *ids):
    return spark.createDataFrame([(i, i.split(":")[0].lower(), "01-domain", "h", {}) for i in ids], NODE)


def edges(spark, *rows):
    return spark.createDataFrame([(i, a, b, t, "f", False) for i, (a, b, t) in enumerate(rows)], EDGE)


def test_snapshot_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None), ("d", "1")], "id string, source_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("e", "1")], "id string, source_hash string")
    assert dict(map(tuple, M.snapshot_diff(old, new).collect())) == {"a": "unchanged", "b": "M", "c": "unchanged", "d": "D", "e": "A"}
    assert {r["status"] for r in M.snapshot_diff(old.limit(0), new).collect()} == {"A"}
    assert M.snapshot_diff(old.limit(0), new.limit(0)).collect() == []


def test_orphans_and_delete(spark):
    chunks = spark.createDataFrame([("X:chunk-0", "X"), ("Y:chunk-0", "Y")], "id string, document_id string")
    index = G.load_graph(nodes(spark, "E:X", "E:Y"), edges(spark, ("E:X", "E:Y", "L"), ("E:X", "E:Y", "L"), ("E:X", "E:M", "L"), ("E:N", "E:Y", "L"), ("E:N", "E:M", "L")), chunks)
    assert index.edges.count() == 1
    assert sorted(r["reason"] for r in index.orphans.collect()) == ["both_missing", "missing_source", "missing_target"]
    assert Q.orphans_query(index).tables["summary"].first()["rate"] == 75.0
    left = M.cascade_delete(index, spark.createDataFrame([("E:Y",)], "id string"))
    assert [r["id"] for r in left.nodes.collect()] == ["E:X"] and left.edges.count() == 0
    assert [r["id"] for r in left.embeddings.collect()] == ["X:chunk-0"]


def test_apply_diff(spark):
    index = G.load_graph(nodes(spark, "E:X", "E:Y"), edges(spark, ("E:X", "E:Y", "L"), ("E:Y", "E:Z", "L")))
    changed = G.load_graph(nodes(spark, "E:X", "E:Z"), edges(spark, ("E:X", "E:Z", "L")))
    diff = spark.createDataFrame([("E:X", "M"), ("E:Z", "A"), ("E:Y", "unchanged")], "id string, status string")
    after = M.apply_diff(index, changed, diff)
    assert {(r["from_node"], r["to_node"]) for r in after.edges.collect()} == {("E:X", "E:Z"), ("E:Y", "E:Z")}
    assert after.nodes.count() == 3


def test_merge(spark):
    at = lambda m: datetime.datetime(2024, 1, 1, 10, m)
    rows = [("a", "E:P", "abc", at(0)), ("b", "E:P", "xyz", at(15)), ("a", "E:Q", "s", at(0)), ("b", "E:Q", "s", None), ("a", "E:D", "d", at(1))]
    schema = "source string, id string, source_hash string, indexed_at timestamp"
    tombs = spark.createDataFrame([("b", "E:D")], "source string, node_id string")
    found = {r["id"]: (r["source"], r["source_hash"], r["conflict"]) for r in M.merge_nodes(spark.createDataFrame(rows, schema), tombs).collect()}
    assert found == {"E:P": ("b", "xyz", True), "E:Q": ("a", "s", False)}
    joined = edges(spark, ("E:P", "E:Q", "L"), ("E:P", "E:Q", "L"), ("E:P", "E:D", "L"))
    assert M.merge_edges(joined, tombs).count() == 1
    manifest = "version string, index_level string, embedding_model string, structure string"
    chunks = spark.createDataFrame([("P", "a", "1"), ("P", "b", "2")], "document_id string, source string, id string")
    good = spark.createDataFrame([("1.0", "L2", "m", "s"), ("1.1", "L2", "m", "s")], manifest)
    index, metrics = M.merge_indices(spark.createDataFrame(rows, schema), joined, chunks, good, tombs)
    assert tuple(metrics.first()) == (2, 1, 2) and [r["id"] for r in index.embeddings.collect()] == ["2"]
    for bad, code in (([("1.0", "L2", "m", "s")], "INSUFFICIENT_SOURCES"), ([("1.0", "L2", "m", "s"), ("1.0", "L2", "n", "s")], "INCOMPATIBLE_EMBEDDING_MODEL"), ([("1.0", "L1", "m", "s"), ("2.0", "L1", "n", "s")], "INCOMPATIBLE_VERSION")):
        with pytest.raises(QueryError, match=code):
            M.check_manifests(spark.createDataFrame(bad, manifest))
    with pytest.raises(QueryError, match="MERGE_CONFLICT"):
        M.merge_indices(spark.createDataFrame(rows, schema), joined, None, good, fail_on_conflict=True)


def test_impact(spark):
    ids = ("Entity:D", "BR:B", "UC:U", "CMD:C")
    index = G.load_graph(nodes(spark, *ids), edges(spark, ("BR:B", "Entity:D", "ENTITY_RULE"), ("UC:U", "BR:B", "UC_APPLIES_RULE"), ("UC:U", "CMD:C", "UC_EXECUTES_CMD"), ("CMD:C", "Entity:D", "WIKI_LINK")))
    found = Q.impact_query(index, "Entity:D")
    assert {(r["node_id"], r["edge_type"]) for r in found.rows.collect()} == {("BR:B", "ENTITY_RULE"), ("CMD:C", "WIKI_LINK")}
    (far,) = found.tables["transitive"].collect()
    assert (far["node_id"], far["path"]) == ("UC:U", ["Entity:D", "BR:B"])
    with pytest.raises(QueryError, match="NODE_NOT_FOUND"):
        Q.impact_query(index, "Entity:None")
