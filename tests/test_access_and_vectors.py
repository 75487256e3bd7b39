"""Access labels, vectors taken over by text, and small functions of the graph and of texts."""

import pytest
from pyspark.sql import functions as F

from loregraph.functions import columns as C
from loregraph.operators import extract as E
from loregraph.operators import graph as G
from loregraph.operators import maintain as M
from loregraph.operators.access import restricted
from loregraph.plans import queries as Q
from loregraph.schema import KINDS, QueryError, embeddable
from loregraph.sources import walkstore as W

EDGES = "edge_seq bigint, from_node string, to_node string, edge_type string, layer_violation boolean, source_file string"
NODES = "id string, kind string, access array<string>, aliases array<string>, fields_text map<string,string>, fields_list map<string,array<string>>"


def index_of(spark, edges, labels=(), names="abcdef"):
    nodes = spark.createDataFrame([(f"Entity:{n}", "entity", dict(labels).get(n, []), [], {"title": f"thing {n}"}, None) for n in names], NODES)
    table = spark.createDataFrame([(i, f"Entity:{a}", f"Entity:{b}", "T", False, "f") for i, (a, b) in enumerate(edges)], EDGES)
    chunks = spark.createDataFrame([(f"{n}:chunk-0", n, [1.0, float(i)]) for i, n in enumerate(names)], "id string, document_id string, vector array<double>")
    return G.load_graph(nodes, table, chunks)


@pytest.mark.parametrize("stored", [False, True])
def test_hidden_nodes_leave_no_trace(spark, tmp_path, stored):
    """a-b-c-d with b hidden: c is reached by the longer way alone; counts, texts, chunks and orphans don't tell of b."""
    edges = [("a", "b"), ("b", "c"), ("a", "e"), ("e", "f"), ("f", "c"), ("b", "zz"), ("d", "zz")]
    index = index_of(spark, edges, [("b", ["secret"]), ("e", ["x", "ops"])])
    if stored:
        index = W.write_store(index, f"file://{tmp_path}/s", buckets=2)
    seen = restricted(index, ["ops"])
    found = {r["node_id"]: r["score"] for r in Q.graph_query(seen, "Entity:a", 3).rows.collect()}
    assert found == {"Entity:e": 1 / 2, "Entity:f": 1 / 3, "Entity:c": 1 / 4}
    plain = index_of(spark, [e for e in edges if "b" not in e], names="acdef")
    for what in ("edges", "orphans", "nodes"):
        assert getattr(seen, what).count() == getattr(plain, what).count()
    assert {r["id"] for r in Q.find_text(seen, "thing").collect()} == {f"Entity:{n}" for n in "acdef"}
    assert {r["document_id"] for r in seen.embeddings.collect()} == set("acdef")
    with pytest.raises(QueryError):
        Q.graph_query(seen, "Entity:b")
    impact = Q.impact_query(seen, "Entity:c").tables["transitive"]
    assert {r["node_id"] for r in impact.collect()} == {"Entity:a", "Entity:e"}
    assert Q.graph_query(restricted(index, ["secret", "ops"]), "Entity:a", 1).rows.count() == 2


def test_only_new_texts_are_encoded(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def encode(text):
        seen.add(1)
        return [float(len(text)), 1.0]

    schema = "id string, document_id string, context_text string"
    stored = spark.createDataFrame([("a:chunk-0", "a", "one", [9.0]), ("a:chunk-1", "a", "two", [8.0]), ("b:chunk-0", "b", "one", [9.0])], schema + ", vector array<double>")
    made = spark.createDataFrame([("a:chunk-0", "a", "new text"), ("a:chunk-1", "a", "one"), ("a:chunk-2", "a", "two"), ("a:chunk-3", "a", "new text"), ("a:chunk-4", "a", None)], schema)
    status = {r["id"]: r["status"] for r in M.chunk_changes(stored, made).collect()}
    assert status == {"a:chunk-0": "new", "a:chunk-1": "moved", "a:chunk-2": "moved", "a:chunk-3": "new", "a:chunk-4": "new", "b:chunk-0": "deleted"}
    found = {r["id"]: r["vector"] for r in M.with_vectors(made.where("context_text IS NOT NULL"), stored, encode).collect()}
    assert found == {"a:chunk-0": [8.0, 1.0], "a:chunk-1": [9.0], "a:chunk-2": [8.0], "a:chunk-3": [8.0, 1.0]}
    assert seen.value == 1
    hashed = [t.withColumn("text_hash", F.sha2("context_text", 256)) for t in (stored, made)]
    assert sorted(r["id"] for r in M.stale_chunks(*hashed).collect()) == ["a:chunk-0", "a:chunk-1", "b:chunk-0"]


def test_apply_diff_takes_over_vectors(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def encode(text):
        seen.add(1)
        return [1.0]

    def index(texts):
        nodes = spark.createDataFrame([(f"Entity:{d}", "entity") for d in {d for d, _ in texts}], "id string, kind string")
        chunks = spark.createDataFrame([(f"{d}:chunk-{i}", d, t) for i, (d, t) in enumerate(texts)], "id string, document_id string, context_text string")
        return G.load_graph(nodes, spark.createDataFrame([], EDGES), chunks)

    before = index([("a", "one"), ("a", "two"), ("b", "three")])
    before.embeddings = before.embeddings.withColumn("vector", F.array(F.length("context_text").cast("double")))
    diff = spark.createDataFrame([("Entity:a", "M")], "id string, status string")
    after = M.apply_diff(before, index([("a", "zero"), ("a", "one")]), diff, encode)
    assert {(r["context_text"], tuple(r["vector"])) for r in after.embeddings.collect()} == {("zero", (1.0,)), ("one", (3.0,)), ("three", (5.0,))}
    assert seen.value == 1


def test_upserts_and_more_edges(spark):
    index = index_of(spark, [("a", "b"), ("a", "zz")])
    new = index.nodes.where("id = 'Entity:a'").withColumn("kind", F.lit("event")).unionByName(index.nodes.where("id = 'Entity:b'").withColumn("id", F.lit("Entity:zz")))
    nodes = G.upsert_nodes(index.nodes, new)
    assert {r["id"]: r["kind"] for r in nodes.collect()} == {**{f"Entity:{n}": "entity" for n in "bcdef"}, "Entity:a": "event", "Entity:zz": "entity"}
    raw = index.edges.unionByName(index.orphans.select(*index.edges.columns))
    more = spark.createDataFrame([(9, "Entity:c", "Entity:d", "T", False, "g"), (9, "Entity:a", "Entity:b", "T", False, "g")], EDGES)
    loaded = G.add_edges(nodes, raw, more)
    assert {(r["from_node"][-1], r["to_node"][-1], r["edge_seq"]) for r in loaded.edges.collect()} == {("a", "b", 0), ("a", "z", 1), ("c", "d", 9)} and loaded.orphans.count() == 0


@pytest.mark.parametrize(
    "code,ask",
    [
        ("NODE_NOT_FOUND", lambda i: Q.coverage_query(i, "Entity:none")), ("QUERY_TOO_SHORT", lambda i: Q.hybrid_query(i, " ab ")), ("QUERY_TOO_SHORT", lambda i: Q.semantic_query(i, [1.0], text="ab")),
        ("EMPTY_HINTS", lambda i: Q.context_query(i, [])), ("UNKNOWN_KIND", lambda i: Q.coverage_query(i, "Entity:a", [("command", "x", "T")])), ("NO_EMBEDDINGS", lambda i: Q.semantic_query(G.load_graph(i.nodes, i.edges), [1.0])),
    ],
)
def test_error_codes(spark, code, ask):
    with pytest.raises(QueryError) as error:
        ask(index_of(spark, [("a", "b")]))
    assert error.value.code == code


def test_levels_and_embedded_headings(spark):
    assert [E.detect_level(*x) for x in ((False, False), (False, True), (True, False), (True, True))] == ["L1", "L1", "L2", "L3"]
    assert sorted(map(tuple, embeddable(spark).collect())) == sorted((k, h) for k, _, _, heads in KINDS for h in heads)
    targets = ["EVT-a", "Order", "UC-1", "EV"]
    rows = spark.createDataFrame([(t,) for t in targets], "t string").select("t", C.is_entity_target(F.col("t")).alias("e")).collect()
    assert {r["t"]: r["e"] for r in rows} == {"EVT-a": False, "Order": True, "UC-1": False, "EV": True}
