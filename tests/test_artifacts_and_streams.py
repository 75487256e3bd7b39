"""An index written and read again; Markdown files; lifecycle streams."""

import datetime
import json

import pytest

from loregraph.operators import extract as E
from loregraph.operators import maintain as M
from loregraph.operators import parse as P
from loregraph.operators import vector as V
from loregraph.plans import queries as Q
from loregraph.sources import artifacts as A
from loregraph.streaming import lifecycle as L
from loregraph.schema import QueryError

PAGE = "---\nkind: entity\n---\n# P\n## Description\nText of [[Q]].\n"


def test_round_trip(spark, tmp_path):
    folder = tmp_path / "specs" / "01-domain" / "entities"
    folder.mkdir(parents=True)
    (folder / "P.md").write_text(PAGE)
    (folder / "Q.md").write_text(PAGE.replace("[[Q]]", "[[Nowhere]]"))
    (folder / "ignored.txt").write_text("x")
    index, skipped = E.index_documents(A.read_markdown(spark, str(tmp_path / "specs")))
    assert skipped.count() == 0
    out = str(tmp_path / "index")
    A.write_index(index, out)
    again = A.read_index(spark, out)
    assert {r["id"] for r in again.nodes.collect()} == {"Entity:P", "Entity:Q"}
    assert again.edges.count() == 1 and again.orphans.count() == 1 and again.embeddings is None
    with pytest.raises(QueryError, match="INDEX_NOT_FOUND"):
        A.read_index(spark, str(tmp_path / "none"))


def test_versions(spark, tmp_path):
    """An index is read, changed and written to its own folder; half a version doesn't count."""
    out = str(tmp_path / "index")
    files = spark.createDataFrame([(f"specs/01-domain/entities/{n}.md", PAGE.replace("kind: entity", f"kind: entity\ndomain: {d}")) for n, d in (("P", "core"), ("Q", "auth"))], "path string, content string")
    encode = V.hashing_encoder()
    made = E.index_documents(files)[0]
    made.embeddings = V.encode(E.chunks_of(P.parse_documents(files)[0]), encode)
    assert A.write_index(made, out) == 1
    first = A.read_index(spark, out)
    row = first.manifest.first()
    assert (row["index_level"], row["nodes"], row["edges"], row["embeddings"], row["domains"], row["structure"]) == ("L2", 2, 2, 2, ["auth", "core"], "multi-domain")
    assert {r["document_kind"] for r in first.embeddings.collect()} == {"entity"} and A.read_index(spark, out, with_vectors=False).embeddings is None
    left = M.cascade_delete(first, spark.createDataFrame([("Entity:Q",)], "id string"))
    assert A.write_index(left, out) == 2
    assert [r["id"] for r in A.read_index(spark, out).nodes.collect()] == ["Entity:P"]
    assert A.write_index(A.clear_edges(A.read_index(spark, out)), out) == 3
    assert A.versions(spark, out) == [2, 3] and A.read_index(spark, out).edges.count() == 0
    (tmp_path / "index" / "version=4" / "nodes").mkdir(parents=True)
    assert A.read_index(spark, out).manifest.first()["edges"] == 0


def test_kinds_are_replaced_one_by_one(spark, tmp_path):
    rows = spark.createDataFrame([("E:a", "entity"), ("R:b", "rule")], "id string, kind string")
    A.write_nodes(rows, str(tmp_path / "n"))
    A.write_nodes(spark.createDataFrame([("E:c", "entity")], rows.schema), str(tmp_path / "n"))
    assert {r["id"] for r in spark.read.parquet(str(tmp_path / "n")).collect()} == {"E:c", "R:b"}


def test_json_index(spark, tmp_path):
    (tmp_path / "nodes" / "entity").mkdir(parents=True)
    (tmp_path / "edges").mkdir()
    for name in ("A", "B"):
        (tmp_path / "nodes" / "entity" / f"{name}.json").write_text(json.dumps({"id": f"Entity:{name}", "kind": "entity"}, indent=2))
    edge = json.dumps({"from_node": "Entity:A", "to_node": "Entity:B", "edge_type": "WIKI_LINK"})
    (tmp_path / "edges" / "edges.jsonl").write_text(f"{edge}\n\n{edge}\n")
    (tmp_path / "manifest.json").write_text(json.dumps({"version": "1.0", "embeddings": 0}, indent=2))
    index = A.read_json_index(spark, str(tmp_path))
    assert index.nodes.count() == 2 and index.edges.count() == 1 and index.embeddings is None


def test_states_as_a_stream(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = [("a", "Detected", at(0)), ("a", "Indexed", at(5)), ("b", "Detected", at(1)), ("a", "Parsed", at(3))]
    events = spark.createDataFrame(rows, "key string, event_type string, ts timestamp")
    want = {("a", "Indexed", 3), ("b", "Detected", 1)}
    assert set(map(tuple, L.last_state(events).collect())) == want
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = L.last_state(stream).writeStream.format("memory").queryName("states").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert set(map(tuple, spark.table("states").collect())) == want
    ends = spark.createDataFrame([("q", at(0)), ("r", at(0))], "query_id string, ts timestamp")
    done = spark.createDataFrame([("q", at(2))], "query_id string, ts timestamp")
    assert [(r["query_id"], r["seconds"]) for r in L.durations(ends, done).collect()] == [("q", 120.0)]


def test_document_states(spark):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = [("a", "Detected", at(0)), ("a", "Parsed", at(1)), ("b", "Indexed", at(2)), ("b", "Stale", at(4)), ("b", "Opened", at(9)), ("c", "Deleted", at(3))]
    events = spark.createDataFrame(rows, "key string, event_type string, ts timestamp")
    assert set(map(tuple, L.document_states(events).collect())) == {("a", "parsing", 2), ("b", "stale", 2), ("c", "deleted", 1)}


def test_durations_of_two_streams(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = {"received": [("q", at(0)), ("r", at(0)), ("s", at(1))], "completed": [("q", at(2)), ("s", at(50)), ("t", at(3))]}
    streams = []
    for name, part in rows.items():
        spark.createDataFrame(part, "query_id string, ts timestamp").write.parquet(str(tmp_path / name))
        streams.append(spark.readStream.schema("query_id string, ts timestamp").parquet(str(tmp_path / name)))
    query = L.durations(*streams, within="30 minutes").writeStream.format("memory").queryName("durations").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert [(r["query_id"], r["seconds"]) for r in spark.table("durations").collect()] == [("q", 120.0)]


def test_batches_of_a_stream_are_indexed(spark, tmp_path):
    """Snapshots come as files; each batch's changes go into the stored index; an equal snapshot touches nothing."""
    schema = "id string, source_hash string"
    spark.createDataFrame([("a", "1"), ("b", "1")], schema).write.parquet(str(tmp_path / "stored"))
    applied = []

    def apply(changes, batch):
        applied.append(sorted(map(tuple, changes.collect())))
        kept = [tuple(r) for r in spark.read.parquet(str(tmp_path / "stored")).join(changes, "id", "left_anti").collect()]
        new = [tuple(r) for r in batch.join(changes, "id", "left_semi").collect()]
        spark.createDataFrame(kept + new, schema).write.mode("overwrite").parquet(str(tmp_path / "stored"))

    run = L.index_batches(lambda: spark.read.parquet(str(tmp_path / "stored")), apply)
    for i, rows in enumerate(([("a", "1"), ("b", "1")], [("a", "2"), ("b", "1"), ("c", "1")], [("a", "2"), ("c", "1")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = stream.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        assert len(applied) == (0, 1, 1)[i]
    assert applied == [[("a", "M"), ("c", "A")]]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "stored")).collect())) == [("a", "2"), ("b", "1"), ("c", "1")]


def test_batches_apply_changes_only(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "1")], "id string, source_hash string")
    seen = []
    run = L.index_batches(lambda: stored, lambda changes, _: seen.append(sorted(map(tuple, changes.collect()))))
    run(spark.createDataFrame([("a", "1")], stored.schema), 0)
    run(spark.createDataFrame([("a", "2"), ("c", "1")], stored.schema), 1)
    assert seen == [[("a", "M"), ("c", "A")]]


def test_strict_arguments():
    Q.validate(depth=1, limit=100, min_score=1.0, edge_types=["WIKI_LINK", "contiene"])
    for code, bad in (("DEPTH", {"depth": 6}), ("LIMIT", {"limit": 0}), ("SCORE_RANGE", {"min_score": 1.1}), ("EDGE_TYPE", {"edge_types": ["NO_SUCH"]})):
        with pytest.raises(QueryError, match=f"INVALID_{code}"):
            Q.validate(**bad)


def test_retrieval_quality(spark):
    hits = spark.createDataFrame([(1, True), (1, False), (2, True), (3, False)], "query_id int, relevant boolean")
    asked = spark.createDataFrame([(1, "graph", 1.0), (2, "graph", 3.0), (3, "hybrid", 2.0), (4, "hybrid", 2.0)], "query_id int, strategy string, seconds double")
    found = {r["strategy"]: (r["queries"], r["precision"], round(r["p95_seconds"], 6)) for r in Q.retrieval_quality(hits, asked).collect()}
    assert found == {"graph": (2, 0.75, 2.9), "hybrid": (2, 0.0, 2.0)}
