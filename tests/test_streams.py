"""Typed events, state machines over streams against the fold of the whole log, and batches of an index."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from loregraph.streaming import events as V
from loregraph.streaming import lifecycle as L
from loregraph.streaming import states as S

AT = datetime.datetime(2024, 1, 1)
SCHEMA = "key string, event_id string, event_type string, ts timestamp"


def at(minutes):
    return AT + datetime.timedelta(minutes=minutes)


def payload(kind, **changed):
    made = {"string": "x", "int": 3, "double": 0.5, "timestamp": "2024-01-01T00:00:00Z", "array<string>": ["a"], "map<string,string>": {"a": "b"}}
    return {f.name: made[f.dataType.simpleString()] for f in V.fields(kind)} | changed


def test_every_type_round_trips_and_bad_lines_are_rejected(spark):
    good = [json.dumps({"event_id": f'e"{k}', "event_type": k, "payload": payload(k)}) for k in V.PAYLOADS]
    good.append(json.dumps({"event_id": "n", "event_type": "Received", "payload": payload("Received", query_text=None, more=1)}))
    bad = {
        "{oops": "not a JSON object", "[1]": "not a JSON object", "": "not a JSON object", '{"event_type":"Parsed"}': "missing event_id",
        '{"event_id":"1","event_type":"Other","payload":{}}': "unknown event_type", '{"event_id":"1","event_type":"Stale"}': "missing payload",
        json.dumps({"event_id": "1", "event_type": "Parsed", "payload": payload("Parsed", section_count="many")}): "wrong type of section_count",
        json.dumps({"event_id": "1", "event_type": "Failed", "payload": payload("Failed", phase=None)}): "missing phase",
        json.dumps({"event_id": "1", "event_type": "Detected", "payload": payload("Detected", detected_at="soon")}): "wrong type of detected_at",
    }
    lines = spark.createDataFrame([(x,) for x in [*good, *bad]], "value string")
    events, rejects = V.parse_events(lines)
    assert {r["value"]: r["reason"] for r in rejects.collect()} == bad
    again, none = V.parse_events(V.log_lines(events))
    order = lambda df: sorted(map(tuple, df.collect()))
    assert order(again) == order(events) and none.count() == 0 and events.count() == len(good)
    assert {(r["key"], r["ts"]) for r in events.collect()} == {("x", AT)}
    indexed = V.payload_of(events, "Indexed")
    assert indexed.first().asDict() == {"event_id": 'e"Indexed', "source_path": "x", "document_id": "x", "kind": "x", "node_id": "x", "edge_count": 3, "embedding_count": 3, "index_level": "x", "duration_ms": 3, "indexed_at": AT}
    made = V.event_rows(indexed, "Indexed")
    assert order(V.payload_of(made, "Indexed")) == order(indexed)
    assert V.once(events.unionByName(events)).count() == len(good)


def rows(df):
    return sorted((tuple(r) for r in df.select("key", "event_id", "event_type", "before", "after", "accepted", "reason").collect()), key=repr)


def test_moves_of_documents_and_queries(spark):
    log = [("a", "1", "Detected", at(0)), ("a", "2", "Indexed", at(1)), ("a", "3", "Parsed", at(2)), ("a", "3", "Parsed", at(2)), ("a", "4", "Indexed", at(3)), ("a", "5", "Deleted", at(4)), ("a", "6", "Detected", at(5)), (None, "7", "Detected", at(5))]
    found = rows(S.transitions(spark.createDataFrame(log, SCHEMA), S.DOCUMENT))
    assert [(r[1], r[4], r[5]) for r in found] == [("1", "detected", True), ("2", "detected", False), ("3", "parsing", True), ("4", "indexed", True), ("5", "deleted", True), ("6", "detected", True)]
    assert found[1][6] == "Indexed in state detected"
    asked = [("q", "1", "Received", at(0)), ("q", "2", "Completed", at(30)), ("r", "3", "Received", at(0)), ("r", "4", "Failed", at(61)), ("s", "5", "Received", at(0))]
    found = rows(S.transitions(spark.createDataFrame(asked, SCHEMA), S.query_machine(), until="2024-01-02"))
    assert [(r[0], r[2], r[4], r[5]) for r in found if r[0] != "q"] == [("r", "Received", "received", True), ("r", "Failed", "timed_out", False), ("r", "TimedOut", "timed_out", True), ("s", "Received", "received", True), ("s", "TimedOut", "timed_out", True)]


@pytest.mark.parametrize("machine", ["document", "query"])
def test_stream_equals_the_fold(spark, tmp_path, machine):
    """Events in three batches, out of order within the allowed time, repeated and illegal; a later event of another key ends the wait."""
    rng = random.Random(2)
    machine = S.DOCUMENT if machine == "document" else S.query_machine(600)
    kinds = sorted(machine.events())
    log = [(f"k{rng.randrange(6)}", f"e{i:03d}", rng.choice(kinds), at(i // 3)) for i in range(90)]
    first = {"Detected", "Received"} & set(kinds)
    log += [(f"k{k}", f"s{k}", first.copy().pop(), at(0)) for k in range(6)]
    end = ("zz", "end", first.copy().pop(), at(10_000))
    log.sort(key=lambda e: e[3])
    batches = [log[i : i + 32] for i in range(0, len(log), 32)]
    for b in batches[:-1]:  # some come with the batch after theirs, less than the allowed time late
        late = [e for e in b[-6:] if rng.random() < 0.5]
        for e in late:
            b.remove(e)
        batches[batches.index(b) + 1][:0] = late
    batches[1] += batches[1][:2]
    stream_dir = str(tmp_path / "in")
    for i, b in enumerate([*batches, [end]]):
        rng.shuffle(b)
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(stream_dir)
        stream = spark.readStream.schema(SCHEMA).parquet(stream_dir)
        query = S.stream_transitions(stream, machine, "30 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out")).where("key <> 'zz'")
    want = S.transitions(spark.createDataFrame(log, SCHEMA), machine, until=str(at(9_970)))
    assert found.where("reason = 'late'").count() == 0
    assert rows(found) == rows(want) and len(rows(want)) >= 96


def test_first_run_and_deletes(spark):
    applied = []
    apply = lambda changes, batch: applied.append(sorted(map(tuple, changes.collect())))
    schema = "id string, source_hash string"
    batch = spark.createDataFrame([("a", "1"), ("b", None), ("c", "2")], schema)
    L.index_batches(lambda: None, apply)(batch, 0)
    L.index_batches(lambda: spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], schema), apply)(batch, 1)
    L.index_batches(lambda: spark.createDataFrame([("a", "1"), ("c", "2")], schema), apply)(batch, 2)
    assert applied == [[("a", "A"), ("c", "A")], [("b", "D"), ("c", "M")]]


def test_times_are_kept(spark):
    log = spark.createDataFrame([("a", "1", "Detected", at(7))], SCHEMA)
    assert S.transitions(log, S.DOCUMENT).select(F.unix_millis("ts")).first()[0] == log.select(F.unix_millis("ts")).first()[0]
