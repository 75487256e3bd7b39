"""The log of domain events: typed payloads, rejects with a reason, and events that come once.

A line of the log is JSON: ``event_id``, ``event_type`` and a ``payload`` with the fields of its
type.  The functions take streams and batch tables alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The payload of each event; the first field names what it is about, the last one when it was.
PAYLOADS = {
    "Detected": "source_path string, source_hash string, kind string, layer string, detected_at timestamp",
    "Parsed": "source_path string, document_id string, kind string, front_matter map<string,string>, section_count int, wiki_link_count int, parsed_at timestamp",
    "Indexed": "source_path string, document_id string, kind string, node_id string, edge_count int, embedding_count int, index_level string, duration_ms int, indexed_at timestamp",
    "Stale": "source_path string, document_id string, previous_hash string, current_hash string, detected_at timestamp",
    "Deleted": "source_path string, document_id string, node_id string, edge_count int, embedding_count int, deleted_at timestamp",
    "MergeRequested": "merge_id string, source_manifests array<string>, developer_ids array<string>, target_version string, requested_by string, requested_at timestamp",
    "MergeCompleted": "merge_id string, merged_manifest_id string, source_count int, total_nodes int, total_edges int, total_embeddings int, conflicts_resolved int, duration_ms int, completed_at timestamp",
    "Received": "query_id string, strategy string, query_text string, root_node string, caller string, received_at timestamp",
    "Completed": "query_id string, strategy string, total_results int, top_score double, total_tokens int, duration_ms int, completed_at timestamp",
    "Failed": "query_id string, strategy string, error_code string, error_message string, phase string, duration_ms int, failed_at timestamp",
}
#: Fields that may be null.
OPTIONAL = {"query_text", "root_node"}
ENVELOPE = "event_id string, event_type string, payload string"


def fields(event_type: str) -> list:
    return StructType.fromDDL(PAYLOADS[event_type]).fields


def _fault(event_type: str, payload: Column) -> Column:
    """The first fault of a payload of this type; null if it has none."""
    typed = F.from_json(payload, PAYLOADS[event_type])
    faults = []
    for f in fields(event_type):
        there = F.get_json_object(payload, f"$.{f.name}").isNotNull()
        if f.name not in OPTIONAL:
            faults.append(F.when(~there, F.lit(f"missing {f.name}")))
        faults.append(F.when(there & typed[f.name].isNull(), F.lit(f"wrong type of {f.name}")))
    return F.coalesce(*faults)


def parse_events(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """((event_id, event_type, key, ts, payload), (value, reason)) of the lines of a log.

    ``payload`` stays JSON, see ``payload_of``.  Rejected are lines that aren't a JSON object,
    those without an id, of an unknown type, and those a field of whose payload is missing or of
    a wrong type.  Unknown further fields are kept.
    """
    line = F.col(value)
    rows = lines.select(line.alias("value"), F.from_json(line, ENVELOPE).alias("e"), F.get_json_object(line, "$").alias("object"))
    kind, payload = F.col("e.event_type"), F.col("e.payload")
    fault = F.coalesce(
        F.when(F.col("object").isNull() | ~F.startswith(F.ltrim(F.col("value")), F.lit("{")), "not a JSON object"), F.when(F.col("e.event_id").isNull(), "missing event_id"),
        F.when(~F.coalesce(kind.isin(*PAYLOADS), F.lit(False)), "unknown event_type"), F.when(payload.isNull(), "missing payload"),
        *[F.when(kind == t, _fault(t, payload)) for t in PAYLOADS],
    )
    rows = rows.withColumn("reason", fault)

    def of(at: int) -> list[Column]:
        return [F.when(kind == t, F.from_json(payload, PAYLOADS[t])[fields(t)[at].name]) for t in PAYLOADS]

    good = rows.where("reason IS NULL").select(F.col("e.event_id").alias("event_id"), kind.alias("event_type"), F.coalesce(*of(0)).alias("key"), F.coalesce(*of(-1)).alias("ts"), payload.alias("payload"))
    return good, rows.where("reason IS NOT NULL").select("value", "reason")


def payload_of(events: DataFrame, event_type: str) -> DataFrame:
    """The events of one type with its payload as columns."""
    own = events.where(F.col("event_type") == event_type)
    return own.select("event_id", F.from_json("payload", PAYLOADS[event_type]).alias("p")).select("event_id", "p.*")


def log_lines(events: DataFrame) -> DataFrame:
    """Events as lines of a log, which ``parse_events`` reads back."""
    return events.select(F.concat(F.lit('{"event_id":'), F.to_json(F.array("event_id")).substr(F.lit(2), F.length(F.to_json(F.array("event_id"))) - 2), F.lit(',"event_type":"'), "event_type", F.lit('","payload":'), "payload", F.lit("}")).alias("value"))


def event_rows(payloads: DataFrame, event_type: str, event_id: str = "event_id") -> DataFrame:
    """Rows with the columns of a payload as events of this type."""
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in fields(event_type)]
    first, last = fields(event_type)[0].name, fields(event_type)[-1].name
    return payloads.select(F.col(event_id).alias("event_id"), F.lit(event_type).alias("event_type"), F.col(first).alias("key"), F.col(last).alias("ts"), F.to_json(F.struct(*columns)).alias("payload"))


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each ``event_id`` once; over a stream those that come again within the watermark, which this sets, are dropped."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])
