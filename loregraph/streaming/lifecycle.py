"""Lifecycle events as streams: the last state of each key, durations, and indexing by batches.

The functions take batch tables too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loregraph.operators.maintain import snapshot_diff

# The state of a document after an event.
STATES = {"Detected": "detected", "Parsed": "parsing", "Indexed": "indexed", "Stale": "stale", "Deleted": "deleted"}


def last_state(events: DataFrame, key: str = "key", order: tuple[str, ...] = ("ts",), value: str = "event_type") -> DataFrame:
    """(key, state, events): the last event's value by ``order`` and how many there were.

    Over a stream use output mode update or complete; the state is one row per key.
    """
    return events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("state"), F.count("*").alias("events"))


def document_states(events: DataFrame, key: str = "key", order: tuple[str, ...] = ("ts",), value: str = "event_type") -> DataFrame:
    """(key, state, events): the state of a document after its last event that is one of ``STATES``; others change nothing."""
    known = events.where(F.col(value).isin(*STATES))
    last = last_state(known, key, order, value)
    return last.select(key, F.coalesce(*[F.when(F.col("state") == e, F.lit(s)) for e, s in STATES.items()]).alias("state"), "events")


def windowed_counts(events: DataFrame, width: str = "1 day", late: str | None = None, time: str = "ts", by: str = "event_type") -> DataFrame:
    """Events by tumbling window and type; ``late`` sets a watermark for streams."""
    if late and events.isStreaming:
        events = events.withWatermark(time, late)
    return events.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def durations(received: DataFrame, completed: DataFrame, within: str = "1 hour") -> DataFrame:
    """Seconds from a query's receipt to its completion: ``(query_id, ts)`` of both, joined within a bound."""
    a = received.select("query_id", F.col("ts").alias("received_at"))
    b = completed.select("query_id", F.col("ts").alias("completed_at"))
    if received.isStreaming:
        a, b = a.withWatermark("received_at", within), b.withWatermark("completed_at", within)
    bound = F.expr(f"completed_at >= received_at AND completed_at <= received_at + INTERVAL {within}")
    joined = a.join(b.withColumnRenamed("query_id", "_id"), (F.col("query_id") == F.col("_id")) & bound).drop("_id")
    return joined.withColumn("seconds", F.unix_micros("completed_at") / 1e6 - F.unix_micros("received_at") / 1e6)


def index_batches(stored: Callable[[], DataFrame | None], apply: Callable[[DataFrame, DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: the batch's snapshot rows that differ from what is stored go to ``apply(changes, batch)``.

    ``stored`` gives None where there is no index yet: all rows are new.  A row without a
    ``source_hash`` says that its document is gone: its change is D, if it is stored.  A batch
    that changes nothing touches nothing, so a repeated one is harmless.
    """

    def run(batch: DataFrame, _: int) -> None:
        before = stored()
        there = batch.where("source_hash IS NOT NULL")
        if before is None:
            changes = there.select("id", F.lit("A").alias("status"))
        else:
            gone = batch.where("source_hash IS NULL").select("id").distinct().join(before.select("id").distinct(), "id", "left_semi")
            changes = snapshot_diff(before, there).where("status IN ('A', 'M')").select("id", "status").unionByName(gone.withColumn("status", F.lit("D")))
        if not changes.isEmpty():
            apply(changes, batch)

    return run
