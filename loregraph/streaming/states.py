"""State machines of documents and queries over event streams, with rejects and timers.

Each key has a state; an event that its machine allows moves it, any other goes to the output
with ``accepted`` false and a reason.  Over a stream events wait in the key's state until the
watermark has passed them, so that those which come late but not too late take their turn by
time; the result is that of the fold over the whole log.  A state with a time limit that no
event ends in time gets a row of its own.

Ties of time are in the order of ``RANK``, then by event id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key string, event_id string, event_type string, ts timestamp, before string, after string, accepted boolean, reason string"
COLUMNS = [c.split(" ")[0] for c in OUTPUT.split(", ")]
#: Order of events of one time.
RANK = ["Detected", "Parsed", "Indexed", "Stale", "Deleted", "Received", "Completed", "Failed"]


@dataclass(frozen=True)
class Machine:
    """``moves``: (state, event) to the next state, the state of a new key being the empty text; ``limits``: seconds after which a state becomes another."""

    moves: dict[tuple[str, str], str]
    limits: dict[str, tuple[int, str]] = field(default_factory=dict)

    def events(self) -> set[str]:
        return {e for _, e in self.moves}


# How events move a document and a query.
DOCUMENT = Machine({("", "Detected"): "detected", ("deleted", "Detected"): "detected", ("detected", "Parsed"): "parsing", ("stale", "Parsed"): "parsing", ("parsing", "Indexed"): "indexed", ("indexed", "Stale"): "stale", ("indexed", "Deleted"): "deleted", ("stale", "Deleted"): "deleted"})
QUERY_MOVES = {("", "Received"): "received", ("received", "Completed"): "completed", ("received", "Failed"): "failed"}


def query_machine(limit: int = 3600) -> Machine:
    """A query that is neither completed nor failed ``limit`` seconds after its receipt is timed out."""
    return Machine(QUERY_MOVES, {"received": (limit, "timed_out")})


class Key:
    """The state of one key: name, since when (milliseconds), and the ids of the events that it took at that time."""

    def __init__(self, machine: Machine, state: str = "", since: int = 0):
        self.machine, self.state, self.since = machine, state, since

    def deadline(self) -> int | None:
        limit = self.machine.limits.get(self.state)
        return None if limit is None else self.since + limit[0] * 1000

    def expire(self, upto: int, key: str) -> Iterator[tuple]:
        """The row of a time limit that ends before ``upto``, if there is one."""
        at = self.deadline()
        if at is not None and at < upto:
            before, self.state = self.state, self.machine.limits[self.state][1]
            self.since = at
            yield (key, None, "TimedOut", pd.Timestamp(at, unit="ms"), before, self.state, True, None)

    def take(self, key: str, event_id: str, event_type: str, ms: int) -> Iterator[tuple]:
        """The rows of one event, which comes after all before."""
        yield from self.expire(ms, key)
        before, after = self.state, self.machine.moves.get((self.state, event_type))
        if after is not None:
            self.state, self.since = after, ms
        reason = None if after is not None else f"{event_type} in state {before or 'new'}"
        yield (key, event_id, event_type, pd.Timestamp(ms, unit="ms"), before, self.state, after is not None, reason)


def place(event: list) -> tuple:
    """The order of (milliseconds, type, id)."""
    ms, kind, name = event
    return (ms, RANK.index(kind) if kind in RANK else len(RANK), name)


def frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS)
    out["ts"] = pd.to_datetime(out["ts"])
    out["accepted"] = out["accepted"].astype(bool)
    return out


def known(events: DataFrame, machine: Machine) -> DataFrame:
    return events.where(F.col("key").isNotNull() & F.col("ts").isNotNull() & F.col("event_type").isin(*sorted(machine.events()))).select("key", "event_id", "event_type", "ts")


def transitions(events: DataFrame, machine: Machine, until: str | None = None) -> DataFrame:
    """Rows of ``OUTPUT`` of a batch table of events: each event's, in order, and those of time limits that end before ``until``.

    Events of other machines, without a key or a time are passed over; of one id the first counts.
    Keys are dealt and sorted, and a task reads them one event after the other.
    """
    end = None if until is None else int(pd.Timestamp(until).timestamp() * 1000)
    rank = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in RANK]), F.col("event_type")), F.lit(0))
    rows = known(events, machine).withColumn("ms", F.unix_millis("ts")).dropDuplicates(["key", "event_id"]).repartition("key").sortWithinPartitions("key", "ms", rank, "event_id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, None
        for batch in batches:
            made: list[tuple] = []
            for key, event_id, kind, ms in zip(batch["key"], batch["event_id"], batch["event_type"], batch["ms"], strict=True):
                if key != now:
                    if held is not None and end is not None:
                        made += held.expire(end, now)
                    now, held = key, Key(machine)
                made += held.take(key, event_id, kind, int(ms))
            yield frame(made)
        if held is not None and end is not None:
            yield frame(list(held.expire(end, now)))

    return rows.select("key", "event_id", "event_type", "ms").mapInPandas(walk, OUTPUT)


def stream_transitions(events: DataFrame, machine: Machine, late: str = "10 minutes") -> DataFrame:
    """``transitions`` over a stream: rows come once the watermark, ``late`` behind the latest event, has passed them.

    An event behind the watermark is rejected as late.  A key's events wait in its state until
    then, so a key holds those of the last ``late`` only.
    """
    rows = known(events, machine).withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, since, text = state.get if state.exists else ("", 0, "[]")
        held, waiting = Key(machine, name, since), [tuple(x) for x in json.loads(text)]
        passed = state.getCurrentWatermarkMs()
        made: list[tuple] = []
        for batch in batches:
            for event_id, kind, ms in zip(batch["event_id"], batch["event_type"], batch["ms"], strict=True):
                if ms < passed:
                    made.append((key[0], event_id, kind, pd.Timestamp(ms, unit="ms"), held.state, held.state, False, "late"))
                elif all(event_id != x[2] for x in waiting):
                    waiting.append((int(ms), kind, event_id))
        waiting.sort(key=place)
        while waiting and waiting[0][0] < passed:
            ms, kind, event_id = waiting.pop(0)
            made += held.take(key[0], event_id, kind, ms)
        made += held.expire(passed, key[0])
        state.update((held.state, held.since, json.dumps(waiting)))
        wake = [x for x in (waiting[0][0] if waiting else None, held.deadline()) if x is not None]
        if wake:
            state.setTimeoutTimestamp(max(min(wake), passed + 1))
        if made:
            yield frame(made)

    return rows.groupBy("key").applyInPandasWithState(step, OUTPUT, "name string, since bigint, waiting string", "append", GroupStateTimeout.EventTimeTimeout)
