"""A queue of tasks that clients lease, answer or lose, and request counters, as batch replays and as streams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEASE_MS = 600_000
SCHEMA = "task_id string, state string, leases long, lease_until long"


def replay(events: Iterable[tuple[int, str, int | None]], state: str = "absent", leases: int = 0, until: int = 0) -> tuple[str, int, int]:
    """State, number of leases and deadline of a task after its events (ms, operation, lease ms) in order.

    add waits; lease takes a waiting task, or one whose lease has run out; submit_ok answers a leased task in time; submit_bad
    renews its lease; release puts it back; cancel drops it. Deadlines are looked at when something happens.
    """
    for ms, op, length in events:
        if state == "leased" and ms >= until:
            state = "waiting"
        if op == "add" and state == "absent":
            state = "waiting"
        elif op == "lease" and state == "waiting":
            state, leases, until = "leased", leases + 1, ms + (length or LEASE_MS)
        elif op == "submit_ok" and state == "leased":
            state = "answered"
        elif op == "submit_bad" and state == "leased":
            until = ms + (length or LEASE_MS)
        elif op == "release" and state == "leased":
            state = "waiting"
        elif op == "cancel" and state in ("waiting", "leased"):
            state = "dropped"
    return state, leases, until


def final_states(events: DataFrame) -> DataFrame:
    """(task_id, state, leases, lease_until) of events (task_id, ms, op, lease_ms); a task's events are one group."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ms", "op"])
        lengths = [None if pd.isna(x) else int(x) for x in pdf["lease_ms"]]
        return pd.DataFrame([(pdf["task_id"].iloc[0], *replay(zip(pdf["ms"].tolist(), pdf["op"].tolist(), lengths)))], columns=["task_id", "state", "leases", "lease_until"])

    return events.groupBy("task_id").applyInPandas(one, SCHEMA)


def stream_states(events: DataFrame) -> DataFrame:
    """The same on a stream, in update mode: the state of every task that a batch of events touches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = held.get if held.exists else ("absent", 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ms", "op"])
        lengths = [None if pd.isna(x) else int(x) for x in rows["lease_ms"]]
        state = replay(zip(rows["ms"].tolist(), rows["op"].tolist(), lengths), *state)
        held.update(state)
        yield pd.DataFrame([(key[0], *state)], columns=["task_id", "state", "leases", "lease_until"])

    return events.groupBy("task_id").applyInPandasWithState(step, SCHEMA, "state string, leases long, until long", "update", "NoTimeout")


def daily_counts(events: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """(key, day, n): requests of each UTC day, as a stream that drops what is later than `late`."""
    return events.withWatermark(ts, late).groupBy(key, F.window(ts, "1 day")).agg(F.count("*").alias("n")).select(key, F.to_date("window.start").alias("day"), "n")
