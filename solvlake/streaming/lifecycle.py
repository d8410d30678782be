"""The life cycle of submitted requests as a stateful stream: submitted, in progress, and then ended, errored or timed out.

Events arrive as files of JSON lines, one for each thing that was observed: a request was submitted, a poll
found it in progress or being cancelled, its result or its error came. Each request has a state of its own,
which survives restarts in the stream's checkpoint. Every change of state is a row of the transitions, a
Parquet table that the stream appends to exactly once; the last transition of a request says how it stands.
Spark keeps the states of requests in groups, which a hash deals.

A request whose result is not there by its deadline is timed out, as soon as the events' watermark has passed
it. A result that comes later still counts, as late. What comes before its request waits for it. Repeated
events change nothing, and a result that has come is never replaced.

Whether a result is late follows from its own time and not from when a timer fires, so that the final states
do not depend on how events are dealt to micro-batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "batch_id string, custom_id string, kind string, at timestamp, text string"
KINDS = ("submitted", "in_progress", "canceling", "result", "error")
#: The API answers within a day.
DEADLINE = timedelta(hours=24)
#: Events may be observed in another order by as much.
DISORDER = "10 minutes"
KEY = ["batch_id", "custom_id"]
TRANSITION = "batch_id string, custom_id string, n long, status string, at timestamp, text string, error string"
NO_RESULT = "no result returned"
#: Requests are dealt to so many groups by their keys' hash, each with its requests' states in one row, since a call
#: into Python for every request (6 ms) would take nearly all the time. Fixed in a checkpoint.
GROUPS = 1 << 14
#: An object of JSON: batch and request to number of transitions, status, deadline, and the early answer's kind, time
#: and text. Times are microseconds inside, which no session's time zone moves.
_STATE = "held string"
_MOVED = "batch_id string, custom_id string, n long, status string, us long, text string, error string"
#: States in which an answer has come.
DONE = ("ended", "ended_late", "errored")
_OPEN = ("submitted", "in_progress", "canceling")
_RANK = {k: i for i, k in enumerate(KINDS)}


def _answered(kind: str, us: int, text: str | None, deadline: int) -> list[tuple]:
    """The transitions of an answer: status, time, text, error."""
    if kind == "error":
        return [("errored", us, None, text)]
    if us > deadline:
        return [("timed_out", deadline, None, NO_RESULT), ("ended_late", us, text, None)]
    return [("ended", us, text, None)]


def _ordered(rows: Iterator[pd.DataFrame]) -> dict[str, list[tuple]]:
    """The events of known kinds by request: time, rank, whether there is a text, text, kind, in this order."""
    found: dict[str, list[tuple]] = {}
    for part in rows:
        for batch, custom, kind, us, text in zip(*[part[c].tolist() for c in (*KEY, "kind", "us", "text")], strict=True):
            if kind in _RANK:
                told = isinstance(text, str)
                found.setdefault(json.dumps([batch, custom]), []).append((int(us), _RANK[kind], told, text if told else "", kind))
    return {k: sorted(v) for k, v in found.items()}


def _moved(held: list | None, events: list[tuple], within: int) -> tuple[list, list[tuple]]:
    """A request's state after its new events, and the transitions they cause."""
    n, status, deadline, *early = held or (0, None, None, None, None, None)
    told: list[tuple] = []
    for us, _, has_text, text, kind in events:
        text = text if has_text else None
        new: list[tuple] = []
        if kind == "submitted":
            if deadline is not None:
                continue
            deadline = us + within
            new = [("submitted", us, None, None)]
            if early[0]:
                new += _answered(*early, deadline)
                early = [None, None, None]
        elif kind in ("result", "error"):
            if deadline is None:
                early = early if early[0] else [kind, us, text]
            elif status not in DONE:
                new = _answered(kind, us, text, deadline)
                new = new[1:] if len(new) > 1 and status == "timed_out" else new
        elif status in _OPEN and status != kind:
            new = [(kind, us, None, None)]
        told += new
        status = told[-1][0] if told else status
    return [n + len(told), status, deadline, *early], told


def _follower(within: int):
    """What happens to a group of requests: new events, and deadlines that the watermark has passed."""

    def move(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        now = state.getCurrentWatermarkMs()
        made: list[tuple] = []

        def put(k: str, after: list, told: list[tuple]) -> None:
            held[k] = after
            made.extend((*json.loads(k), after[0] - len(told) + i, *t) for i, t in enumerate(told, 1))

        for k, events in ({} if state.hasTimedOut else _ordered(rows)).items():
            put(k, *_moved(held.get(k), events, within))
        for k, (n, status, deadline, *early) in list(held.items()):
            if status in _OPEN and deadline // 1000 < now:
                put(k, [n + 1, "timed_out", deadline, *early], [("timed_out", deadline, None, NO_RESULT)])
        state.update((json.dumps(held),))
        waiting = [deadline // 1000 for _, status, deadline, *_ in held.values() if status in _OPEN]
        if waiting:
            state.setTimeoutTimestamp(max(min(waiting), now + 1))
        if made:
            yield pd.DataFrame(made, columns=["batch_id", "custom_id", "n", "status", "us", "text", "error"])

    return move


def follow(spark: SparkSession, events: str, transitions: str, checkpoint: str, deadline: timedelta = DEADLINE, per_batch: int = 1000) -> None:
    """Takes in all event files that are new, appends the transitions they cause, and stops. Restarts go on from the
    checkpoint."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # keeps states on disk
    try:
        said = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", str(per_batch)).json(events)
        known = said.filter(F.col("batch_id").isNotNull() & F.col("custom_id").isNotNull() & F.col("at").isNotNull()).withWatermark("at", DISORDER)
        dated = known.select(F.pmod(F.xxhash64(*KEY), F.lit(GROUPS)).alias("group"), *KEY, "kind", "at", F.unix_micros("at").alias("us"), "text")
        moved = dated.groupBy("group").applyInPandasWithState(_follower(deadline // timedelta(microseconds=1)), _MOVED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
        query = moved.select(*KEY, "n", "status", F.timestamp_micros("us").alias("at"), "text", "error").writeStream.format("parquet").outputMode("append").option("path", transitions).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)


def standing(transitions: DataFrame) -> DataFrame:
    """batch_id, custom_id and the last transition of each request."""
    last = transitions.groupBy(*KEY).agg(F.max_by(F.struct("n", "status", "at", "text", "error"), "n").alias("t"))
    return last.select(*KEY, "t.*")


def submit(requests: DataFrame, path: str) -> None:
    """Writes requests (batch_id, custom_id, at) as events."""
    record(requests.withColumns({"kind": F.lit("submitted"), "text": F.lit(None).cast("string")}), path)


def record(events: DataFrame, path: str) -> None:
    """Adds events to the folder that the stream reads."""
    events.select("batch_id", "custom_id", "kind", "at", "text").write.mode("append").json(path)


def responses(transitions: DataFrame) -> DataFrame:
    """custom_id, raw_text, error of the requests that are over, for the parser: those without a text have an error."""
    return standing(transitions).filter(F.col("status").isin(*DONE, "timed_out")).select("batch_id", "custom_id", F.col("text").alias("raw_text"), "error")
