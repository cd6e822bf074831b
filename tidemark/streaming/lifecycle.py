"""The lifecycle of one contact, keyed by (entityId, actionId, channel).

CREATED until the debounce ends, then IN_PROCESS with a dispatch, then what the provider and the member answer, until a
terminal state or the time to live. The same step function serves the stream (state and event-time timeouts) and its batch
twin, so both decide alike.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.scalars import STATUS_STATES

KEY = ["entityId", "actionId", "channel"]
#: How events of a contact follow each other; the last columns only decide between events of one time.
ORDER = ["ts", "seq", "kind", "raw", "correlationId"]
TERMINAL = {"FAILED", "HARD_COMPLETED", "EXPIRED", "SUPPRESSED", "DEBOUNCED"}
OUTPUT = "entityId string, actionId string, channel string, ts long, state string, op string"
STATE = "state string, deadline long, soft boolean, correlationId string"


@dataclass(frozen=True)
class Config:
    debounce_ms: int = 60_000
    ttl_ms: int = 7 * 86_400_000


@dataclass
class Instance:
    """Where a contact is: ``deadline`` is when its debounce or its time to live ends."""

    state: str = ""
    deadline: int = -1
    soft: bool = False
    correlationId: str = ""

    @property
    def live(self) -> bool:
        return bool(self.state) and self.state not in TERMINAL


Out = tuple[int, str, str | None]


def due(i: Instance, ts: int, cfg: Config) -> list[Out]:
    """What the timers do up to ``ts``: end of debounce, then expiry."""
    out: list[Out] = []
    while i.live and 0 <= i.deadline <= ts:
        at = i.deadline
        if i.state == "CREATED":
            i.state, i.deadline = "IN_PROCESS", at + cfg.ttl_ms
            out.append((at, "IN_PROCESS", "DISPATCH"))
        else:
            i.state, i.deadline = "EXPIRED", -1
            out.append((at, "EXPIRED", None))
    return out


def step(i: Instance, ts: int, kind: str, raw: str | None, correlation: str | None, cfg: Config) -> list[Out]:
    """One event, after what was due before it. Kinds: CREATE, PRE_DISPATCHED, DISPOSITION, SOFT, HARD, SUPPRESS, DEBOUNCE."""
    out = due(i, ts, cfg)

    def to(state: str, op: str | None = None) -> None:
        i.state = state
        if state in TERMINAL:
            i.deadline = -1
        out.append((ts, state, op))

    if kind in ("CREATE", "PRE_DISPATCHED"):
        if not i.live:  # a second create of a live contact is ignored
            i.soft, i.correlationId = False, correlation or ""
            waits = kind == "CREATE"
            i.deadline = ts + (cfg.debounce_ms if waits else cfg.ttl_ms)
            to("CREATED" if waits else "IN_PROCESS")
    elif not i.live:
        pass
    elif kind == "HARD":
        to("HARD_COMPLETED")
    elif kind == "SUPPRESS":
        if i.state == "CREATED":
            to("SUPPRESSED")
        elif i.state != "SUPPRESSING":
            to("SUPPRESSING", "CANCEL")
    elif kind == "DEBOUNCE":
        if i.state == "CREATED":
            to("DEBOUNCED")
    elif i.state == "CREATED":
        pass  # nothing was sent yet
    elif kind == "SOFT":
        if not i.soft:
            i.soft = True
            to("SOFT_COMPLETED")
    elif kind == "DISPOSITION" and (not correlation or correlation == i.correlationId):
        state = STATUS_STATES.get(raw or "", "PRESENTED")
        if state == "SUPPRESS_FAILED":
            if i.state == "SUPPRESSING":
                to("IN_PROCESS")
        elif state == "SUPPRESSED":
            if i.state == "SUPPRESSING":
                to("SUPPRESSED")
        elif state != i.state and not (i.soft and state == "PRESENTED"):
            to(state)
    return out


def _rows(key: tuple, out: Iterable[Out]) -> pd.DataFrame:
    return pd.DataFrame([(*key, *o) for o in out], columns=[*KEY, "ts", "state", "op"])


def _in_order(pdf: pd.DataFrame) -> Iterator:
    return pdf.sort_values(ORDER, na_position="first").itertuples(index=False)


def replay_lifecycle(events: DataFrame, until_ms: int, cfg: Config = Config()) -> DataFrame:  # noqa: B008
    """Batch twin: transitions of every contact. ``events``: KEY, ts, seq (order of equal times, then by content), kind, raw, correlationId.

    Events are dealt by contact and sorted inside partitions, then stepped through as a stream: a task holds one instance at a
    time, whatever the length of a history.
    """
    columns = [*KEY, "ts", "kind", "raw", "correlationId"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, i = None, Instance()
        for pdf in batches:
            found: list[tuple] = []
            for *own, ts, kind, raw, correlation in zip(*(pdf[c] for c in columns), strict=True):
                if own != key:
                    if key is not None:
                        found += [(*key, *o) for o in due(i, until_ms, cfg)]
                    key, i = own, Instance()
                found += [(*own, *o) for o in step(i, ts, kind, raw, correlation, cfg)]
            yield pd.DataFrame(found, columns=[*KEY, "ts", "state", "op"])
        if key is not None:
            yield _rows(tuple(key), due(i, until_ms, cfg))

    dealt = events.repartition(*KEY).sortWithinPartitions(*KEY, *ORDER)
    return dealt.select(columns).mapInPandas(run, OUTPUT)


def stream_lifecycle(events: DataFrame, cfg: Config = Config()) -> DataFrame:  # noqa: B008
    """The same on a stream with a watermark on ``at`` (timestamp of ``ts``): event-time timeouts fire debounce and expiry."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        i = Instance(*state.get) if state.exists else Instance()
        out: list[Out] = []
        if state.hasTimedOut:
            out += due(i, state.getCurrentWatermarkMs(), cfg)
        else:
            rows = [pdf for pdf in batches if len(pdf)]
            for e in _in_order(pd.concat(rows)) if rows else ():
                out += step(i, int(e.ts), e.kind, e.raw, e.correlationId, cfg)
        if i.live:
            state.update((i.state, i.deadline, i.soft, i.correlationId))
            state.setTimeoutTimestamp(max(i.deadline, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield _rows(key, out)

    return events.groupBy(*KEY).applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def lifecycle_events(creates: DataFrame, dispositions: DataFrame, signals: DataFrame) -> DataFrame:
    """The events of a lifecycle from its sources: creates (op CREATE or PRE_DISPATCHED), provider statuses, and other signals (kind)."""
    def shaped(df: DataFrame, kind, raw, seq: int) -> DataFrame:
        return df.select(*KEY, "ts", F.lit(seq).alias("seq"), kind.alias("kind"), raw.cast("string").alias("raw"), "correlationId")

    return shaped(creates, F.col("op"), F.lit(None), 0).unionByName(shaped(dispositions, F.lit("DISPOSITION"), F.col("raw"), 1)).unionByName(shaped(signals, F.col("kind"), F.lit(None), 2))
