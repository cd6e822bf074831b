"""Sibling debounce as a stream: one member's contacts compete before any of them is sent.

A CREATE waits for its debounce; when that is over, it loses to a sibling that reached the member or that was created with a
better score, waits for one that is on its way, and else is sent. The state is a map from contact to what is known of it, the deadlines
are event-time timers. The batch twin steps through sorted events with the same functions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

REACHED, BUSY = ("PRESENTED", "DECLINED"), ("IN_PROCESS", "SUPPRESSING")


@dataclass(frozen=True)
class Config:
    """``checks``: verdicts WAIT after which a contact is sent nevertheless."""

    debounce_ms: int = 60_000
    recheck_ms: int = 60_000
    checks: int = 3


@dataclass(frozen=True)
class Sibling:
    state: str
    score: float | None = None
    deadline: int = -1
    waits: int = 0
    correlationId: str | None = None


Known = dict[tuple[str, str], Sibling]
Verdict = tuple[str, str, int, str, str | None]


def _verdict(slug: tuple[str, str], siblings: Known) -> str:
    others = [s for k, s in siblings.items() if k != slug]
    rank = {k: (-(float("-inf") if s.score is None else s.score), "::".join(k)) for k, s in siblings.items() if s.state == "CREATED"}
    if any(s.state in REACHED for s in others) or min(rank.values()) != rank[slug]:
        return "LOSE"
    return "WAIT" if any(s.state in BUSY for s in others) else "SEND"


def due(siblings: Known, upto: int, cfg: Config) -> list[Verdict]:
    """Verdicts of the contacts whose debounce ends by ``upto``; those that end together are judged by the same siblings."""
    out: list[Verdict] = []
    while ends := [s.deadline for s in siblings.values() if s.state == "CREATED" and s.deadline <= upto]:
        at = min(ends)
        found = {k: _verdict(k, siblings) for k, s in siblings.items() if s.state == "CREATED" and s.deadline == at}
        for slug, verdict in sorted(found.items()):
            own = siblings[slug]
            if verdict == "WAIT" and own.waits + 1 >= cfg.checks:
                verdict = "SEND"
            out.append((*slug, at, verdict, own.correlationId))
            if verdict == "LOSE":
                del siblings[slug]
            elif verdict == "SEND":
                siblings[slug] = replace(own, state="IN_PROCESS", deadline=-1)
            else:
                siblings[slug] = replace(own, deadline=at + cfg.recheck_ms, waits=own.waits + 1)
    return out


def step(siblings: Known, slug: tuple[str, str], ts: int, kind: str | None, state: str | None, score: float | None, correlation: str | None, cfg: Config) -> list[Verdict]:
    """One event, after what was due before it. Kinds: CREATE, STATE (where a contact is), END (hard completion, suppression, expiry)."""
    out = due(siblings, ts, cfg)
    if kind == "CREATE":
        if slug not in siblings or siblings[slug].state not in ("CREATED", *BUSY):  # a second create of a live contact is ignored
            siblings[slug] = Sibling("CREATED", score, ts + cfg.debounce_ms, 0, correlation)
    elif kind == "STATE" and state:
        siblings[slug] = Sibling(state)
    elif kind == "END":
        siblings.pop(slug, None)
    return out


EVENT = ["actionId", "channel", "ts", "kind", "state", "score", "correlationId"]
VERDICT = "actionId string, channel string, ts long, verdict string, correlationId string"


def _event(e: Row) -> tuple:
    """(slug, ts, kind, state, score, correlationId)."""
    return (e.actionId or "", e.channel or ""), e.ts, e.kind, e.state, e.score, e.correlationId


def _keys(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)


class SiblingDebounce(StatefulProcessor):
    """Keyed by member: what is known of each of its contacts, and a timer for each debounce."""

    def __init__(self, by: list[str], cfg: Config):
        self.by, self.cfg, self.row = by, cfg, Row(*by, *VERDICT.replace(",", "").split()[::2])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("siblings", "actionId string, channel string", "state string, score double, deadline long, waits int, correlationId string")

    def _load(self) -> Known:
        return {tuple(k): Sibling(*v) for k, v in self.known.iterator()}

    def _save(self, before: Known, now: Known) -> None:
        for slug in before.keys() - now.keys():
            self.known.removeKey(slug)
        for slug, s in now.items():
            if before.get(slug) != s:
                self.known.updateValue(slug, (s.state, s.score, s.deadline, s.waits, s.correlationId))
        for at in {s.deadline for s in now.values() if s.state == "CREATED"} - {s.deadline for s in before.values() if s.state == "CREATED"}:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        before = self._load()
        now, out = dict(before), []
        for e in sorted(rows, key=lambda e: (e.ts, e.seq or 0)):
            out += step(now, *_event(e), self.cfg)
        self._save(before, now)
        return iter([self.row(*key, *o) for o in out])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        before = self._load()
        now = dict(before)
        out = due(now, expiredTimerInfo.getExpiryTimeInMs(), self.cfg)
        self._save(before, now)
        return iter([self.row(*key, *o) for o in out])

    def close(self) -> None:
        pass


def stream_siblings(events: DataFrame, by: list[str], cfg: Config = Config()) -> DataFrame:  # noqa: B008
    """Verdicts (``by``, actionId, channel, ts, verdict, correlationId) of a stream with a watermark on ``at``.

    ``events``: ``by``, actionId, channel, ts, seq (order of equal times), kind, state, score, correlationId. A heartbeat (null kind)
    only moves time. A member's events have to come in order of time, as in a keyed topic.
    """
    named = events.select(*by, *EVENT, "seq", "at")
    return named.groupBy(*by).transformWithState(SiblingDebounce(by, cfg), f"{_keys(events, by)}, {VERDICT}", "append", "EventTime")


def replay_siblings(events: DataFrame, by: list[str], until_ms: int, cfg: Config = Config()) -> DataFrame:  # noqa: B008
    """Batch twin: the same verdicts up to ``until_ms``; events are dealt by member, sorted and stepped through, one member at a time."""
    names = [*by, *VERDICT.replace(",", "").split()[::2]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, known = None, {}
        for pdf in batches:
            out: list[tuple] = []
            own = pdf.astype(object).where(pdf.notna(), None)
            for *now, action, channel, ts, kind, state, score, correlation in own[[*by, *EVENT]].itertuples(index=False):
                if now != key:
                    out += [(*key, *v) for v in due(known, until_ms, cfg)] if key else []
                    key, known = now, {}
                out += [(*now, *v) for v in step(known, (action or "", channel or ""), int(ts), kind, state, score, correlation, cfg)]
            yield pd.DataFrame(out, columns=names)
        if key:
            yield pd.DataFrame([(*key, *v) for v in due(known, until_ms, cfg)], columns=names)

    dealt = events.where("kind is not null").repartition(*by).sortWithinPartitions(*by, "ts", "seq")
    schema: str | StructType = f"{_keys(events, by)}, {VERDICT}"
    return dealt.select(*by, *EVENT).mapInPandas(run, schema)


def sibling_events(creates: DataFrame, states: DataFrame, by: list[str]) -> DataFrame:
    """Events from creates (``by``, actionId, channel, ts, score, correlationId) and states (``by``, actionId, channel, ts, state); what ends a contact ends its claim."""
    end = F.col("state").isin("HARD_COMPLETED", "SUPPRESSED", "EXPIRED", "FAILED", "DEBOUNCED")
    none = F.lit(None)
    made = creates.select(*by, "actionId", "channel", "ts", F.lit(1).alias("seq"), F.lit("CREATE").alias("kind"), none.cast("string").alias("state"), F.col("score").cast("double").alias("score"), "correlationId")
    moved = states.select(*by, "actionId", "channel", "ts", F.lit(0).alias("seq"), F.when(end, "END").otherwise("STATE").alias("kind"), "state", none.cast("double").alias("score"), none.cast("string").alias("correlationId"))
    return made.unionByName(moved)


def debounce_signals(verdicts: DataFrame) -> DataFrame:
    """The losers as lifecycle signals (kind DEBOUNCE), at the moment their debounce ended."""
    return verdicts.where("verdict = 'LOSE'").select("entityId", "actionId", "channel", "ts", F.lit("DEBOUNCE").alias("kind"), "correlationId")
