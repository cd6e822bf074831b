"""Stateful gates of the stream with their decision functions: channel throttles, touch counters, sibling debounce, snapshot folds."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.scalars import DAY_MS
from tidemark.workspace import materialise


def throttle_decision(in_window: int, lake_rate: int, backlog: int, cap: int | None, ts: int, window_ms: int, share: int | None = None) -> str:
    """SEND below the cap; else WAIT while the rest of the day has room for the backlog; else SUPPRESS. No cap: SEND.

    ``in_window`` and ``backlog`` are held against ``share`` of the cap (default: all), the channel's rate in the lake against all of it.
    """
    share = cap if share is None else share
    if cap is None or (in_window < share and lake_rate < cap):
        return "SEND"
    windows_left = max(1, -(-(DAY_MS - ts % DAY_MS) // window_ms))
    return "WAIT" if backlog < share * windows_left else "SUPPRESS"


def cap_share(cap: int | None, shard: int, shards: int) -> int | None:
    """What ``shard`` may send of a channel's cap: all shards together may send the cap and no more."""
    return None if cap is None else cap // shards + (shard % shards < cap % shards)


def _step(state: tuple[int, int, int], ts: int, rate: int, cap: int | None, share: int | None, window_ms: int) -> tuple[str, tuple[int, int, int]]:
    start, sent, waiting = state
    if ts - start >= window_ms:
        start, sent = ts, 0
    decision = throttle_decision(sent, rate, waiting, cap, ts, window_ms, share)
    return decision, (start, sent + (decision == "SEND"), waiting + (decision == "WAIT"))


FRESH = (-(1 << 60), 0, 0)
THROTTLED = "id long, channel string, ts long, decision string"


def throttle(sends: DataFrame, caps: dict[str, int], window_ms: int, shards: int = 1) -> DataFrame:
    """Batch twin: decision for each send (id, channel, shard, ts, lakeRate) in the order of its channel.

    A channel's cap is a global promise, so its sends are one ordered sequence; ``shards`` splits cap and sends, and the shards' shares
    add up to the cap. Channels without a cap need no order. The others are a prefix scan: time is cut into ranges of about
    equal size (a busy channel has more of them), each range is summarised in parallel as a function from the state before it to
    the state after it, the functions are applied one after the other, and every range then decides its sends from its own first
    state. What follows a channel through time reads summaries only: one entry for each moment at which a window can begin in a range.
    """
    capped = F.col("channel").isin(list(caps))
    free = sends.where(~capped | F.col("channel").isNull()).select("id", "channel", "ts", F.lit("SEND").alias("decision"))
    order = ["channel", "shard", "ts", "id"]
    ranged = sends.where(capped).select("id", "channel", F.col("shard").cast("int").alias("shard"), "ts", "lakeRate").repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")
    share = lambda key: cap_share(caps[key[0]], int(key[1]), shards)

    def windows(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = _range(pdf, caps[key[0]])
        ends = own.window_ends(share(key), window_ms)
        return pd.DataFrame([(*key, int(own.ok.sum()), *ends)], columns=["channel", "shard", "range", "sendable", "at", "lastStart", "lastSent"])

    summaries = ranged.groupBy("channel", "shard", "range").applyInPandas(windows, f"{RANGE}, sendable long, at array<long>, lastStart array<long>, lastSent array<long>")

    def follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, start, sent = None, *FRESH[:2]
        for pdf in frames:
            out = []
            for channel, shard, number, sendable, at, last_start, last_sent in pdf.itertuples(index=False):
                if (channel, shard) != known:
                    known, start, sent = (channel, shard), *FRESH[:2]
                out.append((channel, shard, number, start, sent))
                i = bisect_left(at, start + window_ms)
                start, sent = (int(last_start[i]), int(last_sent[i])) if i < len(at) else (start, min(share(known), sent + sendable) if sent < share(known) else sent)
            yield pd.DataFrame(out, columns=["channel", "shard", "range", "start", "sent"])

    in_order = summaries.repartition("channel", "shard").sortWithinPartitions("channel", "shard", "range")
    begun = materialise(in_order.mapInPandas(follow, f"{RANGE}, start long, sent long"), "starts")

    def waits(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own, first = _range(pdf, caps[key[0]]), pdf.iloc[0]
        sent = own.sent(int(first["start"]), int(first["sent"]), share(key), window_ms)
        steps = _waiting_function(own.ts[~sent], share(key), window_ms)
        return pd.DataFrame([(*key, *steps)], columns=["channel", "shard", "range", "before", "after"])

    by = ["channel", "shard", "range"]
    waiting = ranged.join(begun, by).groupBy(*by).applyInPandas(waits, f"{RANGE}, before array<long>, after array<long>")

    def pile(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, now = None, 0
        for pdf in frames:
            out = []
            for channel, shard, number, before, after in pdf.itertuples(index=False):
                if (channel, shard) != known:
                    known, now = (channel, shard), 0
                out.append((channel, shard, number, now))
                now = now if now >= before[-1] else int(np.interp(now, before, after))
            yield pd.DataFrame(out, columns=["channel", "shard", "range", "waiting"])

    piled = waiting.repartition("channel", "shard").sortWithinPartitions("channel", "shard", "range").mapInPandas(pile, f"{RANGE}, waiting long")

    def decide(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "id"], kind="stable")
        state, decisions = tuple(int(pdf.iloc[0][c]) for c in ("start", "sent", "waiting")), []
        for ts, rate in zip(pdf["ts"], pdf["lakeRate"], strict=True):
            decision, state = _step(state, ts, rate, caps[key[0]], share(key), window_ms)
            decisions.append(decision)
        return pdf[["id", "channel", "ts"]].assign(decision=decisions)

    decided = ranged.join(begun.join(piled, by), by).groupBy(*by).applyInPandas(decide, THROTTLED)
    return free.unionByName(decided)


RANGE = "channel string, shard int, range int"


@dataclass(frozen=True)
class _Range:
    """The sends of one range in order: their times, and whether the lake's rate lets them go."""

    ts: np.ndarray
    ok: np.ndarray

    def window_ends(self, share: int, window_ms: int) -> tuple[list[int], list[int], list[int]]:
        """(at, start, sent): if a window begins with the first send at ``at``, where the range's last window starts and what it has sent.

        A window from before the range ends within the range's first ``window_ms``, so later moments are not listed.
        """
        begins = np.flatnonzero(np.concatenate([[True], self.ts[1:] > self.ts[:-1]]))
        upto = np.concatenate([[0], np.cumsum(self.ok)])
        following = np.searchsorted(self.ts[begins], self.ts[begins] + window_ms)
        start, sent = self.ts[begins].copy(), np.minimum(share, upto[-1] - upto[begins])
        for i in range(len(begins) - 1, -1, -1):
            if following[i] < len(begins):
                start[i], sent[i] = start[following[i]], sent[following[i]]
        listed = int(following[0]) + 1
        return self.ts[begins][:listed].tolist(), start[:listed].tolist(), sent[:listed].tolist()

    def sent(self, start: int, sent: int, share: int, window_ms: int) -> np.ndarray:
        """Which sends go out, from the state before the range: in each window the first that may, up to the share."""
        out, at = np.zeros(len(self.ts), bool), 0
        while at < len(self.ts):
            end = int(np.searchsorted(self.ts, start + window_ms))
            free = np.flatnonzero(self.ok[at:end])[: max(0, share - sent)]
            out[at + free] = True
            if end < len(self.ts):
                start, sent = int(self.ts[end]), 0
            at = end
        return out


def _range(pdf: pd.DataFrame, cap: int) -> _Range:
    own = pdf.sort_values(["ts", "id"], kind="stable")
    return _Range(own["ts"].to_numpy(np.int64), own["lakeRate"].to_numpy(np.int64) < cap)


def _waiting_function(ts: np.ndarray, share: int, window_ms: int) -> tuple[list[int], list[int]]:
    """How many wait after sends at ``ts`` that did not go out, as knots of a piecewise linear function of how many waited before.

    Each send adds one where fewer wait than the rest of the day has room for. While the windows left are the same, n sends raise w to
    min(w + n, room) if it is below the room. From the last knot on nothing changes.
    """
    left = np.maximum(1, -(-(DAY_MS - ts % DAY_MS) // window_ms))
    begins = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]])) if len(ts) else np.empty(0, int)
    counts = np.diff(np.concatenate([begins, [len(ts)]]))
    rooms = share * left[begins]
    before = np.array([0, max(1, int(rooms.max(initial=0)))])
    after = before.copy()
    for room, n in zip(rooms, counts, strict=True):
        kinks = [int(np.interp(y, after, before)) for y in (room - n, room) if after[0] < y < after[-1]]
        knots = np.union1d(before, [x + d for x in kinks for d in (0, 1) if x + d <= before[-1]]).astype(int)
        values = np.interp(knots, before, after).astype(int)
        before, after = knots, np.where(values < room, np.minimum(values + n, room), values)
    return before.tolist(), after.tolist()


def stream_throttle(sends: DataFrame, caps: dict[str, int], window_ms: int, shards: int = 1) -> DataFrame:
    """The same on a stream: the window's start, what it sent and what waits are the state of (channel, shard)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(["ts", "id"])
        cap, now, decisions = caps.get(key[0]), state.get if state.exists else FRESH, []
        for ts, rate in zip(pdf["ts"], pdf["lakeRate"], strict=True):
            decision, now = _step(now, ts, rate, cap, cap_share(cap, key[1], shards), window_ms)
            decisions.append(decision)
        state.update(tuple(map(int, now)))
        yield pd.DataFrame({"id": pdf["id"], "channel": key[0], "ts": pdf["ts"], "decision": decisions})

    return sends.groupBy("channel", "shard").applyInPandasWithState(run, THROTTLED, "start long, sent long, waiting long", "append", GroupStateTimeout.NoTimeout)


TOUCHED = "id long, entityId string, channel string, touch long, template string"


def stream_touch(sends: DataFrame, touch_keys: dict[str, list[str]], base: str) -> DataFrame:
    """The touch number of each send (id, entityId, channel, ts) and its template; the counter never resets."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(["ts", "id"])
        first = (state.get[0] if state.exists else 0) + 1
        touches = list(range(first, first + len(pdf)))
        state.update((touches[-1],))
        keys = touch_keys.get(key[1]) or []
        templates = [keys[min(n, len(keys)) - 1] if keys else base for n in touches]
        yield pd.DataFrame({"id": pdf["id"], "entityId": key[0], "channel": key[1], "touch": touches, "template": templates})

    return sends.groupBy("entityId", "channel").applyInPandasWithState(run, TOUCHED, "n long", "append", GroupStateTimeout.NoTimeout)


FOLDED = "entityId string, key string, value string, eventTs long"


def stream_fold(facts: DataFrame) -> DataFrame:
    """Last writer wins for each (entityId, key): emits a fact only where it is strictly newer than what is known.

    Keyed by fact rather than by member, so that no member's state is one large row.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(["eventTs", "value"])
        last = pdf.iloc[-1]
        if not state.exists or last["eventTs"] > state.get[0]:
            state.update((int(last["eventTs"]),))
            yield pd.DataFrame([(key[0], key[1], last["value"], int(last["eventTs"]))], columns=["entityId", "key", "value", "eventTs"])

    return facts.groupBy("entityId", "key").applyInPandasWithState(run, FOLDED, "eventTs long", "append", GroupStateTimeout.NoTimeout)
