"""Things that wait for one another, kept as state with timers: leases of events, retries of deliveries, deadlines of workflows.

A signal is (key, seq, at, kind). What it does depends on what earlier signals of its key left behind and on whether a deadline passed
before it came, so each key holds a small state and at most one timer. On a stream, ``Keeper`` runs a policy
inside ``transformWithState``; on a table, an ordered fold does. A timer that is due before a signal fires first, so that batches and
restarts leave no trace in the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from memlake.operators.folds import folded

#: Tries before an event or a delivery is given up, and seconds to wait after each failed delivery.
MAX_ATTEMPTS = 5
BACKOFF = (10, 60, 300, 1800)
OUT = "key string, seq long, at timestamp, kind string, before string, after string, attempts int, due timestamp"
_MILLIS = OUT.replace("timestamp", "long")
STATE = "status string, attempts int, seq long, due long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Held:
    """What a key's signals have left: its status, its tries, its last seq, and when its timer is due (milliseconds), if it has one."""

    status: str
    attempts: int = 0
    seq: int = -1
    due: int | None = None


@dataclass(frozen=True)
class Lease:
    """An event of the log. Dispatching it costs a try and leases it; a lease that is not consumed in time lapses and may be dispatched again.
    A failure gives it back until its tries are spent; a deferral gives it back with its try."""

    seconds: int = 600
    start: str = "pending"

    def signal(self, held: Held, kind: str, at: int) -> Held:
        if held.status in ("consumed", "failed"):
            return held
        if kind == "dispatched" and held.status in ("pending", "lapsed") and held.attempts < MAX_ATTEMPTS:
            return replace(held, status="dispatched", attempts=held.attempts + 1, due=at + 1000 * self.seconds)
        if kind == "consumed":
            return replace(held, status="consumed", due=None)
        if kind == "failed":
            return replace(held, status="failed" if held.attempts >= MAX_ATTEMPTS else "pending", due=None)
        if kind == "deferred":
            return replace(held, status="pending", attempts=max(held.attempts - 1, 0), due=None)
        return held

    def timer(self, held: Held) -> Held:
        return replace(held, status="lapsed", due=None)


@dataclass(frozen=True)
class Delivery:
    """A delivery that is owed. A failed try is owed again after a wait that grows; after the last it is dead, a refused one at once; a replay
    re-arms what is dead."""

    start: str = "owed"

    def signal(self, held: Held, kind: str, at: int) -> Held:
        if kind == "replay":
            return replace(held, status="owed", attempts=0, due=None) if held.status == "dead" else held
        if held.status != "owed" or kind not in ("ok", "error", "refused"):
            return held
        tried = replace(held, attempts=held.attempts + 1, due=None)
        if kind == "ok":
            return replace(tried, status="delivered")
        if kind == "refused" or tried.attempts >= MAX_ATTEMPTS:
            return replace(tried, status="dead")
        return replace(tried, status="waiting", due=at + 1000 * BACKOFF[min(tried.attempts, len(BACKOFF)) - 1])

    def timer(self, held: Held) -> Held:
        return replace(held, status="owed", due=None)


@dataclass(frozen=True)
class Workflow:
    """States with transitions by trigger and deadlines: {state: {trigger: next}}, {state: (seconds, next)}. A state without ways out is the
    end. A trigger that a state does not take is refused. Transitions beyond ``budget`` end the instance as errored."""

    moves: dict
    deadlines: dict
    start: str = "new"
    budget: int = 1000

    def _to(self, held: Held, state: str, at: int) -> Held:
        if held.attempts >= self.budget:
            return replace(held, status="errored", due=None)
        seconds = self.deadlines.get(state, (None, None))[0]
        return replace(held, status=state, attempts=held.attempts + 1, due=None if seconds is None else at + 1000 * seconds)

    def signal(self, held: Held, kind: str, at: int) -> Held:
        target = self.moves.get(held.status, {}).get(kind)
        return held if target is None else self._to(held, target, at)

    def timer(self, held: Held) -> Held:
        return self._to(held, self.deadlines[held.status][1], held.due)


Policy = Lease | Delivery | Workflow


def fired(policy: Policy, key: str, held: Held, by: int) -> tuple[Held, list[tuple]]:
    """Fires the timers that are due by a time."""
    out = []
    while held.due is not None and held.due <= by:
        after = policy.timer(held)
        out.append((key, None, held.due, "timer", held.status, after.status, after.attempts, after.due))
        held = after
    return held, out


def applied(policy: Policy, key: str, held: Held, seq: int, at: int, kind: str) -> tuple[Held, list[tuple]]:
    """What a signal does, after the timers that were due before it. A signal whose seq is not above the last one is a repeat."""
    if seq <= held.seq:
        return held, []
    held, out = fired(policy, key, held, at)
    after = replace(policy.signal(held, kind, at), seq=seq)
    return after, [*out, (key, seq, at, kind, held.status, after.status, after.attempts, after.due)]


class Keeper(StatefulProcessor):
    """A policy on a stream: a key's status is its value state, and its deadline an event-time timer, so that keys at rest cost nothing."""

    def __init__(self, policy: Policy) -> None:
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", STATE)

    def _rows(self, out: list) -> pd.DataFrame:
        rows = pd.DataFrame(out, columns=["key", "seq", "at", "kind", "before", "after", "attempts", "due"])
        times = {c: pd.to_datetime(rows[c].astype("Int64"), unit="ms", utc=True) for c in ("at", "due")}
        return rows.assign(seq=rows["seq"].astype("Int64"), **times)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self.state.get() if self.state.exists() else None
        held = Held(*[None if x is None else (str(x) if i == 0 else int(x)) for i, x in enumerate(found)]) if found else Held(self.policy.start)
        armed = held.due
        for part in rows:
            out: list = []
            for seq, at, kind in sorted(zip(part["seq"], part["at_ms"], part["kind"], strict=True)):
                held, made = applied(self.policy, key[0], held, int(seq), int(at), kind)
                out += made
            yield self._rows(out)
        if armed != held.due:
            if armed is not None:
                self.handle.deleteTimer(armed)
            if held.due is not None:
                self.handle.registerTimer(held.due)
        self.state.update((held.status, held.attempts, held.seq, held.due))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, attempts, seq, due = self.state.get()
        held = Held(str(status), int(attempts), int(seq), None if due is None else int(due))
        held, out = fired(self.policy, key[0], held, expiredTimerInfo.getExpiryTimeInMs())
        if out and held.due is not None:
            self.handle.registerTimer(held.due)
        self.state.update((held.status, held.attempts, held.seq, held.due))
        yield self._rows(out)

    def close(self) -> None:
        pass


def kept(signals: DataFrame, policy: Policy, until: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """signals: key, seq, at, kind -> a row for each signal and fired timer: key, seq (null for a timer), at, kind, before, after, attempts, due.

    On a table, the signals of a key are read in the order of seq, and timers due by ``until`` fire. On a stream, a batch's signals of a
    key are ordered among themselves, and timers fire as the watermark, ``lateness`` behind the latest signal, passes them; the session needs
    the RocksDB state store (``ROCKSDB``). Times count in milliseconds. Rows with a null key, seq, at or kind are no signals and go."""
    whole = signals.where("key is not null and seq is not null and at is not null and kind is not null")
    rows = whole.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("at").cast("timestamp").alias("at"), "kind")
    rows = rows.withColumn("at_ms", F.unix_millis("at"))
    if signals.isStreaming:
        return rows.withWatermark("at", lateness).groupBy("key").transformWithStateInPandas(Keeper(policy), OUT, "Append", "EventTime")
    end = rows.sparkSession.range(1).select(F.unix_millis(F.lit(until).cast("timestamp"))).first()[0] if until else -1

    def step(state: tuple[str, Held], row: dict) -> tuple[tuple[str, Held], list[tuple]]:
        held, made = applied(policy, state[0], state[1], row["seq"], row["at_ms"], row["kind"])
        return (state[0], held), made

    made = folded(rows.drop("at"), "key", ["seq"], lambda key: (key, Held(policy.start)), step, lambda state: fired(policy, *state, end)[1], _MILLIS)
    return made.select("key", "seq", F.timestamp_millis("at").alias("at"), "kind", "before", "after", "attempts", F.timestamp_millis("due").alias("due"))
