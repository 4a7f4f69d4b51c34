"""Streaming operators with custom state: refusals, alarms, rate limits and sessions.

Rows wait in the state until the watermark has passed them and then go through
their key's state in event order, whatever batch brought them; rows behind the
watermark are late and dropped. Event-time timers release waiting rows and end
states. The session must use the RocksDB state store (`use_rocksdb`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from netloom.functions.times import micros
from netloom.operators.limits import CAPACITY_FACTOR, HOLDBACK_US, MAX_ATTEMPTS
from netloom.operators.packets import ATTEMPT_TIMEOUT, CONNECTION
from netloom.streaming.jobs import timed

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATENESS = "10 seconds"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class InOrder(StatefulProcessor):
    """Hands the rows of a key to `step` in event order.

    A row is `us`, a second column that breaks ties, and more; `row` is their
    schema, `state` that of the key's state, and `out` names the result columns.
    The state holds the rows of the lateness and nothing that is decided.
    """

    row = ""
    state = ""
    out: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.held = handle.getValueState("held", self.state)

    def step(self, key, state, row, out: list) -> tuple | None:
        """The state after a row; results go to `out`."""
        raise NotImplementedError

    def end(self, state) -> int | None:
        """The time behind which the state ends by itself."""
        return None

    def ended(self, key, state, out: list) -> None:
        """Results of a state that ends by itself."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in self.row.split(", ")]
        for batch in rows:
            fresh = [tuple(r) for r in batch[names].astype(object).itertuples(index=False)]
            self.waiting.appendList(fresh)
            self._wake(min(r[0] for r in fresh))
        yield pd.DataFrame([], columns=self.out)

    def _wake(self, us: int) -> None:
        """Come back when the watermark has passed a time."""
        self.handle.registerTimer(int(us) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get(), key=lambda r: r[:2]) if self.waiting.exists() else []
        state = self.held.get() if self.held.exists() else None
        due = [r for r in waiting if r[0] <= mark]
        out: list = []
        for row in due:
            state = self.step(key, state, row, out)
        end = None if state is None else self.end(state)
        if end is not None and end <= mark:
            self.ended(key, state, out)
            state = None
        elif end is not None:
            self._wake(end)
        if state is None:
            self.held.clear()
        else:
            self.held.update(state)
        rest = waiting[len(due) :]
        if rest:
            self.waiting.put(rest)
            self._wake(rest[0][0])
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=self.out)

    def close(self) -> None:
        pass


class RefusedConnections(InOrder):
    """Decides connection attempts; those without an answer are decided when their time is over."""

    row = "us long, kind string, reason string"
    # start, opened, answered (accepted or refused) and reason of the open attempt.
    state = "start long, syn boolean, ack boolean, nak boolean, reason string, done boolean"
    out = [*CONNECTION, "us", "reason"]

    def __init__(self, timeout_us: int):
        self.timeout_us = timeout_us

    def end(self, state) -> int:
        return state[0] + self.timeout_us

    def ended(self, key, state, out: list) -> None:
        start, syn, ack, nak, why, done = state
        if syn and not done:
            out.append((*key, start, "T"))

    def step(self, key, state, row, out: list) -> tuple:
        us, kind, reason = row
        if state is not None and us > self.end(state):
            self.ended(key, state, out)
            state = None
        start, syn, ack, nak, why, done = state or (us, False, False, False, None, False)
        if done:
            return state
        syn, ack, nak = syn or kind == "syn", ack or kind == "ack", nak or kind == "nak"
        why = reason if kind == "nak" else why
        done = syn and (ack or nak)
        if done and not ack:
            out.append((*key, start, why or "T"))
        return start, syn, ack, nak, why, done


def stream_refused(events: DataFrame, timeout_us: int = ATTEMPT_TIMEOUT, lateness: str = LATENESS) -> DataFrame:
    """Refused attempts of a stream of connection events (append mode)."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    rows = timed(events, "ts", lateness).withColumn("us", micros("ts"))
    found = rows.groupBy(*CONNECTION).transformWithStateInPandas(
        RefusedConnections(timeout_us),
        ", ".join(f"{c} {kinds[c]}" for c in CONNECTION) + ", us long, reason string",
        "Append",
        "EventTime",
    )
    return found.select(*CONNECTION, F.timestamp_micros("us").cast("timestamp_ntz").alias("timestamp"), "reason")


class LoginBursts(InOrder):
    """Raises an alarm at the n-th login since the last one, outside its silence."""

    row = "us long, id long"
    state = "count long, quiet_until long, last long"
    out = ["server", "remote", "id", "us"]

    def __init__(self, attempts: int, holdback_us: int, forget_us: int | None):
        self.attempts, self.holdback_us, self.forget_us = attempts, holdback_us, forget_us

    def end(self, state) -> int | None:
        return None if self.forget_us is None else max(state[2] + self.forget_us, state[1])

    def step(self, key, state, row, out: list) -> tuple:
        us, number = row
        if state is not None and self.forget_us is not None and us > self.end(state):
            state = None
        count, quiet_until, _ = state or (0, 0, 0)
        count += 1
        if count >= self.attempts and us >= quiet_until:
            out.append((*key, number, us))
            count, quiet_until = 0, us + self.holdback_us
        return count, quiet_until, us


def stream_login_bursts(
    logs: DataFrame, attempts: int = MAX_ATTEMPTS, holdback_us: int = HOLDBACK_US,
    lateness: str = LATENESS, forget_us: int | None = None,
) -> DataFrame:
    """Login alarms of a stream of honeypot events (append mode).

    The logins since the last alarm count without a limit of time, as in
    `login_bursts`; with `forget_us`, a key that is silent for so long starts anew
    and its state ends.
    """
    logins = timed(logs.where(F.col("event") == "login"), "timestamp", lateness)
    logins = logins.withColumn("us", micros("timestamp"))
    found = logins.groupBy("server", "remote").transformWithStateInPandas(
        LoginBursts(attempts, holdback_us, forget_us), "server string, remote string, id long, us long", "Append", "EventTime"
    )
    return found.select("server", "remote", "id", F.timestamp_micros("us").cast("timestamp_ntz").alias("timestamp"))


class TokenBuckets(InOrder):
    """Accepts messages that cost less than the tokens left. A full bucket needs no state."""

    row = "us long, id long, cost double"
    state = "tokens double, tick long"
    out = ["client", "id", "accepted"]

    def __init__(self, inflow: int, interval_us: int, full: int):
        self.inflow, self.interval_us, self.full = inflow, interval_us, full

    def end(self, state) -> int:
        return int(state[1] + (self.full - state[0]) // self.inflow + 1) * self.interval_us

    def step(self, key, state, row, out: list) -> tuple:
        us, number, cost = row
        now = us // self.interval_us
        tokens, tick = state or (float(self.full), now)
        tokens = min(tokens + (now - tick) * self.inflow, self.full)
        accepted = cost < tokens
        out.append((key[0], number, bool(accepted)))
        return float(tokens - cost if accepted else tokens), int(now)


def stream_rate_limit(messages: DataFrame, inflow: int, interval_s: int, factor: int = CAPACITY_FACTOR, lateness: str = LATENESS) -> DataFrame:
    """Accepted flags of a stream of messages (client, id, ts, cost), append mode."""
    rows = timed(messages, "ts", lateness).withColumns({"us": micros("ts"), "cost": F.col("cost").cast("double")})
    kind = messages.schema["client"].dataType.simpleString()
    return rows.groupBy("client").transformWithStateInPandas(
        TokenBuckets(inflow, interval_s * 1_000_000, inflow * factor), f"client {kind}, id long, accepted boolean", "Append", "EventTime"
    )


class ClientSessions(InOrder):
    """Pairs each login with the client's next login or logout; only an open session has a state."""

    row = "us long, id long, activity string"
    state = "start long"
    out = ["client", "start_us", "end_us", "ended"]

    def step(self, key, state, row, out: list) -> tuple | None:
        us, _, activity = row
        if state is not None:
            out.append((key[0], state[0], us, "relogin" if activity == "login" else "logout"))
        return (us,) if activity == "login" else None


def stream_client_sessions(activities: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Closed client sessions of a stream of activities (append mode)."""
    logged = timed(activities.where(F.col("activity").isin("login", "logout")), "timestamp", lateness).withColumn("us", micros("timestamp"))
    found = logged.groupBy("client").transformWithStateInPandas(
        ClientSessions(), "client long, start_us long, end_us long, ended string", "Append", "EventTime"
    )
    wall = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return found.select("client", wall("start_us").alias("start"), wall("end_us").alias("end"), "ended")
