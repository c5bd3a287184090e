"""The alert gate: deduplication, then a rate limit per tier, both counted from what was last sent."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Minutes between two alerts of a tier; minutes for which a sent alert hides equal ones.
RATE_MINUTES = {"info": 60, "warning": 30, "critical": 5}
HIDE_MINUTES = 60


def tier_of(severity):
    return F.when(severity >= 0.85, "critical").when(severity >= 0.4, "warning").otherwise("info")


def alert_key(entity: str | None, tier: str, title: str) -> str:
    return hashlib.md5(f"{entity}|{tier}|{(title or '')[:50]}".encode()).hexdigest()


def outcome_of(minute: float, sent_at: float | None, tier_at: float | None, tier: str) -> str:
    """What becomes of an alert, from when its key and its tier were last sent."""
    if sent_at is not None and minute - sent_at < HIDE_MINUTES:
        return "duplicate"
    if tier_at is not None and minute - tier_at < RATE_MINUTES[tier]:
        return "rate_limited"
    return "sent"


class Gate:
    """What was last sent: by alert key and by tier, in minutes."""

    def __init__(self, sent: dict | None = None, tier_at: float | None = None):
        self.sent, self.tier_at = dict(sent or {}), tier_at

    def offer(self, minute: float, tier: str, key: str) -> str:
        outcome = outcome_of(minute, self.sent.get(key), self.tier_at, tier)
        if outcome == "sent":
            self.sent = {k: m for k, m in self.sent.items() if minute - m < HIDE_MINUTES}
            self.sent[key], self.tier_at = minute, minute
        return outcome


def gate(alerts: DataFrame) -> DataFrame:
    """alerts(alert_id, ts, tier, entity_id, title) plus outcome: sent, duplicate or rate_limited, folded in time order.

    The tier is part of an alert's key, so tiers are independent; a tier's alerts form one ordered stream by nature. The
    fold is streamed: sorted by Spark, a batch of rows at a time, with only the state of the last hour in memory.
    """
    dealt = alerts.select("alert_id", "ts", "tier", "entity_id", "title").repartition("tier").sortWithinPartitions("tier", "ts", "alert_id")

    def fold(batches):
        gates: dict[str, Gate] = {}
        for batch in batches:
            minutes = batch["ts"].astype("int64") / (60e9 if str(batch["ts"].dtype).startswith("datetime64[ns") else 60e6)
            yield batch.assign(outcome=[gates.setdefault(t, Gate()).offer(m, t, alert_key(e, t, n)) for m, t, e, n in zip(minutes, batch["tier"], batch["entity_id"], batch["title"])])

    return dealt.mapInPandas(fold, dealt.withColumn("outcome", F.lit("")).schema)


class StreamGate(StatefulProcessor):
    """The gate of one tier: a state entry for each alert key that was sent, and when the tier was last sent.

    An entry has a timer at the end of its hour; when the watermark passes it, no alert that it could hide can come, and it goes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getMapState("sent", "alert_key string", "minute double")
        self.last = handle.getValueState("last", "minute double")

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows)).sort_values(["ts", "alert_id"])
        outcomes = []
        for ts, entity, title in zip(frame["ts"], frame["entity_id"], frame["title"]):
            minute, name = ts.timestamp() / 60, (alert_key(entity, key[0], title),)
            at = self.sent.getValue(name)[0] if self.sent.containsKey(name) else None
            last = self.last.get()[0] if self.last.exists() else None
            outcome = outcome_of(minute, at, last, key[0])
            if outcome == "sent":
                self.sent.updateValue(name, (minute,))
                self.last.update((minute,))
                self.handle.registerTimer(int((minute + HIDE_MINUTES) * 60_000))
            outcomes.append(outcome)
        yield pd.DataFrame({"alert_id": frame["alert_id"], "ts": frame["ts"], "tier": key[0], "outcome": pd.Series(outcomes, dtype=object, index=frame.index)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        minute = expiredTimerInfo.getExpiryTimeInMs() / 60_000
        for name, at in list(self.sent.iterator()):
            if at[0] + HIDE_MINUTES <= minute + 1e-4:
                self.sent.removeKey(name)
        return iter(())

    def close(self) -> None:
        pass


def gate_stream(alerts: DataFrame, late: str = "1 hour") -> DataFrame:
    """The same gate over a stream, kept across micro-batches; alerts later than the watermark are dropped.

    Sets the session's state store to RocksDB, which this kind of state needs.
    """
    alerts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = alerts.select("alert_id", "ts", "tier", "entity_id", "title").withWatermark("ts", late)
    return rows.groupBy("tier").transformWithStateInPandas(StreamGate(), "alert_id long, ts timestamp, tier string, outcome string", "append", "EventTime")


def emit_high(events: DataFrame, as_of, hours: int = 1, least: float = 0.75, most: int = 10) -> DataFrame:
    """The severest events of the last hours as alerts."""
    recent = events.where((F.col("severity") >= least) & (F.col("ts") > F.lit(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours))))
    top = recent.orderBy(F.desc("severity"), "event_id").limit(most)
    return top.select(F.col("event_id").alias("alert_id"), "ts", tier_of(F.col("severity")).alias("tier"), F.col("supplier_id").cast("string").alias("entity_id"), F.col("text").alias("title"))


def newest(alerts: DataFrame, most: int = 2000, tier: str | None = None) -> DataFrame:
    """The kept alerts, newest first."""
    rows = alerts if tier is None else alerts.where(F.col("tier") == tier)
    return rows.orderBy(F.desc("ts"), F.desc("alert_id")).limit(most)
