"""Streaming forms over a turn or state stream. Semantics are those of the batch twins.

Sources are plain ``readStream`` tables. State per key is typed: the last facts, the open sessions or the open version; it goes
when a key is idle or its sessions are over.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from memloom.functions import text as tx
from memloom.operators import nodes as nd

CHANGE_OUTPUT = "conv_id string, src string, dst string, relation string, confidence double, similarity double"
VERSION_ROWS = "entity string, attribute string, state_id long, value long, valid_from long, valid_to long, next_id long, late_rows long"
VERSION = Row(*[c.split()[0] for c in VERSION_ROWS.split(", ")])


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder, one file or a directory of files, as a stream; the braces make its path a pattern, which may be either."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{name}}}")


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that typed state and timers need, for queries started inside; the session's own setting comes back."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def run_available(stream: DataFrame, target: str) -> DataFrame:
    """Process what is there into Parquet with its own checkpoint, in append mode, and read the result."""
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", f"{target}/checkpoint").outputMode("append").trigger(availableNow=True)
    with keyed_state(spark):
        writer.format("parquet").option("path", f"{target}/data").start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}/data")


def extracted_nodes(turns: DataFrame) -> DataFrame:
    """RAW and FACT nodes of each arriving turn (anchors need the whole conversation)."""
    return nd.raw_nodes(turns).unionByName(nd.fact_nodes(turns))


SESSION_ROWS = "conv_id string, first_ts long, last_ts long, turns long, speakers long, closed boolean, seq long"
SESSION = Row(*[c.split()[0] for c in SESSION_ROWS.split(", ")])
SESSION_STATE = "first_ts long, last_ts long, turns long, speakers array<string>"


class Sessions(StatefulProcessor):
    """Open activity sessions of a key: a row joins those it lies within the gap of; the watermark closes them, by a timer. Rows are
    plain, and times are microseconds."""

    def __init__(self, gap: str) -> None:
        self.gap = pd.Timedelta(gap) // pd.Timedelta("1us")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", SESSION_STATE)
        self.seq = handle.getValueState("seq", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self._held()
        for at, speaker in sorted(((r.at, r.speaker) for r in rows), key=lambda r: r[0]):
            near = [s for s in held if s[0] - self.gap <= at <= s[1] + self.gap]
            speakers = {speaker} - {None}
            held = [s for s in held if s not in near] if near else held
            held.append((min([at, *[s[0] for s in near]]), max([at, *[s[1] for s in near]]), 1 + sum(s[2] for s in near), speakers.union(*[s[3] for s in near])))
        return self._emit(key, held, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._emit(key, self._held(), timerValues)

    def close(self) -> None:
        pass

    def _held(self) -> list[tuple]:
        return [(first, last, turns, set(speakers)) for first, last, turns, speakers in self.open.get()] if self.open.exists() else []

    def _emit(self, key, held: list[tuple], timer_values) -> Iterator[Row]:
        """Closed sessions leave; the key's open ones are passed on as they are now, under the next number."""
        passed = timer_values.getCurrentWatermarkInMs() * 1000
        over = lambda s: s[1] + self.gap < passed
        before = self.seq.get()
        seq = before[0] + 1 if before else 0
        left = sorted((s for s in held if not over(s)), key=lambda s: s[0])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if left:
            self.open.put([(first, last, turns, sorted(speakers)) for first, last, turns, speakers in left])
            self.seq.update((seq,))
            self.handle.registerTimer((left[0][1] + self.gap) // 1000 + 1)
        else:
            self.open.clear()
            self.seq.clear()
        return iter([SESSION(key[0], first, last, turns, len(speakers), over((first, last)), seq) for first, last, turns, speakers in held])


def session_activity(turns: DataFrame, delay: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Turns, distinct speakers and first and last time per conversation and activity session, in append mode.

    A micro-batch passes on the sessions of the keys it touches: closed ones for good, open ones as they are so far.
    ``session_table`` keeps the newest of each. State are the sessions that the watermark has not passed, whatever the stream's age.
    """
    rows = turns.withWatermark("ts", delay).select("conv_id", "speaker", F.unix_micros("ts").alias("at"), "ts")
    found = rows.groupBy("conv_id").transformWithState(Sessions(gap), SESSION_ROWS, "append", "eventTime")
    return found.withColumns({c: F.timestamp_micros(c) for c in ("first_ts", "last_ts")})


def session_table(emitted: DataFrame) -> DataFrame:
    """Every session once: closed ones, and the open ones of a key's newest emission since its last session closed."""
    newest = F.max_by("seq", F.struct("last_ts", "seq")).over(Window.partitionBy("conv_id"))
    closed = emitted.filter("closed")
    opened = emitted.filter("NOT closed").withColumn("newest", newest).filter("seq = newest").drop("newest")
    later = closed.select("conv_id", F.col("first_ts").alias("from"), F.col("last_ts").alias("to"))
    still = opened.join(later, (opened["conv_id"] == later["conv_id"]) & (opened["first_ts"] >= later["from"]) & (opened["first_ts"] <= later["to"]), "left_anti")
    return closed.unionByName(still).select("conv_id", "turns", "speakers", "first_ts", "last_ts")


class Changes(StatefulProcessor):
    """The last facts of a conversation by position; twice the window, so that a late one finds its neighbours."""

    UPDATE_WORDS, CONFLICT_WORDS = ("changed", "updated", "now", "instead", "no longer"), ("not ", "never", "contradict", "wrong")

    def __init__(self, window: int, min_similarity: float, idle: str | None) -> None:
        self.window, self.min_similarity, self.idle = window, min_similarity, pd.Timedelta(idle) if idle else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "pos long, node_id string, text string, status string, terms array<string>")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        return iter(())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        latest = max((f["at"].max() for f in frames if f["at"].notna().any()), default=None)
        if self.idle is not None and latest is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((latest + self.idle).timestamp() * 1000))
        held = [(*f[:4], set(f[4])) for f in self.recent.get()] if self.recent.exists() else []
        full = len(held) >= 2 * self.window
        arrived = sorted(((int(r.pos), r.node_id, r.text, r.status, set(r.terms)) for frame in frames for r in frame.itertuples(index=False)), key=lambda f: f[0])
        arrived = [f for f in arrived if not full or f[0] > held[0][0]]
        fresh = {f[1] for f in arrived}
        facts = sorted(held + arrived, key=lambda f: f[0])
        found = []
        for i, new in enumerate(facts):
            for old in facts[max(0, i - self.window) : i]:
                if (new[1] in fresh or old[1] in fresh) and (edge := self._edge(key[0], new, old)):
                    found.append(edge)
        self.recent.put([(*f[:4], sorted(f[4])) for f in facts[-2 * self.window :]])
        yield pd.DataFrame(found, columns=["conv_id", "src", "dst", "relation", "confidence", "similarity"])

    def close(self) -> None:
        pass

    def _edge(self, conv: str, new: tuple, old: tuple) -> tuple | None:
        similarity = len(new[4] & old[4]) / len(new[4] | old[4]) if new[4] and old[4] else 0.0
        lowered = new[2].lower()
        if similarity < self.min_similarity:
            return None
        if new[3] == "outdated" or any(w in lowered for w in self.UPDATE_WORDS):
            return conv, new[1], old[1], "UPDATES", min(0.9, 0.5 + similarity), similarity
        if any(w in f"{old[2].lower()} {lowered}" for w in self.CONFLICT_WORDS):
            return conv, new[1], old[1], "CONFLICTS_WITH", min(0.85, 0.45 + similarity), similarity
        return None


def change_edges(turns: DataFrame, window: int = 20, min_similarity: float = 0.18, idle: str | None = None, delay: str = "1 hour") -> DataFrame:
    """UPDATES and CONFLICTS_WITH edges against the last ``window`` facts of each conversation.

    A late turn is placed by its position: it meets its predecessors and those after it meet it, as long as it lies among the
    last ``2 * window`` facts; edges already passed on stay. With ``idle`` a conversation's state goes when the watermark of the
    turns' times, ``delay`` behind, is that far past its last turn; turns behind the watermark are dropped then. A
    conversation's facts of one micro-batch are together, so the trigger's limits bound them.
    """
    facts = nd.fact_nodes(turns).select("conv_id", "node_id", "text", "status", "pos", tx.term_set("text").alias("terms"), F.to_timestamp("time").alias("at"))
    if idle:
        facts = facts.withWatermark("at", delay)
    return facts.groupBy("conv_id").transformWithStateInPandas(Changes(window, min_similarity, idle), CHANGE_OUTPUT, "append", "eventTime" if idle else "none")


class Versions(StatefulProcessor):
    """The open version of a key; a timer drops it when the watermark has left it ``idle`` behind. Rows are plain, and times are
    microseconds: a frame of pandas for each of many small keys costs more than what is in it."""

    def __init__(self, idle: str | None) -> None:
        self.idle = pd.Timedelta(idle) // pd.Timedelta("1ms") if idle else None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start long, state_id long, value long, late long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        start, state_id, value, late = self.open.get() or (None, None, None, 0)
        first = state_id
        out = []
        for at, new_id, new_value in sorted((r.at, r.state_id, r.value) for r in rows):
            if start is not None and (at, new_id) < (start, state_id):
                late += 1
                continue
            if start is not None:
                out.append(VERSION(*key, state_id, value, start, at, new_id, late))
            start, state_id, value = at, new_id, new_value
        if state_id != first:
            out.append(VERSION(*key, state_id, value, start, None, None, late))
        self.open.update((start, state_id, value, late))
        if self.idle is not None and state_id != first:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(start // 1000 + self.idle)
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.open.clear()
        return iter(())

    def close(self) -> None:
        pass


def state_versions(states: DataFrame, delay: str = "1 hour", idle: str | None = None) -> DataFrame:
    """Versions per (entity, attribute): a closed one as the next state arrives, an open one (no ``valid_to``) once, when it opens.

    Rows behind the watermark are dropped; rows older than the open version are left out and counted in ``late_rows``. State
    is the open version of each key; with ``idle`` it goes when the watermark is that far past it, and ``latest_versions``
    closes such a version by the next one of its key. ``states``: (entity, attribute, state_id, value, ts).
    """
    mode = "eventTime" if idle else "none"
    rows = states.withWatermark("ts", delay).select("entity", "attribute", F.col("state_id").cast("long").alias("state_id"), F.col("value").cast("long").alias("value"), F.unix_micros("ts").alias("at"), "ts")
    found = rows.groupBy("entity", "attribute").transformWithState(Versions(idle), VERSION_ROWS, "append", mode)
    return found.withColumns({c: F.timestamp_micros(c) for c in ("valid_from", "valid_to")})


def latest_versions(versions: DataFrame) -> DataFrame:
    """The emitted versions with each state once: closed where a later row has closed it or a later version opened, else open."""
    keys = ["entity", "attribute", "state_id"]
    once = versions.groupBy(*keys).agg(
        F.max_by(F.struct("value", "valid_from", "valid_to", "next_id", "late_rows"), F.struct(F.col("next_id").isNotNull(), F.col("late_rows"))).alias("v")
    ).select(*keys, "v.*")
    order = Window.partitionBy("entity", "attribute").orderBy("valid_from", "state_id")
    following = F.lead(F.struct("valid_from", "state_id")).over(order)
    return once.withColumn("_next", following).select(
        *keys, "value", "valid_from", F.coalesce("valid_to", "_next.valid_from").alias("valid_to"), F.coalesce("next_id", "_next.state_id").alias("next_id"), "late_rows")


def versions_at(versions: DataFrame, asked: DataFrame) -> DataFrame:
    """As-of answers of ``asked (entity, attribute, at, ...)``: the version, closed or open, that holds at that time."""
    held = (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    return versions.join(asked, ["entity", "attribute"]).filter(held)
