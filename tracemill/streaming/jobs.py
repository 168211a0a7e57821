"""Structured Streaming forms of the event-log operators."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tracemill.operators.atoms import ATOM, FIELDS, Atoms
from tracemill.operators.sequences import TERMINAL, Reassembled
from tracemill.storage import shared_dir, table


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as a stream of its files, event time as a timestamp."""
    return table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table read as a stream of its files; a pattern, since a table may be one file or a folder of them."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


def log_appends(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """STR-01, SRC-16: each event id once within the lateness bound."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def routed(stream: DataFrame, ephemeral: Column, saved: str, live: str, checkpoint: str) -> None:
    """STR-03: rows of a stream to its history or, where `ephemeral` is true, to a live feed only; each row once.

    One query feeds both, so the stream is read once. A batch writes folders of its own number and replaces them if it
    is done again after a failure, so neither gets a row twice. Null counts as not ephemeral. Runs until the input ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("_live", F.coalesce(ephemeral, F.lit(False)))
        held = marked.persist()
        for path, side in ((saved, ~F.col("_live")), (live, F.col("_live"))):
            held.where(side).drop("_live").write.mode("overwrite").parquet(f"{path}/batch={number}")
        held.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def typing_sessions(stream: DataFrame, by: str, gap: str, late: str = "1 day") -> DataFrame:
    """STR-15: runs of events at most `gap` apart."""
    grouped = stream.withWatermark("ts", late).groupBy(by, F.session_window("ts", gap))
    return grouped.agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), "n")


def fresh_only(stream: DataFrame, floor: str, late: str = "1 day") -> DataFrame:
    """STR-06: observations at their floor or later; later than the watermark they are dropped downstream."""
    return stream.withWatermark("ts", late).where(F.col("ts") >= F.col(floor))


def assembled(deltas: DataFrame, by: str = "answer_id") -> DataFrame:
    """STR-04/05/17: text deltas joined in the order of their offsets, whatever order they come in.

    deltas: (by, offset, text). State holds the contiguous text's length and the deltas beyond a hole. Each
    micro-batch emits (by, text, length): what has become contiguous, and the length so far. A delta at an
    offset that is past is ignored.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        length, at, texts = state.get if state.exists else (0, [], [])
        waiting = dict(zip(at, texts, strict=True))
        for b in batches:
            for offset, text in zip(b["offset"].tolist(), b["text"].tolist(), strict=True):
                if offset >= length:
                    waiting.setdefault(offset, text)
        new = ""
        while length in waiting:
            part = waiting.pop(length)
            if not part:
                break
            new, length = new + part, length + len(part)
        waiting = {o: t for o, t in waiting.items() if o > length}
        state.update((length, list(waiting), list(waiting.values())))
        if new:
            yield pd.DataFrame({by: [key[0]], "text": [new], "length": [length]})

    kinds = f"{by} long, text string, length long"
    held = "length long, offsets array<long>, texts array<string>"
    return deltas.groupBy(by).applyInPandasWithState(step, kinds, held, "append", GroupStateTimeout.NoTimeout)


def limited(attempts: DataFrame, by: str, most: int, window_us: int) -> DataFrame:
    """STR-08/09: attempts beyond `most` in a fixed window, which starts at a client's first attempt, are refused.

    attempts: (by, t in microseconds). State is one window's start and count a client.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, used = state.get if state.exists else (None, 0)
        out = []
        for t in sorted(t for b in batches for t in b["t"].tolist()):
            if start is None or t - start >= window_us:
                start, used = t, 0
            used += 1
            out.append((key[0], t, used > most))
        state.update((start, used))
        yield pd.DataFrame(out, columns=[by, "t", "refused"])

    return attempts.groupBy(by).applyInPandasWithState(step, f"{by} long, t long, refused boolean", "start long, used long", "append", GroupStateTimeout.NoTimeout)


class AtomsOfStream(StatefulProcessor):
    """The automaton of operators.atoms over micro-batches. State is its JSON; `quiet_ms` without an event, in event
    time, or a closed recording, ends a stream: what is left goes out and nothing of it stays in the store."""

    def __init__(self, by: str, quiet_ms: int):
        self.quiet_ms, self.names = quiet_ms, [by, *FIELDS]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.row = handle, Row(*self.names)
        self.kept = handle.getValueState("atoms", "state string, t double, line long, due long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        state, t, line, due = self.kept.get() if self.kept.exists() else (None, -1.0, -1, None)
        machine, out, seen, closed = Atoms(json.loads(state) if state else None), [], None, False
        for row in sorted(rows, key=lambda r: (r["t"] is not None, r["t"], r["line"])):
            if row["kind"] == "closed":
                closed, out = True, out + machine.end()
            elif row["t"] is not None and (row["t"], row["line"]) <= (t, line):
                out.append(Atoms._row(type="reject", reason="late_event", line=row["line"], t=row["t"]))
            else:
                out += machine.take(row)
                t, line = (t, line) if row["t"] is None else (row["t"], row["line"])
            seen = max(seen or row["ts"], row["ts"])
        if due is not None:
            self.handle.deleteTimer(due)
        if closed and not (machine.at.last or machine.at.press):
            self.kept.clear()
        else:
            due = int(seen.timestamp() * 1000) + self.quiet_ms
            self.handle.registerTimer(due)
            self.kept.update((json.dumps(machine.state()), t, line, due))
        return (self.row(*key, *r) for r in out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        machine = Atoms(json.loads(self.kept.get()[0])) if self.kept.exists() else Atoms()
        self.kept.clear()
        return (self.row(*key, *r) for r in machine.end())

    def close(self) -> None:
        pass


def atoms_of(events: DataFrame, by: str = "workflow", quiet: int = 3600, late: str = "1 hour") -> DataFrame:
    """SEQ-02/05 as a stream: (by, ATOM) of events with the columns of as_events and ts, the event time. A row of kind
    `closed` ends a stream, `quiet` seconds of silence too. An event older than one already taken is a reject."""
    kind = events.schema[by].dataType.simpleString()
    grouped = events.withWatermark("ts", late).groupBy(by)
    return grouped.transformWithState(AtomsOfStream(by, quiet * 1000), f"{by} {kind}, {ATOM}", "Append", "EventTime")


class SettlingOperations(StatefulProcessor):
    """operations.settled over micro-batches: every batch that touches a started operation emits its present state.

    Kept for each operation until `ttl_ms` of event time pass without an event of it: the earliest delta of each offset
    and the settlements' essence. Keeping them by event time, not arrival, makes the last state the same for any order.
    Then a timer clears it, and what comes later meets no operation. All of an operation is one value, read and written
    once a batch: each call on the store is a message to the JVM, so a call a delta would cost more than the deltas.
    """

    def __init__(self, by: str, ttl_ms: int):
        self.by, self.ttl_ms = by, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.row = handle, Row(self.by, "status", "settled_at", "text", "revision")
        deltas = "offsets array<long>, times array<long>, ids array<string>, texts array<string>"
        self.state = handle.getValueState("state", f"started boolean, status string, at long, event_id string, cancelled boolean, newest long, revision long, {deltas}")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        started, status, at, by_event, cancelled, newest, revision, *held = self.state.get() or (False, None, None, None, False, None, 0, [], [], [], [])
        pieces = {offset: piece for offset, *piece in zip(*held, strict=True)}
        due = newest
        for r in rows:
            now = [r["ts"], r["event_id"]]
            newest = max(r["ts"], newest if newest is not None else r["ts"])
            if r["kind"] == "start":
                started = True
            elif r["kind"] == "settle" and r["status"] in TERMINAL:
                cancelled |= r["status"] == "cancelled"
                if status is None or now < [at, by_event]:
                    status, (at, by_event) = r["status"], now
            elif r["kind"] == "delta" and r["text"] and r["offset"] is not None and r["offset"] >= 0:
                piece = [*now, r["text"]]
                pieces[r["offset"]] = min(pieces.get(r["offset"], piece), piece)
        if due != newest:
            if due is not None:
                self.handle.deleteTimer(due // 1000 + self.ttl_ms)
            self.handle.registerTimer(newest // 1000 + self.ttl_ms)
        held = [list(pieces), *([p[k] for p in pieces.values()] for k in range(3))]
        self.state.update((started, status, at, by_event, cancelled, newest, revision + 1, *held))
        if started:
            ended = "cancelled" if status == "interrupted" and cancelled else status or "running"
            yield self.row(*key, ended, at, self._text(pieces, at), revision + 1)

    @staticmethod
    def _text(pieces: dict[int, list], at: int | None) -> str:
        whole = Reassembled()
        for offset, (ts, _, text) in sorted(pieces.items()):
            if at is None or ts <= at:
                whole.take(Row(offset=offset, text=text))
        return whole.end()[0][0]

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def operations(events: DataFrame, by: str = "operation", ttl: int = 12 * 3600, late: str = "1 hour") -> DataFrame:
    """STR-17/09: (by, status, settled_at, text, revision); events as for sequences.settled, ts in microseconds. The row
    of the highest revision is an operation's state; `ttl` seconds after its newest event nothing of it is kept."""
    kind = events.schema[by].dataType.simpleString()
    timed = events.withColumn("at", F.timestamp_micros("ts")).withWatermark("at", late).withColumn("event_id", F.col("event_id").cast("string"))
    schema = f"{by} {kind}, status string, settled_at long, text string, revision long"
    return timed.groupBy(by).transformWithState(SettlingOperations(by, ttl * 1000), schema, "Update", "EventTime")


@contextmanager
def durable_state(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in the store that keyed timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def to_end(stream: DataFrame, mode: str = "append", place: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote; restartable from its checkpoint at `place`."""
    spark = stream.sparkSession
    place = place or f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/micro_batch={epoch}")

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()
    found = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, micro_batch long").parquet(f"{place}/out")
    if mode == "complete":
        found = found.where(F.col("micro_batch") == found.agg(F.max("micro_batch")).first()[0])
    return found.drop("micro_batch")
