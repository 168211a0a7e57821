"""Order-dependent operators. The order is always explicit: (t, order) within the keys."""

from __future__ import annotations

import math
from collections import deque, namedtuple
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def islands(d: DataFrame, by: list[str], t: str, order: str, wanted: Column, gap: int) -> DataFrame:
    """Rows with _island: runs of wanted rows at most `gap` apart that no other row interrupts; null elsewhere."""
    w = W.partitionBy(*by).orderBy(t, order)
    d = d.withColumn("_in", wanted)
    goes_on = F.col("_in") & F.coalesce(F.lag("_in").over(w), F.lit(False)) & (F.col(t) - F.lag(t).over(w) <= gap)
    number = F.sum(F.when(F.col("_new"), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    marked = d.withColumn("_new", F.col("_in") & ~F.coalesce(goes_on, F.lit(False)))
    return marked.withColumn("_island", F.when(F.col("_in"), number)).drop("_in", "_new")


def episodes(d: DataFrame, by: list[str], order: list[str], breaks: Column, name: str = "episode") -> DataFrame:
    """Running number of runs; a row where `breaks` holds starts the next."""
    w = W.partitionBy(*by).orderBy(*order)
    return d.withColumn(name, F.sum(F.when(breaks, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))


def chunk_prefix(actions: Column, most: int, gap: int) -> Column:
    """Longest prefix of an array of structs with field t of at most `most` items, each within `gap` of the one before."""
    size = F.size(actions)
    at = F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1)))
    stop = F.filter(at, lambda i: (i < size) & (F.get(actions, i)["t"] - F.get(actions, i - 1)["t"] > gap))
    return F.slice(actions, 1, F.least(F.lit(most), F.coalesce(F.get(stop, 0), size)))


def near_prefix(d: DataFrame, by: list[str], order: list[str], t: str, most: int, gap: int) -> DataFrame:
    """Each key's first rows, at most `most`, up to the first that comes more than `gap` after the one before."""
    w = W.partitionBy(*by).orderBy(*order)
    first = d.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    late = F.coalesce(F.col(t) - F.lag(t).over(w) > gap, F.lit(False))
    return first.withColumn("_late", late).withColumn("_cut", F.max("_late").over(w.rowsBetween(W.unboundedPreceding, 0))).where(~F.col("_cut")).drop("_n", "_late", "_cut")


def round_robin(d: DataFrame, group: str, order: list[str], name: str = "place") -> DataFrame:
    """Place of each row when groups take turns, in the order of the groups."""
    depth = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return d.withColumn("_depth", depth).withColumn(name, F.row_number().over(W.orderBy("_depth", group))).drop("_depth")


def newest_within(d: DataFrame, by: list[str], order: list[str], cost: Column, budget: int) -> DataFrame:
    """The newest rows whose costs add up to at most `budget`; the scan ends at the first that doesn't fit."""
    back = W.partitionBy(*by).orderBy(*(F.desc(c) for c in order)).rowsBetween(W.unboundedPreceding, 0)
    used = d.withColumn("_used", F.sum(cost).over(back))
    return used.where(F.col("_used") <= budget).drop("_used")


def repeats_cycle(d: DataFrame, by: list[str], order: list[str], item: str, sizes: range = range(1, 5), times: int = 3) -> Column:
    """Whether a row ends the `times`-th repetition in a row of a cycle of one of the sizes."""
    w = W.partitionBy(*by).orderBy(*order)
    checks = []
    for size in sizes:
        same = [F.coalesce(F.lag(item, k).over(w) == F.lag(item, k + size).over(w), F.lit(False)) for k in range(size * (times - 1))]
        check = same[0]
        for s in same[1:]:
            check = check & s
        checks.append(check)
    out = checks[0]
    for c in checks[1:]:
        out = out | c
    return out


def fold(d: DataFrame, by: list[str], order: list[str], start: Callable[[], Automaton], schema: str) -> DataFrame:
    """A sequential automaton over each key's rows in order; rows of `schema` are the key and what it emits.

    Rows stream past in sorted partitions, so a key of any size needs the memory of the automaton's state only.
    Keys and values reach the automaton as Arrow holds them: a null is None and never widens its column.
    """
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def emitted(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, machine = None, None
        for b in batches:
            out, row_of = [], namedtuple("Row", b.schema.names, rename=True)
            at = [b.schema.names.index(c) for c in by]
            for row in map(row_of._make, zip(*(c.to_pylist() for c in b.columns), strict=True)):
                now = tuple(row[i] for i in at)
                if machine is None or now != key:
                    out += [(*key, *r) for r in machine.end()] if machine else []
                    key, machine = now, start()
                out += [(*key, *r) for r in machine.take(row)]
            yield emitted(out)
        if machine:
            yield emitted([(*key, *r) for r in machine.end()])

    return d.repartition(parts, *by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


class Automaton(Protocol):
    def take(self, row) -> list[tuple]:
        """What is known for certain once this row has come."""

    def end(self) -> list[tuple]:
        """What is left when the key's rows have ended."""


def gestures(d: DataFrame) -> DataFrame:
    """Press, moves and release as one click or drag for each gesture. d: workflow, t, line_no, kind, x, y (pixels).

    kind: press, move, release or close (what ends a gesture without release). A gesture whose last point lies
    4 pixels or more from its press is a drag; only a released drag has a duration. Moves and releases outside
    a gesture are counted as orphans. Expressed as a running gesture number and one aggregation.
    """
    w = W.partitionBy("workflow").orderBy("t", "line_no").rowsBetween(W.unboundedPreceding, 0)
    edge = F.col("kind").isin("press", "release", "close")
    marked = d.withColumn("g", F.sum(F.when(edge, 1).otherwise(0)).over(w))
    # a release belongs to the gesture that it ends
    marked = marked.withColumn("g", F.when(F.col("kind").isin("release", "close"), F.col("g") - 1).otherwise(F.col("g")))
    first = lambda c: F.min_by(c, F.struct("t", "line_no"))
    moved = F.col("kind").isin("press", "move") | ((F.col("kind") == "release") & F.col("x").isNotNull())
    last = lambda c: F.max_by(c, F.when(moved, F.struct("t", "line_no")))
    found = marked.groupBy("workflow", "g").agg(
        F.bool_or(F.col("kind") == "press").alias("pressed"),
        F.bool_or(F.col("kind") == "release").alias("released"),
        first("t").alias("t"),
        first("x").alias("x"),
        first("y").alias("y"),
        last("x").alias("end_x"),
        last("y").alias("end_y"),
        F.max("t").alias("end_t"),
        F.count_if(F.col("kind") == "move").alias("path_points"),
    )
    drag = F.hypot(F.col("end_x") - F.col("x"), F.col("end_y") - F.col("y")) >= 4
    only = lambda c: F.when(F.col("type") == "drag", F.col(c))
    typed = found.where("pressed").withColumn("type", F.when(drag, "drag").otherwise("click"))
    return typed.select(
        "workflow", "t", "type", "x", "y", only("end_x").alias("end_x"), only("end_y").alias("end_y"), only("path_points").alias("path_points"),
        F.when((F.col("type") == "drag") & F.col("released"), F.col("end_t") - F.col("t")).alias("duration"),
    )


class ScrollRuns:
    """(t, end_t, delta, n): scrolls coalesced while near in time, of one direction, and at most `most` in sum."""

    def __init__(self, gap: float = 0.15, most: float = 10):
        self.gap, self.most, self.run = gap, most, None

    def take(self, row) -> list[tuple]:
        if self.run:
            t, end, sum_, n = self.run
            if row.t - end <= self.gap and row.delta * sum_ > 0 and abs(sum_ + row.delta) <= self.most:
                self.run = (t, row.t, sum_ + row.delta, n + 1)
                return []
        done, self.run = self.end(), (row.t, row.t, row.delta, 1)
        return done

    def end(self) -> list[tuple]:
        return [self.run] if self.run else []


class FixedWindow:
    """(attempts, refused): attempts beyond `most` of a window that opens with the first attempt after the last has ended."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.opened, self.used, self.attempts, self.refused = None, 0, 0, 0

    def take(self, row) -> list[tuple]:
        if self.opened is None or row.t - self.opened >= self.length:
            self.opened, self.used = row.t, 0
        self.used += 1
        self.attempts += 1
        self.refused += self.used > self.most
        return []

    def end(self) -> list[tuple]:
        return [(self.attempts, self.refused)]


class Windows:
    """(first_step, end_step, history, omitted, tokens): consecutive steps in windows of a share of the budget.

    A sliding sum holds the newest log lines that fit the history's share; what it holds when a window opens is
    that window's history. A step that would overfill an open window opens the next; a window has one step at least.
    """

    #: Shares of the budget for a window and for history, tokens that tell how many lines are left out.
    FILL, HISTORY, OMISSION = 0.92, 0.2, 12

    def __init__(self, budget: int, header: int = 220, fill: float = FILL, history: float = HISTORY):
        self.room, self.lines_room, self.header = budget * fill, int(budget * history), header
        self.lines, self.lines_cost, self.seen = deque(), 0, 0
        self.first, self.history, self.tokens = 0, 0, None

    def take(self, row) -> list[tuple]:
        done = self.end() if self.tokens is not None and self.tokens + row.cost > self.room else []
        if done or self.tokens is None:
            self.first, self.history = self.seen, len(self.lines)
            self.tokens = self.header + self.lines_cost + (self.OMISSION if self.history < self.first else 0)
        self.tokens += row.cost
        self.seen += 1
        self.lines.append(row.log_cost)
        self.lines_cost += row.log_cost
        while self.lines_cost > self.lines_room:
            self.lines_cost -= self.lines.popleft()
        return done

    def end(self) -> list[tuple]:
        return [(self.first, self.seen, self.history, self.first - self.history, self.tokens)] if self.tokens is not None else []


class JoinedTyping:
    """(segment, t, kind, text): typed texts that a span boundary cut. A text goes on in the next row if that starts
    within `per_char` seconds a character of the text so far; chains join to the left, emptied rows go."""

    def __init__(self, per_char: float = 0.75):
        self.per_char, self.last = per_char, None

    def take(self, row) -> list[tuple]:
        if self.last:
            segment, t, kind, text = self.last
            if kind == row.kind == "type_text" and 0 <= row.t - t <= self.per_char * len(text):
                self.last = (segment, t, kind, text + row.text)
                return []
        done, self.last = self.end(), (row.segment, row.t, row.kind, row.text)
        return done

    def end(self) -> list[tuple]:
        return [self.last] if self.last else []


class Reassembled:
    """(text): pieces laid end to end by their offsets up to the first hole; what lies within the text so far is past."""

    def __init__(self):
        self.parts, self.length, self.whole = [], 0, True

    def take(self, row) -> list[tuple]:
        if self.whole and row.offset == self.length:
            self.parts.append(row.text)
            self.length += len(row.text)
        elif row.offset > self.length:
            self.whole = False
        return []

    def end(self) -> list[tuple]:
        return [("".join(self.parts),)]


#: How an operation may end.
TERMINAL = ("completed", "incomplete", "failed", "cancelled", "interrupted")


def settled(events: DataFrame, by: str = "operation") -> DataFrame:
    """(by, status, settled_at, text): each started operation, whatever order its events came in.

    events: (by, event_id, ts, kind, offset, text, status). Event ids count once. The earliest settlement stands, later
    ones change nothing, except that an interrupted operation may turn out cancelled. Deltas after the settlement are
    ignored; the rest are laid end to end, of one offset the earliest.
    """
    when = F.struct("ts", "event_id")
    told = events.where((F.col("kind") != "settle") | F.col("status").isin(*TERMINAL)).dropDuplicates([by, "event_id"])
    ends = F.col("kind") == "settle"
    state = told.groupBy(by).agg(
        F.bool_or(F.col("kind") == "start").alias("started"), F.min_by("status", F.when(ends, when)).alias("first"), F.min(F.when(ends, F.col("ts"))).alias("settled_at"),
        F.coalesce(F.bool_or(ends & (F.col("status") == "cancelled")), F.lit(False)).alias("cancelled"),
    ).where("started")
    status = F.when((F.col("first") == "interrupted") & F.col("cancelled"), "cancelled").otherwise(F.coalesce("first", F.lit("running")))
    state = state.select(by, status.alias("status"), "settled_at")
    deltas = told.where("kind = 'delta' and offset >= 0 and text <> ''").join(state.select(by, "settled_at"), by).where("settled_at is null or ts <= settled_at")
    pieces = deltas.groupBy(by, "offset").agg(F.min_by("text", when).alias("text"))
    kind = events.schema[by].dataType.simpleString()
    text = fold(pieces, [by], ["offset"], Reassembled, f"{by} {kind}, text string")
    return state.join(text, by, "left").select(by, "status", "settled_at", F.coalesce("text", F.lit("")).alias("text"))


class LookupCache:
    """(lookup, outcome): hit, suppressed, fetched or failed, of lookups (lookup, t, subject, aspect, page, failed).

    A result is kept for (subject, aspect), the oldest entry going when there are more than `most`; fetching a kept key
    anew renews its time, not its place. A failure keeps a subject from being looked up for a while, pages for longer than
    searches. `failed` is how the lookup would end if it were done. Failures past their time are forgotten.
    """

    #: Seconds that a result, a page's failure and a search's failure last; entries.
    RESULT, PAGE, SEARCH, MOST = 900, 3600, 90, 24

    def __init__(self, most: int = MOST):
        self.most, self.results, self.failures = most, {}, {}

    def take(self, row) -> list[tuple]:
        key = (row.subject, row.aspect)
        self.failures = {s: t for s, t in self.failures.items() if row.t - t < self.PAGE}
        if row.t - self.failures.get(row.subject, -math.inf) < (self.PAGE if row.page else self.SEARCH):
            return [(row.lookup, "suppressed")]
        if row.t - self.results.get(key, -math.inf) < self.RESULT:
            return [(row.lookup, "hit")]
        if row.failed:
            self.failures[row.subject] = row.t
            return [(row.lookup, "failed")]
        self.results[key] = row.t
        if len(self.results) > self.most:
            del self.results[next(iter(self.results))]
        return [(row.lookup, "fetched")]

    def end(self) -> list[tuple]:
        return []


def priority_pick(d: DataFrame, by: list[str], item: str, order: str, priority: Column, most: int) -> DataFrame:
    """Distinct items of each key, the latest occurrence's order and the highest priority, best `most` first."""
    each = d.withColumn("_p", priority).groupBy(*by, item).agg(F.max("_p").alias("priority"), F.max(order).alias(order))
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("priority"), F.desc(order)))
    return each.withColumn("rank", rank).where(F.col("rank") <= most)
