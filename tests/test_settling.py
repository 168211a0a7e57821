"""Operations come out the same in any order of events, and leave no state behind."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tracemill.operators import sequences
from tracemill.streaming import jobs

SECOND, FIRST = 1_000_000, 86_400
SCHEMA = "operation long, event_id string, ts long, kind string, offset long, text string, status string"


def events():
    e = lambda op, n, t, kind, offset=None, text=None, status=None: (op, f"{op}/{n}", (t + FIRST) * SECOND, kind, offset, text, status)
    return [
        e(1, 0, 0, "start"), e(1, 1, 1, "delta", 0, "one "), e(1, 2, 2, "delta", 4, "two "), e(1, 3, 3, "delta", 8, "three"), e(1, 3, 3, "delta", 8, "three"), e(1, 4, 9, "settle", status="completed"),
        # a hole; a late success after a cancellation; a delta after it
        e(2, 0, 0, "start"), e(2, 1, 1, "delta", 0, "né"), e(2, 2, 2, "delta", 3, "x"), e(2, 3, 5, "settle", status="cancelled"), e(2, 4, 8, "settle", status="completed"), e(2, 5, 6, "delta", 2, "?"),
        # interrupted, then cancelled after all; the earliest of two deltas of one offset
        e(3, 0, 0, "start"), e(3, 1, 4, "settle", status="interrupted"), e(3, 2, 7, "settle", status="cancelled"), e(3, 3, 2, "delta", 0, "early"), e(3, 4, 3, "delta", 0, "later one"), e(3, 5, 3, "delta", 2, "past"),
        # never started; still running; an unknown status, an empty delta
        e(4, 0, 1, "delta", 0, "nobody"), e(4, 1, 2, "settle", status="failed"), e(5, 0, 3, "start"), e(5, 1, 3, "settle", status="dreaming"), e(5, 2, 4, "delta", 0, ""), e(5, 3, 5, "delta", 0, "a"), e(5, 4, 5, "delta", -1, "b"),
    ]


WANT = {1: ("completed", 9, "one two three"), 2: ("cancelled", 5, "né"), 3: ("cancelled", 4, "early"), 5: ("running", None, "a")}


def plain(rows):
    return {r["operation"]: (r["status"], None if r["settled_at"] is None else r["settled_at"] // SECOND - FIRST, r["text"]) for r in rows}


def test_batch(spark):
    d = spark.createDataFrame(events(), SCHEMA)
    assert plain(sequences.settled(d).collect()) == WANT
    assert sequences.settled(d.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival(spark, tmp_path, seed):
    rows = events()
    random.Random(seed).shuffle(rows)
    for n in range(0, len(rows), 8):
        spark.createDataFrame(rows[n : n + 8], SCHEMA).repartition(1).write.parquet(str(tmp_path / f"in/{n:03d}"))
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    with jobs.durable_state(spark):
        seen = jobs.to_end(jobs.operations(raw), "update")
    last = seen.groupBy("operation").agg(F.max_by(F.struct("status", "settled_at", "text"), "revision").alias("_s")).select("operation", "_s.*")
    assert plain(last.collect()) == WANT


def test_state_goes_after_its_time(spark, tmp_path):
    day = 86_400
    later = [(99, f"99/{d}", d * day * SECOND, "start", None, None, None) for d in (2, 3, 4)]
    back = [(1, "1/9", 3 * day * SECOND, "delta", 13, " more", None)]
    for n, rows in enumerate((events(), later[:1], later[1:2] + back, later[2:])):
        spark.createDataFrame(rows, SCHEMA).repartition(1).write.parquet(str(tmp_path / f"in/{n}"))
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    place = str(tmp_path / "stream")
    with jobs.durable_state(spark):
        seen = jobs.to_end(jobs.operations(raw), "update", place).collect()
        held = spark.read.format("statestore").option("stateVarName", "state").load(f"{place}/state")
        keys = {r["key"]["operation"] for r in held.select("key").collect()}
    # the operation that had expired isn't taken up again, and of the first day nothing is kept
    assert not [r for r in seen if r["operation"] == 1 and "more" in r["text"]]
    assert keys <= {99, 1} and 99 in keys and not keys & {2, 3, 4, 5}


class CountedStore:
    """Stands for a processor's handle and its states; counts the calls, each of which is a message to the JVM."""

    def __init__(self):
        self.calls, self.held = 0, {}

    def getValueState(self, name, *schemas):  # noqa: N802
        return CountedState(self, name)

    getMapState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1

    deleteTimer = registerTimer  # noqa: N815


class CountedState:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def _call(self):
        self.store.calls += 1
        return self.store.held

    def exists(self):
        return self.name in self._call()

    def get(self):
        return self._call().get(self.name)

    def update(self, value):
        self._call()[self.name] = value

    def containsKey(self, key):  # noqa: N802
        return (self.name, key) in self._call()

    def getValue(self, key):  # noqa: N802
        return self._call().get((self.name, key))

    def updateValue(self, key, value):  # noqa: N802
        self._call()[(self.name, key)] = value

    def iterator(self):
        return [(k[1], v) for k, v in self._call().items() if isinstance(k, tuple)]


def test_calls_on_the_store_do_not_grow_with_the_deltas():
    names = SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    store, machine, calls = CountedStore(), jobs.SettlingOperations("operation", 1000), []
    machine.init(store)
    piece = lambda n: Row(*names)(1, f"1/{n}", (n + FIRST) * SECOND, "delta", 2 * n, f"{n % 10},", None)
    start = Row(*names)(1, "1/start", FIRST * SECOND, "start", None, None, None)
    for batch in ([start, piece(0)], [piece(n) for n in range(300, 0, -1)], [piece(301)]):
        before = store.calls
        (last,) = machine.handleInputRows((1,), iter(batch), None)
        calls.append(store.calls - before)
    assert last.text == "".join(f"{n % 10}," for n in range(302)) and last.revision == 3
    assert max(calls) <= 4
