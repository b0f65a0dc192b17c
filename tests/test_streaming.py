"""Stateful streams against plain versions and batch twins, across restarts, and with state that runs out."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from eventloom.operators.bars import DAY, HOUR
from eventloom.streaming import ladder, progress, runs

RUNGS, RING = [("h6", 6 * HOUR, 50.0), ("d3", 3 * DAY, 150.0)], ladder.Ring(36 * HOUR, 6 * HOUR, 5 * DAY)


def plain_alerts(ticks, rungs, ring, store, push):
    """Two rings per symbol, samples merged, and two times of last alerts per rung, tick by tick."""
    out, state = [], {}
    for event_id, symbol, us, price in sorted(ticks, key=lambda t: (t[1], t[2], t[0])):
        short, long, fired = state.setdefault(symbol, (deque(), deque(), {}))
        short.append((us, price))
        while us - short[0][0] > ring.short:
            short.popleft()
        if not long or us - long[-1][0] >= ring.step:
            long.append((us, price))
            while us - long[0][0] > ring.long:
                long.popleft()
        for name, window, least in rungs:
            past = [s for s in sorted({*short, *long}) if s[0] <= us - window]
            if past and past[-1][1] and abs(round((price / past[-1][1] - 1) * 100, 4)) >= least:
                stored, pushed = fired.get(name, (None, None))
                if stored is None or us - stored >= store:
                    yes = pushed is None or us - pushed >= push
                    fired[name] = (us, us if yes else pushed)
                    out.append((event_id, symbol, us, name, yes))
    return sorted(out)


def ticks_of(seed, symbols, n, days):
    rng = random.Random(seed)
    times = sorted(rng.sample(range(days * 24 * 3600), n))
    return [(i, rng.choice(symbols), 1_704_067_200_000_000 + t * 1_000_000, rng.choice((1.0, 2.0, 4.0, 0.0, rng.random()))) for i, t in enumerate(times)]


def write(spark, ticks, path, files):
    per = -(-len(ticks) // files)
    for k in range(files):
        df = spark.createDataFrame(ticks[k * per : (k + 1) * per], "event_id long, user_id long, us long, value double")
        df.select("event_id", "user_id", F.timestamp_micros("us").alias("ts"), "value", F.lit("view").alias("event_type"), F.lit('{"k": 1}').alias("props")).coalesce(1).write.mode("append").parquet(path)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("event_id", "symbol", "us", "rung", "pushed").collect())


def test_ladder_goes_on_after_a_restart_and_equals_its_batch_twin(spark, tmp_path):
    ticks = ticks_of(4, [1, 2, 3], 900, 40) + [(5000 + i, 9, 1_704_067_200_000_000 + d * DAY, p) for i, (d, p) in enumerate(((1, 1.0), (2, 9.0), (30, 1.0), (31, 9.0), (31.5, 1.0)))]
    ticks = sorted(((i, s, int(us), p) for i, s, us, p in ticks), key=lambda t: t[2])
    want = plain_alerts(ticks, RUNGS, RING, 6 * HOUR, 2 * DAY)
    table = spark.createDataFrame(ticks, "event_id long, symbol long, us long, price double")
    assert rows_of(ladder.batch_alerts(table, RUNGS, RING, 6 * HOUR, 2 * DAY)) == want and {True, False} == {w[4] for w in want}
    half = len(ticks) // 2
    path, out = f"{tmp_path}/ticks", f"file://{tmp_path}/out"
    stream = lambda: ladder.alerts(runs.event_stream(spark, path), RUNGS, RING, 6 * HOUR, 2 * DAY, "1 hour")
    write(spark, ticks[:half], path, 2)
    first = rows_of(ladder.drained(stream(), out))
    write(spark, ticks[half:], path, 2)
    assert rows_of(ladder.drained(stream(), out)) == want and first == [w for w in want if w[2] <= ticks[half - 1][2]]


def test_state_of_quiet_symbols_is_dropped(spark, tmp_path):
    start = 1_704_067_200_000_000
    ticks = [(i, i, start + i * 1_000_000, 1.0) for i in range(50)] + [(100 + d, 777, start + (3 + d) * DAY, 1.0) for d in range(12)]
    write(spark, ticks, f"{tmp_path}/ticks", 62)
    stream = ladder.alerts(runs.event_stream(spark, f"{tmp_path}/ticks", 31), RUNGS, RING, HOUR, HOUR, "1 hour")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ladder.STORE)
    try:
        run = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    due = spark.read.format("statestore").option("stateVarName", "due").load(f"{tmp_path}/c")
    assert [r.key.symbol for r in due.select("key").collect()] == [777]
    parts = spark.read.format("statestore").option("stateVarName", "short").load(f"{tmp_path}/c").count()
    assert 0 < parts <= ladder.PARTS + 2


class Calls:
    """State and timers of one symbol in memory, which count what is asked of them."""

    def __init__(self):
        self.short, self.value, self.timers, self.n = {}, None, set(), 0

    def _did(self, out=None):
        self.n += 1
        return out

    getMapState = getValueState = lambda self, *schema: self  # noqa: E731, N815
    iterator = lambda self: self._did(iter(sorted(self.short.items())))
    updateValue = lambda self, key, value: self._did(self.short.__setitem__(key, value))  # noqa: E731, N815
    removeKey = lambda self, key: self._did(self.short.pop(key))  # noqa: E731, N815
    get = lambda self: self._did(self.value)
    update = lambda self, value: self._did(setattr(self, "value", value))
    registerTimer = lambda self, millis: self._did(self.timers.add(millis))  # noqa: E731, N815
    deleteTimer = lambda self, millis: self._did(self.timers.remove(millis))  # noqa: E731, N815


@pytest.mark.parametrize(("n", "batches"), [(60, 3), (4000, 3), (4000, 60)])
def test_a_batch_of_a_symbol_takes_few_calls(n, batches):
    ticks = ticks_of(n, [1], n, 30)
    state, processor, out = Calls(), ladder.LadderProcessor(RUNGS, RING, 6 * HOUR, 2 * DAY), []
    processor.init(state)
    rows = [(s, i, us, price, None) for i, s, us, price in ticks]
    for k in range(batches):
        before = state.n
        out += [tuple(r) for r in processor.handleInputRows((1,), iter(rows[n * k // batches : n * (k + 1) // batches]), None)]
        # a closed part is written once and removed once
        assert state.n - before <= (6 if n < 256 else 6 + 2 * (ladder.PARTS + 2)) and 0 < len(state.short) <= ladder.PARTS + 2
        assert len(state.timers) == 1 and min(state.timers) == state.value[0] > state.value[1] // 1000
    assert sorted(out) == plain_alerts(ticks, RUNGS, RING, 6 * HOUR, 2 * DAY)


@pytest.mark.parametrize("n", [1, 5])
def test_replay_is_ordered_whatever_the_number_of_files(spark, tmp_path, monkeypatch, data, n):
    monkeypatch.setattr(runs, "FILE_BYTES", 4000 // n)
    folder, batch = runs.in_order(spark, f"{data}/events.parquet")
    files = sorted(spark.read.parquet(folder).select("_metadata.file_path", "_metadata.file_modification_time", "ts").groupBy("file_path", "file_modification_time").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).collect(), key=lambda r: r.file_modification_time)
    assert len(files) > 3 and len({r.file_modification_time for r in files}) == len(files) and all(x.b <= y.a for x, y in zip(files, files[1:], strict=False))
    assert 1 <= batch <= len(files) and spark.read.parquet(folder).count() == 1000


def test_heartbeat_by_batch_and_source(spark, tmp_path):
    write(spark, ticks_of(2, [1], 90, 3), f"{tmp_path}/ticks", 3)
    beats = progress.heartbeat(runs.event_stream(spark, f"{tmp_path}/ticks"), "wt", ["view", "none"])
    every = {(r.batch, r.source): (r.n, r.newest) for r in beats.collect()}
    assert sorted(every, key=str) == sorted(((b, s) for b in range(3) for s in (None, "view", "none")), key=str)
    assert all(every[b, None] == every[b, "view"] and every[b, None][0] == 30 and every[b, "none"] == (0, None) for b in range(3))
    assert {(r.source, r.n, r.age) for r in progress.staleness(beats).collect()} == {("view", 90, 0), ("none", 0, None)}
