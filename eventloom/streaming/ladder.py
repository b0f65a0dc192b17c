"""The price ladder with its cooldowns as one stateful stream: a ring of samples at two resolutions per symbol, dropped by timers."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .runs import drain

#: State that the processor keeps lives in this store; the built-in one has neither lists, maps nor timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The ring of full rate is stored in parts: only the newest is written again, and parts that have run out are removed whole. A part is closed once it
#: spans one in PARTS of the ring and holds PART_SAMPLES, so most symbols have one and a busy one no more than PARTS and two.
PARTS, PART_SAMPLES = 8, 256
#: What else is kept of a symbol: when its timer is due, its newest tick, the thinned ring and the rungs' last alerts.
SYMBOL = "millis long, newest long, at array<long>, px array<double>, rungs array<string>, stored array<long>, pushed array<long>"
ALERTS = "event_id long, symbol long, us long, rung string, pushed boolean"
ALERT = Row("event_id", "symbol", "us", "rung", "pushed")


@dataclass(frozen=True)
class Ring:
    """Samples of the last `short` microseconds at full rate, and of the last `long` one for each `step`."""

    short: int
    step: int
    long: int


class _Samples:
    """One resolution of a symbol's ring."""

    def __init__(self, at: list[int], px: list[float]) -> None:
        self.at, self.px = at, px

    def add(self, us: int, price: float) -> None:
        self.at.append(us)
        self.px.append(price)

    def before(self, us: int, oldest: int) -> tuple[int, float] | None:
        """The last sample at or before `us` that isn't older than `oldest`."""
        i = bisect_right(self.at, us) - 1
        return (self.at[i], self.px[i]) if i >= 0 and self.at[i] >= oldest else None


class _Parts(_Samples):
    """A ring that map state holds in parts (times, prices), whose keys rise with time."""

    def __init__(self, state, length: int) -> None:
        super().__init__([], [])
        self.state, self.width = state, -(-length // PARTS)
        parts = sorted((key[0], list(at), list(px)) for key, (at, px) in state.iterator())
        self.closed, self.newest = [(key, at[-1]) for key, at, _ in parts[:-1]], parts[-1][0] if parts else None
        for _, at, px in parts:
            self.start = len(self.at)
            self.at += at
            self.px += px
        if not parts:
            self.start = 0

    def save(self, oldest: int) -> None:
        """Writes the newest part and those that follow it, and removes those that lie wholly before `oldest`."""
        for key, last in self.closed:
            if last < oldest:
                self.state.removeKey((key,))
        low = max(self.start, bisect_left(self.at, oldest))
        key = self.at[low] if self.newest is None else self.newest
        while low < len(self.at):
            high = min(max(low + PART_SAMPLES, bisect_left(self.at, self.at[low] + self.width, low)), len(self.at))
            self.state.updateValue((key,), (self.at[low:high], self.px[low:high]))
            low = high
            if low < len(self.at):
                key = max(key + 1, self.at[low])


class LadderProcessor(StatefulProcessor):
    """Alerts of a symbol's ticks: a rung (name, window, percent) fires when the price has changed by at least its percent against the last sample at
    or before its window, and no alert of the rung was stored within `store`; of stored ones those are pushed that have none pushed within `push`.

    Ticks of a micro-batch are taken in order of time; those without a finite price are passed over. A sample enters the long ring when the last one
    there is `step` back. State is what the rings and cooldowns can still need: a timer at a tick plus the longest of them drops it all, or waits
    on if newer ticks have come. Calls to the state are what a quiet symbol costs, so a batch reads and writes each of its two variables once.
    """

    def __init__(self, rungs: list[tuple[str, int, float]], ring: Ring, store: int, push: int) -> None:
        self.rungs, self.ring, self.store, self.push = rungs, ring, store, push
        self.keep = max(ring.short, ring.long, store, push)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.short = handle.getMapState("short", "part long", "at array<long>, px array<double>")
        self.due = handle.getValueState("due", SYMBOL)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        # by place, as a name is looked up anew in each row; the key comes first or again
        ticks = sorted((us, event_id, price) for *_, event_id, us, price, _ in rows if price is not None and math.isfinite(price))
        if not ticks:
            return
        short, known = _Parts(self.short, self.ring.short), self.due.get()
        millis, newest, at, px, names, stored, pushed = known or (None, None, [], [], [], [], [])
        long, fired = _Samples(list(at), list(px)), {n: (s, p) for n, s, p in zip(names, stored, pushed, strict=True)}
        for us, event_id, price in ticks:
            newest = us
            short.add(us, price)
            if not long.at or us - long.at[-1] >= self.ring.step:
                long.add(us, price)
            for name, window, least in self.rungs:
                # both rings merged: the later of what each still holds
                found = [x for x in (short.before(us - window, us - self.ring.short), long.before(us - window, long.at[-1] - self.ring.long)) if x]
                if not found or (past := max(found)[1]) == 0:
                    continue
                stored, pushed = fired.get(name, (None, None))
                if abs(round((price / past - 1) * 100, 4)) >= least and (stored is None or us - stored >= self.store):
                    push = pushed is None or us - pushed >= self.push
                    fired[name] = (us, us if push else pushed)
                    yield ALERT(event_id, key[0], us, name, push)
        short.save(newest - self.ring.short)
        first = bisect_left(long.at, long.at[-1] - self.ring.long)
        if millis is not None and newest // 1000 >= millis:
            # ticks have passed what the timer waits for: moved here, it needn't be looked at when it fires
            self.handle.deleteTimer(millis)
            millis = None
        if millis is None:
            millis = self._look_again(newest)
        self.due.update((millis, newest, long.at[first:], long.px[first:], list(fired), [s for s, _ in fired.values()], [p for _, p in fired.values()]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        millis, newest, *rest = self.due.get()
        if self._after(newest) > millis:
            self.due.update((self._look_again(newest), newest, *rest))
        else:
            self.short.clear()
            self.due.clear()
        return iter(())

    def _after(self, newest: int) -> int:
        return (newest + self.keep) // 1000 + 1

    def _look_again(self, newest: int) -> int:
        """A timer for when nothing that came up to `newest` can matter any more; until it fires, newer ticks need none."""
        self.handle.registerTimer(self._after(newest))
        return self._after(newest)

    def close(self) -> None:
        pass


def alerts(stream: DataFrame, rungs: list[tuple[str, int, float]], ring: Ring, store: int, push: int, lag: str) -> DataFrame:
    """Alerts (event_id, symbol, us, rung, pushed) of a tick stream; ticks more than `lag` behind the newest are dropped."""
    ticks = stream.withWatermark("ts", lag).select("symbol", "event_id", "us", "price", "ts")
    return ticks.groupBy("symbol").transformWithState(LadderProcessor(rungs, ring, store, push), ALERTS, "append", "eventTime")


def drained(stream: DataFrame, out: str | None = None) -> DataFrame:
    """`drain` for streams with such state; with a folder `out`, what an earlier run has left there goes on."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, STORE)
    try:
        return drain(stream, out)
    finally:
        conf.set(name, before)


def batch_alerts(ticks: DataFrame, rungs: list[tuple[str, int, float]], ring: Ring, store: int, push: int) -> DataFrame:
    """The same alerts of a table of ticks (event_id, symbol, us, price), by joins: what the stream must give when it has read all."""
    from ..functions.scalars import finite
    from ..operators.asof import asof
    from ..operators.detect import cooled_down

    ticks = ticks.select("event_id", "symbol", "us", finite(F.col("price")).alias("price")).where("price IS NOT NULL")
    every = ticks.select("symbol", F.col("us").alias("t"), "price")
    thin = cooled_down(ticks.select("symbol", "us", "price"), ["symbol"], "us", ring.step).select("symbol", F.col("us").alias("t"), "price")
    newest = asof(ticks.withColumn("t", F.col("us")), thin, "symbol", "t", [], known="l").drop("t")
    hits = None
    for name, window, least in rungs:
        e = asof(newest.withColumn("t", F.col("us") - window), every, "symbol", "t", ["price"], known="a", prefix="s_")
        e = asof(e, thin, "symbol", "t", ["price"], known="a", prefix="l_")
        past = F.when(F.col("us") - F.col("s_a") <= ring.short, F.col("s_price")).when(F.col("l") - F.col("l_a") <= ring.long, F.col("l_price"))
        change = F.round((F.col("price") / F.nullif(past, F.lit(0.0)) - 1) * 100, 4)
        hit = e.where(F.abs(change) >= least).select("event_id", "symbol", "us", F.lit(name).alias("rung"))
        hits = hit if hits is None else hits.unionByName(hit)
    stored = cooled_down(hits, ["symbol", "rung"], "us", store)
    pushed = cooled_down(stored, ["symbol", "rung"], "us", push).select("event_id", "rung", F.lit(True).alias("pushed"))
    return stored.join(pushed, ["event_id", "rung"], "left").select("event_id", "symbol", "us", "rung", F.coalesce("pushed", F.lit(False)).alias("pushed"))
