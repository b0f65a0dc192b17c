"""Bars from ticks, grids and indicators over bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ret, share
from .slices import joined_back, running_sum, slice_width

MINUTE, HOUR, DAY = 60_000_000, 3_600_000_000, 86_400_000_000


def roll_up(ticks: DataFrame, key: str, at: str, step: int, price: str, size: Column, taker: Column) -> DataFrame:
    """OHLC bars of `step` microseconds with volume, quote volume, trade count and taker-buy parts; ties in time go by event_id."""
    order = F.struct(at, "event_id")
    return ticks.groupBy(key, F.floor(F.col(at) / step).alias("slot")).agg(
        F.min_by(price, order).alias("o"), F.max(price).alias("h"), F.min(price).alias("l"), F.max_by(price, order).alias("c"),
        F.sum(size).alias("v"), F.sum(F.col(price) * size).alias("qv"), F.count("*").alias("trades"),
        F.sum(F.when(taker, size).otherwise(0)).alias("taker_v"), F.sum(F.when(taker, F.col(price) * size).otherwise(0.0)).alias("taker_qv"),
    )


def by_rows(key: str, at: str, low: int, high: int):
    return Window.partitionBy(key).orderBy(at).rowsBetween(low, high)


def change(c: str, key: str, at: str, n: int) -> Column:
    """Return over n rows back."""
    return ret(c, F.lag(c, n).over(Window.partitionBy(key).orderBy(at)))


def forward(c: str, key: str, at: str, n: int) -> Column:
    """Return over the next n rows, null beyond the end."""
    return ret(F.lead(c, n).over(Window.partitionBy(key).orderBy(at)), c)


def excursions(key: str, at: str, n: int) -> tuple[Column, Column]:
    """Most favourable and most adverse move from the close within the next n rows, for a long position."""
    w = by_rows(key, at, 1, n)
    return ret(F.max("h").over(w), "c"), ret(F.min("l").over(w), "c")


def full(value: Column, w, n: int) -> Column:
    """value only where the frame has n rows."""
    return F.when(F.count(F.lit(1)).over(w) == n, value)


def z_score(c: str, key: str, at: str, n: int, *, with_current: bool) -> Column:
    """Of the current row against n rows: with it (sample deviation) or only those before it (population deviation)."""
    w = by_rows(key, at, -n + 1, 0) if with_current else by_rows(key, at, -n, -1)
    sd = (F.stddev_samp if with_current else F.stddev_pop)(c).over(w)
    return full((F.col(c) - F.avg(c).over(w)) / F.nullif(sd, F.lit(0.0)), w, n)


def true_range(key: str, at: str) -> Column:
    before = F.coalesce(F.lag("c").over(Window.partitionBy(key).orderBy(at)), F.col("c"))
    return F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - before), F.abs(F.col("l") - before))


def with_atr(bars: DataFrame, key: str, at: str, n: int) -> DataFrame:
    """atr: mean true range of n rows as a share of the close."""
    w = by_rows(key, at, -n + 1, 0)
    return bars.withColumn("__tr", true_range(key, at)).withColumn("atr", full(share(F.avg("__tr").over(w), "c"), w, n)).drop("__tr")


def with_rsi(bars: DataFrame, key: str, at: str, n: int) -> DataFrame:
    """rsi by simple sums: 50 with too little history, 100 without losses."""
    w = by_rows(key, at, -n + 1, 0)
    d = F.col("__d")
    up, down = F.sum(F.greatest(d, F.lit(0.0))).over(w), F.sum(F.greatest(-d, F.lit(0.0))).over(w)
    value = F.when(F.count(d).over(w) < n, 50.0).when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / down))
    return bars.withColumn("__d", F.col("c") - F.lag("c").over(Window.partitionBy(key).orderBy(at))).withColumn("rsi", value).drop("__d")


def with_ema(bars: DataFrame, key: str, at: str, c: str, span: int, slices: int | str | None = "auto") -> DataFrame:
    """Recursive exponential mean (weight 2 / (span + 1), the first value as seed).

    A weighted running sum gives the recursion in one window: e(n) = q^n (x(0) + a sum x(i) / q^i); the scale q^i is taken in chunks of rows so
    that it stays within doubles. What a chunk ends with decays by q^rows through each later one, under 1e-55 a chunk, so what the six before it
    end with is all that a double can tell, and each row meets one number.
    """
    a, chunk = 2.0 / (span + 1), 64 * (span + 1)
    q = 1 - a
    width = slice_width(bars.select(key, at), [key], at) if slices == "auto" else slices
    rows = running_sum(bars.withColumn("__one", F.lit(1)), [key], [at], "__one", "__i", width).drop("__one")
    rows = rows.withColumn("__i", F.col("__i") - 1).withColumn("__chunk", F.floor(F.col("__i") / chunk)).withColumn("__j", F.col("__i") % chunk)
    own = F.when(F.col("__i") == 0, F.col(c)).otherwise(a * F.col(c))
    within = Window.partitionBy(key, "__chunk").orderBy("__j")
    rows = rows.withColumn("__s", F.pow(F.lit(q), F.col("__j")) * F.sum(own / F.pow(F.lit(q), F.col("__j"))).over(within))
    # a row per chunk; every chunk but a key's last has all its rows
    ends = rows.groupBy(key, "__chunk").agg(F.max_by("__s", "__j").alias("__end"))
    along = Window.partitionBy(key).orderBy("__chunk")
    before = sum((F.coalesce(F.lag("__end", n).over(along), F.lit(0.0)) * q ** (chunk * (n - 1)) for n in range(1, 7)), F.lit(0.0))
    out = joined_back(rows, ends.select(key, "__chunk", before.alias("__e")), [key, "__chunk"])
    return out.withColumn(f"ema_{span}", F.col("__s") + F.col("__e") * F.pow(F.lit(q), F.col("__j") + 1)).drop("__i", "__chunk", "__j", "__s", "__e")


def on_grid(bars: DataFrame, key: str, slot: str, c: str, *, fill: bool) -> DataFrame:
    """Every slot between a key's first and last, `c` null in gaps or carried forward."""
    span = bars.groupBy(key).agg(F.explode(F.sequence(F.min(slot), F.max(slot))).alias(slot))
    out = span.join(bars.select(key, slot, c), [key, slot], "left")
    return out.withColumn(c, F.last(c, ignorenulls=True).over(by_rows(key, slot, Window.unboundedPreceding, 0))) if fill else out
