"""Exit labels of events over the bars that follow, as windows over (event, offset) paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ret


def paths(bars: DataFrame, key: str, slot: str, n: int, hit: Column) -> DataFrame:
    """For each bar that is a hit, the next n bars of its key by row: (key, entry slot, entry close, offset, h, l, c).

    An array per entry is taken from one window over the key's bars and spread out again, so no join is needed; only hits carry one.
    """
    w = Window.partitionBy(key).orderBy(slot).rowsBetween(1, n)
    own = bars.withColumn("__path", F.collect_list(F.struct("h", "l", "c")).over(w)).where(hit)
    return own.select(key, F.col(slot).alias("entry"), F.col("c").alias("px"), F.posexplode("__path").alias("offset", "bar")).select(key, "entry", "px", (F.col("offset") + 1).alias("offset"), "bar.*")


def first_touch(path: DataFrame, key: str, take: float, stop: float, side: int = 1) -> DataFrame:
    """Exit of each entry: stop (looked at first within a bar), take, or time at the last close; result signed by side."""
    good = ret("h", "px") if side > 0 else -ret("l", "px")
    bad = -ret("l", "px") if side > 0 else ret("h", "px")
    moves = path.select(key, "entry", "offset", good.alias("good"), bad.alias("bad"), (side * (ret("c", "px"))).alias("end"))
    per = moves.groupBy(key, "entry").agg(F.min(F.when(F.col("good") >= take, F.col("offset"))).alias("t"), F.min(F.when(F.col("bad") >= stop, F.col("offset"))).alias("s"), F.max_by("end", "offset").alias("end"), F.max("offset").alias("last"))
    stopped = F.col("s").isNotNull() & (F.col("t").isNull() | (F.col("s") <= F.col("t")))
    return per.select(
        key, "entry", F.when(stopped, "stop").when(F.col("t").isNotNull(), "take").otherwise("time").alias("status"),
        F.when(stopped, F.col("s")).when(F.col("t").isNotNull(), F.col("t")).otherwise(F.col("last")).alias("held"),
        F.when(stopped, -stop).when(F.col("t").isNotNull(), take).otherwise(F.col("end")).alias("result"),
    )


def trailing(path: DataFrame, key: str, activate: float, giveback: float, stop: float, hold: int) -> DataFrame:
    """Long exits by giveback: once the best high has gained `activate`, a close at or below best * (1 - giveback) exits there; a close at or below
    the stop exits before that; otherwise the close after `hold` bars. Entries with a shorter path and no exit are left out.
    """
    w = Window.partitionBy(key, "entry").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    rows = path.withColumn("best", F.max(ret("h", "px")).over(w)).withColumn("now", ret("c", "px"))
    lock = F.col("best") * (1 - giveback)
    why = F.when(F.col("now") <= -stop, "stop").when((F.col("best") >= activate) & (F.col("now") <= lock), "trail").when(F.col("offset") == hold, "time")
    return rows.withColumn("why", why).where("why IS NOT NULL").groupBy(key, "entry").agg(F.min_by(F.struct(F.col("why").alias("status"), F.col("offset").alias("held"), F.col("now").alias("result")), "offset").alias("x")).select(key, "entry", "x.*")


def tiered(path: DataFrame, key: str, tiers: list[tuple[float, float]], stop: Column, confirmed: Column, grace: int, hold: int) -> DataFrame:
    """Long exits in the order time, stop, trail. The trail's giveback is that of the highest tier (gain, giveback) the best has reached; a trail exit
    waits for `grace` bars and for `confirmed`, and is booked at the floor. stop: a column of the path, as a positive share.
    """
    w = Window.partitionBy(key, "entry").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    rows = path.withColumn("best", F.max(ret("h", "px")).over(w)).withColumn("now", ret("c", "px"))
    give = F.lit(None).cast("double")
    for gain, back in sorted(tiers):
        give = F.when(F.col("best") >= gain, F.lit(back)).otherwise(give)
    rows = rows.withColumn("floor", F.col("best") * (1 - give))
    trail = F.col("floor").isNotNull() & (F.col("now") <= F.col("floor")) & (F.col("offset") > grace) & confirmed
    why = F.when(F.col("offset") == hold, "time").when(F.col("now") <= -stop, "stop").when(trail, "trail")
    result = F.when(F.col("why") == "trail", F.col("floor")).otherwise(F.col("now"))
    return rows.withColumn("why", why).where("why IS NOT NULL").groupBy(key, "entry").agg(F.min_by(F.struct(F.col("why").alias("status"), F.col("offset").alias("held"), result.alias("result")), "offset").alias("x")).select(key, "entry", "x.*")


def bracket(mfe: Column, mae: Column, end: Column, take: float, stop: float, worst: bool) -> Column:
    """Result from extremes only: if both barriers were touched, the stop (worst) or the take."""
    hit_take, hit_stop = mfe >= take, mae <= -stop
    first, then = ((hit_stop, -stop), (hit_take, take)) if worst else ((hit_take, take), (hit_stop, -stop))
    return F.when(first[0], F.lit(first[1])).when(then[0], F.lit(then[1])).otherwise(end)
