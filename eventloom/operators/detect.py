"""Detection of events on price streams: changes over time windows, cooldowns, waves, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..sources.shared import Scratch
from .slices import carried, estimated_bytes, same, slice_width


def change_over(price: Column, key: str, at: str, window: int) -> Column:
    """Percent change against the last sample at or before `window` ago; null without one, for zero or for non-finite prices."""
    price = finite(price)
    then = F.last(price, ignorenulls=True).over(Window.partitionBy(key).orderBy(at).rangeBetween(Window.unboundedPreceding, -window))
    return (price / F.nullif(then, F.lit(0.0)) - 1) * 100


def ladder(ticks: DataFrame, key: str, at: str, price: str, rungs: list[tuple[str, int, float]]) -> DataFrame:
    """A row for each rung (name, window, percent) that a tick's change reaches; rungs are independent."""
    out = ticks.withColumns({f"__{name}": change_over(F.col(price), key, at, window) for name, window, _ in rungs})
    hits = F.filter(F.array(*(F.struct(F.lit(n).alias("rung"), F.round(f"__{n}", 4).alias("change"), F.lit(t).alias("least")) for n, _, t in rungs)), lambda x: F.abs(x["change"]) >= x["least"])
    return out.withColumn("__hit", F.explode(hits)).select(*ticks.columns, "__hit.rung", "__hit.change")


#: Events of a stretch that are folded as one array; longer stretches are followed by doubled jumps. Bytes of a table that has none as long.
FOLD, FOLD_BYTES = 256, 1 << 13


def cooled_down(events: DataFrame, keys: list[str], at: str, gap: int, strict: bool = False) -> DataFrame:
    """Events at least `gap` (more, if strict) after the last one that was kept for their keys; the first is kept.

    An event whose predecessor is already that far back is kept whatever came before, so such events cut a key's line into stretches. Stretches of
    up to FOLD events are folded as arrays. In longer ones every event knows its successor, the first event far enough after it; the chain of
    those from a stretch's first event is what is kept. It is found by doubling: jumps of 1, 2, 4, ... successors take as many kept events to as
    many new ones, so n events cost n log n rows, no array and no task that holds a key. Null keys are a key like any other.
    """
    far = gap + 1 if strict else gap
    times = events.where(F.col(at).isNotNull()).select(*keys, F.col(at).cast("long").alias("__t")).distinct()
    width = slice_width(times, keys, "__t")
    before = times.select(*keys, "__t", F.col("__t").alias("__b"))
    if width is None:
        w = Window.partitionBy(*keys).orderBy("__t")
        before = before.withColumn("__b", F.lag("__t").over(w))
    else:
        shifted = before.withColumn("__b", F.lit(None).cast("long")).withColumn("__side", F.lit(0)).unionByName(before.withColumn("__side", F.lit(1)))
        before = carried(shifted, keys, ["__t", "__side"], ["__b"], width).where("__side = 0").drop("__side")
    root = F.when(F.col("__b").isNull() | (F.col("__t") - F.col("__b") >= far), F.col("__t"))
    runs = carried(before.withColumn("__root", root), keys, ["__t"], ["__root"], width).drop("__b")
    line = F.array_sort(F.collect_set("__t"))
    fold = F.aggregate(line, F.array().cast("array<bigint>"), lambda acc, t: F.when((F.size(acc) == 0) | (t - F.try_element_at(acc, F.lit(-1)) >= far), F.concat(acc, F.array(t))).otherwise(acc))
    if estimated_bytes(times) < FOLD_BYTES:
        chosen = runs.groupBy(*keys, "__root").agg(F.explode(fold).alias("__t")).select(*keys, "__t")
    else:
        scratch = Scratch(events.sparkSession)
        runs = scratch.stored(runs)
        sizes = scratch.stored(runs.groupBy(*keys, "__root").agg(F.count("*").alias("__n")).where(F.col("__n") > FOLD))
        on = same("a", "b", [*keys, "__root"])
        a, b = runs.alias("a"), sizes.alias("b")
        short = a.join(b, on, "left_anti").select(*(F.col(f"a.{c}") for c in runs.columns))
        chosen = short.groupBy(*keys, "__root").agg(F.explode(fold).alias("__t")).select(*keys, "__t")
        if sizes.head(1):
            long = a.join(b, on, "left_semi").select(*(F.col(f"a.{c}") for c in runs.columns))
            chosen = chosen.unionByName(_chain(scratch, long, keys, far, width))
    hit = events.alias("__a").join(chosen.withColumnRenamed("__t", at).alias("__b"), same("__a", "__b", [*keys, at]), "left_semi")
    return hit.select(*(F.col(f"__a.{c}") for c in events.columns))


def _chain(scratch: Scratch, runs: DataFrame, keys: list[str], far: int, width: int | None) -> DataFrame:
    """Times (columns keys and __t) on the chains of successors from the first event of each stretch (keys, __root)."""
    stretch = [*keys, "__root"]
    aimed = runs.select(*stretch, (F.col("__t") + far).alias("__at"), F.lit(0).alias("__side"), F.col("__t").alias("__from"), F.lit(None).cast("long").alias("__to"))
    # a time itself comes after the aims that equal it, so looking backward from an aim meets it
    own = runs.select(*stretch, F.col("__t").alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__from"), F.col("__t").alias("__to"))
    jump = carried(aimed.unionByName(own), stretch, ["__at", "__side"], ["__to"], width, backward=True).where("__from IS NOT NULL AND __to IS NOT NULL")
    jump = scratch.stored(jump.select(*stretch, "__from", "__to"))
    kept = scratch.stored(runs.where("__t = __root").select(*stretch, "__t"))
    names = [F.col(f"a.{c}") for c in stretch]
    while jump.head(1):
        more = kept.alias("a").join(jump.alias("b"), same("a", "b", stretch) & (F.col("a.__t") == F.col("b.__from"))).select(*names, F.col("b.__to").alias("__t"))
        twice = jump.alias("a").join(jump.alias("b"), same("a", "b", stretch) & (F.col("a.__to") == F.col("b.__from"))).select(*names, F.col("a.__from").alias("__from"), F.col("b.__to").alias("__to"))
        old = kept, jump
        kept, jump = scratch.stored(kept.unionByName(more)), scratch.stored(twice)
        scratch.drop(*old)
    return kept.select(*keys, "__t")


def waves(rows: DataFrame, key: str, at: str, hit: Column, gap: int) -> DataFrame:
    """Hits with a wave number: a new wave begins where the last hit is more than `gap` back."""
    w = Window.partitionBy(key).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(w) > gap, 1).otherwise(0)
    return rows.where(hit).withColumn("__new", new).withColumn("wave", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def run_length(rows: DataFrame, key: str, at: str, holds: Column, cap: int) -> DataFrame:
    """run: consecutive rows up to this one for which `holds`, at most cap."""
    w = Window.partitionBy(key).orderBy(at)
    out = rows.withColumn("__h", F.coalesce(holds, F.lit(False))).withColumn("__g", F.sum(F.when(F.col("__h"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.sum(F.when(F.col("__h"), 1).otherwise(0)).over(Window.partitionBy(key, "__g").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("run", F.least(n, F.lit(cap))).drop("__h", "__g")


def first_per(rows: DataFrame, keys: list[str | Column], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group; Spark keeps only n rows of a group in each task before it shuffles them."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
