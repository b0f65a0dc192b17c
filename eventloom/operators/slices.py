"""Cutting long groups: time lines into slices with a row per slice carried on, and values into levels of bounded size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that the window of one key may hold before its time line is cut, and bytes of a table below which no key can hold as many.
SLICE_ROWS, SMALL_BYTES = 2_000_000, 256 << 20


def estimated_bytes(df: DataFrame) -> int:
    """What the optimizer takes the table to weigh; it counts too much rather than too little."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def slice_width(rows: DataFrame, keys: list[str], at: str) -> int | None:
    """A width of time that cuts the largest key into slices of about a quarter of SLICE_ROWS; None where no key has so many rows.

    Large tables are counted, a row per key; only the largest one's count and times reach the driver.
    """
    if estimated_bytes(rows) < SMALL_BYTES:
        return None
    sizes = rows.where(F.col(at).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.min(at).alias("low"), F.max(at).alias("high"))
    top = sizes.agg(F.max(F.struct("n", "low", "high")).alias("top")).first().top
    if top is None or top.n <= SLICE_ROWS:
        return None
    return max(1, int(top.high - top.low) // math.ceil(4 * top.n / SLICE_ROWS))


def same(a: str, b: str, names: list[str]) -> Column:
    """Equality of columns under two aliases; nulls are equal."""
    out = F.lit(True)
    for n in names:
        out &= F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return out


def joined_back(rows: DataFrame, other: DataFrame, names: list[str]) -> DataFrame:
    """`rows` with the other columns of `other`, which has at most a row for each value of `names`; nulls are equal."""
    kept = [F.col(f"__a.{c}") for c in rows.columns]
    return rows.alias("__a").join(other.alias("__b"), same("__a", "__b", names), "left").select(*kept, *(F.col(f"__b.{c}") for c in other.columns if c not in names))


def carried(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], width: int | None, *, backward: bool = False) -> DataFrame:
    """Each of `columns` replaced by its last value that isn't null, up to the row and with it (the next one from the row on, if backward).

    order[0] is the time. With a width, windows run per key and slice, and a row per key and slice carries on what earlier (later) slices end with.
    """
    pick = F.first if backward else F.last
    bounds = (0, Window.unboundedFollowing) if backward else (Window.unboundedPreceding, 0)
    if width is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*bounds)
        return rows.withColumns({c: pick(c, ignorenulls=True).over(w) for c in columns})
    cut = rows.withColumn("__slice", F.floor(F.col(order[0]) / width))
    best = F.min_by if backward else F.max_by
    ends = cut.groupBy(*keys, "__slice").agg(*(best(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"{c}_end") for c in columns))
    along = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(*((1, Window.unboundedFollowing) if backward else (Window.unboundedPreceding, -1)))
    ends = ends.select(*keys, "__slice", *(pick(f"{c}_end", ignorenulls=True).over(along).alias(f"{c}_end") for c in columns))
    w = Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(*bounds)
    own = cut.withColumns({c: pick(c, ignorenulls=True).over(w) for c in columns})
    both = joined_back(own, ends, [*keys, "__slice"])
    return both.withColumns({c: F.coalesce(c, f"{c}_end") for c in columns}).select(*rows.columns)


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, width: int | None) -> DataFrame:
    """`name`: sum of `value` up to each row and with it, in the given order (whose first column is the time)."""
    if width is None:
        return rows.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    cut = rows.withColumn("__slice", F.floor(F.col(order[0]) / width))
    sums = cut.groupBy(*keys, "__slice").agg(F.sum(value).alias("__sum"))
    sums = sums.select(*keys, "__slice", F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)).alias("__sum"))
    own = cut.withColumn(name, F.sum(value).over(Window.partitionBy(*keys, "__slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return joined_back(own, sums, [*keys, "__slice"]).withColumn(name, F.col(name) + F.coalesce("__sum", F.lit(0))).drop("__slice", "__sum")


def following(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], steps: list[int], width: int | None) -> DataFrame:
    """Columns <c>_<n>: the value of c in the n-th row after each, for each of `steps`."""
    if width is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumns({f"{c}_{n}": F.lead(c, n).over(w) for c in columns for n in steps})
    most, held = max(steps), F.struct(*columns)
    cut = rows.withColumn("__slice", F.floor(F.col(order[0]) / width))
    w, whole = Window.partitionBy(*keys, "__slice").orderBy(*order), Window.partitionBy(*keys, "__slice")
    own = cut.withColumns({f"__{n}": F.lead(held, n).over(w) for n in steps}).withColumn("__left", F.count("*").over(whole) - F.row_number().over(w))
    # the first rows of a slice; as no slice is empty, the next `most` slices have all that may be needed
    heads = cut.select(*keys, "__slice", F.row_number().over(w).alias("__r"), held.alias("__v")).where(F.col("__r") <= most)
    heads = heads.groupBy(*keys, "__slice").agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "__v"))), lambda x: x["__v"]).alias("__heads"))
    along = Window.partitionBy(*keys).orderBy("__slice")
    none = F.array().cast(heads.schema["__heads"].dataType)
    heads = heads.select(*keys, "__slice", F.concat(*(F.coalesce(F.lead("__heads", n).over(along), none) for n in range(1, most + 1))).alias("__next"))
    both = joined_back(own, heads, [*keys, "__slice"])
    at = {n: F.when(F.col("__left") >= n, F.col(f"__{n}")).otherwise(F.get("__next", (F.lit(n - 1) - F.col("__left")).cast("int"))) for n in steps}
    return both.select(*rows.columns, *(at[n][c].alias(f"{c}_{n}") for c in columns for n in steps))


# -- levels of values

#: Parts of an octave, and parts that each of these is cut into: no level holds more than some millions of a group's values.
OCTAVE, PARTS = 512, 1 << 21


def coarse(v: Column) -> Column:
    """A whole number that grows with v, by sign and logarithm: some million values cover all doubles. NaN comes last, null is null."""
    size = F.floor(F.log2(F.abs(v)) * OCTAVE).cast("long") + 1100 * OCTAVE
    return F.when(F.isnan(v.cast("double")), F.lit(1 << 40)).when(v == 0, F.lit(0)).when(F.abs(v.cast("double")) == F.lit(math.inf), F.signum(v).cast("long") * (1 << 39)).otherwise(F.signum(v).cast("long") * size)


def fine(v: Column, low: Column, high: Column) -> Column:
    """Which of PARTS equal parts of low..high holds v."""
    share = (v.cast("double") - low.cast("double")) / F.nullif(high.cast("double") - low.cast("double"), F.lit(0.0))
    return F.coalesce(F.floor(share * (PARTS - 1)), F.lit(0))
