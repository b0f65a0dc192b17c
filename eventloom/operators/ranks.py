"""Exact positions and quantiles of groups of any size: running sums over three levels of values, so no window and no task holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .slices import coarse, fine, joined_back


def with_weight_before(values: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """`values` (one row per group and value) with __before, the weight of the group's smaller values, and __total, that of all.

    Values fall into parts of octaves, and each of these into equal parts between its smallest and largest value. Weights are summed per part, and
    running sums over the parts of a level and over the values of the last part add up. A window holds at most a few millions of rows whatever the
    group's size and distribution: parts of octaves are so many, parts of these PARTS, and no more different doubles lie in one of them.
    """
    up_to = (Window.unboundedPreceding, 0)
    first = values.withColumn("__p", coarse(F.col(value)))
    octaves = first.groupBy(*by, "__p").agg(F.sum(weight).alias("__w"), F.min(value).alias("__low"), F.max(value).alias("__high"))
    whole = Window.partitionBy(*by)
    along = whole.orderBy("__p").rowsBetween(*up_to)
    octaves = octaves.select(*by, "__p", "__low", "__high", (F.sum("__w").over(along) - F.col("__w")).alias("__b1"), F.sum("__w").over(whole).alias("__total"))
    second = joined_back(first, octaves, [*by, "__p"]).withColumn("__q", fine(F.col(value), F.col("__low"), F.col("__high"))).drop("__low", "__high")
    parts = second.groupBy(*by, "__p", "__q").agg(F.sum(weight).alias("__w"))
    along = Window.partitionBy(*by, "__p").orderBy("__q").rowsBetween(*up_to)
    parts = parts.select(*by, "__p", "__q", (F.sum("__w").over(along) - F.col("__w")).alias("__b2"))
    third = joined_back(second, parts, [*by, "__p", "__q"])
    inside = Window.partitionBy(*by, "__p", "__q").orderBy(value).rowsBetween(*up_to)
    own = F.sum(weight).over(inside) - F.col(weight)
    return third.withColumn("__before", F.col("__b1") + F.col("__b2") + own).drop("__p", "__q", "__b1", "__b2")


def quantiles(df: DataFrame, by: list[str], value: str, points: list[float], names: list[str], *, discrete: bool = False) -> DataFrame:
    """Per group the exact quantiles of a column, nulls left out, in columns `names`: interpolated as doubles, or values that are there if discrete.

    `by` may hold nulls, as groups of grouping sets do.
    """
    own = F.col(value) if discrete else F.col(value).cast("double")
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, own.alias("__v")).agg(F.count("*").alias("__n"))
    return weighted_quantiles(counted, by, "__v", "__n", points, names, discrete=discrete)


def weighted_quantiles(counted: DataFrame, by: list[str], value: str, weight: str, points: list[float], names: list[str], *, discrete: bool = False) -> DataFrame:
    """The same from a row per group and value with the number of rows that have it."""
    placed = with_weight_before(counted, by, value, weight).withColumnsRenamed({value: "__v", weight: "__n"})
    out = []
    for p, name in zip(points, names, strict=True):
        if discrete:
            rank = F.greatest(F.ceil(p * F.col("__total")), F.lit(1))
            out.append(F.max(F.when((F.col("__before") < rank) & (rank <= F.col("__before") + F.col("__n")), F.col("__v"))).alias(name))
            continue
        at = p * (F.col("__total") - 1)
        low = F.floor(at)
        # the weight that the values at the two neighbouring positions get
        parts = [F.when((F.col("__before") <= k) & (k < F.col("__before") + F.col("__n")), w).otherwise(0.0) for k, w in ((low, 1 - (at - low)), (low + 1, at - low))]
        out.append(F.sum(F.when(parts[0] + parts[1] > 0, F.col("__v") * (parts[0] + parts[1]))).alias(name))
    return placed.groupBy(*by).agg(*out)


def with_place(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """`df` with __place, from 0, in the order of a numeric column that is unique within its group, and __size of the group."""
    return with_weight_before(df.withColumn("__one", F.lit(1)), by, value, "__one").withColumnsRenamed({"__before": "__place", "__total": "__size"}).drop("__one")


def with_trailing_rank(rows: DataFrame, row_id: str, key: str, at: str, value: str, window: int) -> DataFrame:
    """`rows` with n, the key's rows in the last `window` before each (its own time left out), and below, how many of them have no larger value.

    A merge-sort tree without the tree: a key's rows are numbered by time, and number r lies in block r >> j of each level j. A trailing window is
    a run of numbers, so a few whole blocks of several levels, two a level at most. Each row goes into its blocks as a point and into those of its
    window as a question; in a block, sorted by value, a running count of points answers the questions. That is n log w rows, w rows in a window
    at most, blocks no larger than a window, and no array of rows.
    """
    w = Window.partitionBy(key).orderBy(at)
    placed = rows.select(row_id, key, value, (F.row_number().over(w) - 1).alias("__r"), F.count(F.lit(1)).over(w.rangeBetween(-window, -1)).alias("n"), F.min(at).over(w.rangeBetween(0, 0)).alias("__t"))
    # rows of one time have different numbers, and none of them is in the others' windows
    placed = placed.withColumn("__high", F.min("__r").over(Window.partitionBy(key, "__t"))).withColumn("__low", F.col("__high") - F.col("n"))
    most = placed.groupBy(key).agg(F.floor(F.log2(F.greatest(F.max("n"), F.lit(1)))).cast("int").alias("__levels"))  # a row per key
    placed = joined_back(placed, most, [key])
    level = lambda j, b: F.struct(j.alias("j"), b.alias("b"))

    def blocks(j):
        low, high = F.ceil(F.col("__low") / F.call_function("shiftleft", F.lit(1).cast("long"), j)).cast("long"), F.call_function("shiftright", F.col("__high").cast("long"), j)
        some = F.array(F.when(low % 2 == 1, level(j, low)), F.when(high % 2 == 1, level(j, high - 1)))
        return F.when(low < high, some).otherwise(F.array().cast("array<struct<j:int,b:bigint>>"))

    levels = F.sequence(F.lit(0), F.col("__levels"))
    points = placed.select(key, F.explode(F.transform(levels, lambda j: level(j, F.call_function("shiftright", F.col("__r").cast("long"), j)))).alias("__at"), value, F.lit(None).cast(rows.schema[row_id].dataType).alias(row_id), F.lit(0).alias("__side"))
    asked = placed.select(key, F.explode(F.filter(F.flatten(F.transform(levels, blocks)), lambda x: x.isNotNull())).alias("__at"), value, row_id, F.lit(1).alias("__side"))
    block = Window.partitionBy(key, "__at.j", "__at.b").orderBy(value, "__side").rowsBetween(Window.unboundedPreceding, 0)
    counted = points.unionByName(asked).withColumn("__c", F.count_if(F.col("__side") == 0).over(block)).where("__side = 1")
    below = counted.groupBy(row_id).agg(F.sum("__c").alias("below"))
    sizes = placed.select(row_id, "n")
    return rows.join(sizes, row_id).join(below, row_id, "left").withColumn("below", F.coalesce("below", F.lit(0)))
