"""Tables that many queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import ret
from ..operators import bars as B
from ..operators.slices import following, slice_width
from ..sources import tables

STEP = 6 * B.HOUR
TAKER = ("purchase", "signup")


def bars(spark: SparkSession, folder: str, step: int = STEP) -> DataFrame:
    """Six-hour bars of the ticks, with the magnitude as size."""
    return B.roll_up(tables.ticks(spark, folder), "symbol", "us", step, "price", F.col("k"), F.col("wt").isin(*TAKER))


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """Ticks as alerts with their day and the returns to the next and third next tick of the symbol."""
    ticks = tables.ticks(spark, folder)
    ahead = following(ticks, ["symbol"], ["us", "event_id"], ["price"], [1, 3], slice_width(ticks, ["symbol"], "us"))
    return ahead.select(*ticks.columns, F.floor(F.col("us") / B.DAY).alias("day"), ret("price_1", "price").alias("f1"), ret("price_3", "price").alias("f3"))


def cross_section(spark: SparkSession, folder: str) -> DataFrame:
    """Supplier by month: two scores, a price and its change to the supplier's next month."""
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    months = tables.read(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("s"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("m"))
    months = months.agg(cents("l_discount").alias("sd"), cents("l_tax").alias("st"), F.count("*").alias("n"), F.try_divide(F.sum("l_extendedprice"), F.sum("l_quantity")).alias("px"))
    f1 = ret(F.lead("px").over(Window.partitionBy("s").orderBy("m")), "px")
    return months.select("s", "m", "n", (F.col("sd").cast("double") / F.col("n")).alias("score"), (F.col("st").cast("double") / F.col("n")).alias("alt"), "px", f1.alias("f1"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums taken in another order compare equal."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
