"""Range joins: intervals are cut into buckets, which make an equi-join on (key, bucket), and the exact condition follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .slices import same


def points_in_intervals(intervals: DataFrame, points: DataFrame, key: str, low: str, high: str, at: str, width: int, *, closed_low: bool = True, closed_high: bool = True, how: str = "inner") -> DataFrame:
    """intervals joined with the points of their key inside them (how: inner, left_semi or left_anti). Choose `width` near the usual length.

    Each point has one bucket, so no pair comes twice.
    """
    last = F.greatest(F.floor(F.col(high) / width), F.floor(F.col(low) / width))
    cut = intervals.withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width), last)))
    points = points.withColumn("__b", F.floor(F.col(at) / width))
    a, b = cut.alias("a"), points.alias("b")
    inside = (F.col(f"b.{at}") >= F.col(f"a.{low}")) if closed_low else (F.col(f"b.{at}") > F.col(f"a.{low}"))
    inside &= (F.col(f"b.{at}") <= F.col(f"a.{high}")) if closed_high else (F.col(f"b.{at}") < F.col(f"a.{high}"))
    on = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.__b") == F.col("b.__b")) & inside
    if how == "inner":
        return a.join(b, on).select(*(F.col(f"a.{c}") for c in intervals.columns), *(F.col(f"b.{c}") for c in points.columns if c not in (key, "__b")))
    hit = a.join(b, on, "left_semi").select(*(F.col(f"a.{c}") for c in intervals.columns)).distinct()
    # repeated intervals stay as often as they come, and nulls in other columns equal each other
    names = [F.col(f"a.{c}") for c in intervals.columns]
    return intervals.alias("a").join(hit.alias("b"), same("a", "b", intervals.columns), "left_semi" if how == "left_semi" else "left_anti").select(*names)


def nearest(events: DataFrame, points: DataFrame, event_id: str, key: str, at: str, values: list[str], window: int, width: int) -> DataFrame:
    """The point nearest to each event within the window; ties go to the earlier. Events without one are left out."""
    spans = events.withColumns({"__low": F.col(at) - window, "__high": F.col(at) + window}).withColumnRenamed(at, "__e")
    pairs = points_in_intervals(spans, points.select(key, F.col(at).alias("__p"), *values), key, "__low", "__high", "__p", width)
    best = F.min_by(F.struct(F.col("__p").alias("near_at"), *values), F.struct(F.abs(F.col("__p") - F.col("__e")), "__p")).alias("__best")
    return pairs.groupBy(event_id).agg(best).select(event_id, "__best.*")


def interval_sum(intervals: DataFrame, points: DataFrame, ids: list[str], key: str, low: str, high: str, at: str, value: Column, width: int, name: str) -> DataFrame:
    """Sum over the points in each interval; zero where there are none. `ids` name a row of `intervals`."""
    sums = points_in_intervals(intervals, points, key, low, high, at, width).groupBy(*ids).agg(F.sum(value).alias(name))
    return intervals.join(sums, ids, "left").fillna(0, [name])
