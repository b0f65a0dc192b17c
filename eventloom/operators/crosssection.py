"""Cross-sectional portfolios: legs by rank within a period, their spread, attribution and turnover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_legs(df: DataFrame, period: list[str], name: str, score: str, share: int, least: int) -> DataFrame:
    """leg 1 for the n div share highest scores of a period, -1 for as many lowest, else 0; ties go by name. Periods under `least` names go."""
    w = Window.partitionBy(*period)
    ranked = df.withColumns({"__n": F.count("*").over(w), "__low": F.row_number().over(w.orderBy(score, name)), "__high": F.row_number().over(w.orderBy(F.desc(score), name))})
    k = F.floor(F.col("__n") / share)
    leg = F.when(F.col("__high") <= k, 1).when(F.col("__low") <= k, -1).otherwise(0)
    return ranked.where(F.col("__n") >= least).withColumn("leg", leg).drop("__n", "__low", "__high")


def spread(legs: DataFrame, period: list[str], ret: str, cost: float = 0.0) -> DataFrame:
    """Per period the mean of the long leg minus that of the short leg, less the cost of both."""
    side = lambda s: F.avg(F.when(F.col("leg") == s, F.col(ret)))
    return legs.groupBy(*period).agg(F.count_if(F.col("leg") == 1).alias("names"), side(1).alias("long"), side(-1).alias("short")).withColumn("spread", F.col("long") - F.col("short") - 2 * cost)


def residuals(df: DataFrame, period: list[str], y: str, x: str, name: str) -> DataFrame:
    """Column `name`: y less its least-squares line on x within each period (y where x does not vary)."""
    w = Window.partitionBy(*period)
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    own = lambda c: F.when(both, F.col(c))
    mx, my = F.avg(own(x)).over(w), F.avg(own(y)).over(w)
    slope = F.covar_pop(own(y), own(x)).over(w) / F.nullif(F.var_pop(own(x)).over(w), F.lit(0.0))
    return df.withColumn(name, F.when(both, F.col(y) - my - F.coalesce(slope, F.lit(0.0)) * (F.col(x) - mx)))


def turnover(legs: DataFrame, period: str, name: str) -> DataFrame:
    """Share of each period's leg members that stay in the same leg in the next period that there is."""
    held = legs.where("leg <> 0").select(period, name, "leg")
    calendar = held.select(period).distinct().withColumn("__next", F.lead(period).over(Window.orderBy(period)))  # a row per period
    later = held.select(F.col(period).alias("__next"), name, "leg", F.lit(1).alias("__stays"))
    x = held.join(calendar, period).where("__next IS NOT NULL").join(later, ["__next", name, "leg"], "left")
    return x.groupBy(period, "leg").agg(F.avg(F.coalesce("__stays", F.lit(0))).alias("kept"))


def rank_correlation(df: DataFrame, by: list[str], a: str, b: str, least: int) -> DataFrame:
    from ..functions.stats import correlation, with_average_ranks

    r = with_average_ranks(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), by, [a, b])
    return r.groupBy(*by).agg(F.count("*").alias("n"), correlation(f"rank_{a}", f"rank_{b}").alias("ic")).where(F.col("n") >= least)


def demeaned(c: str, by: list[str]) -> Column:
    return F.col(c) - F.avg(c).over(Window.partitionBy(*by))
