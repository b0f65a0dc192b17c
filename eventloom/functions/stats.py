"""Robust statistics as grouped aggregates; nothing is collected."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by |; other engines can evaluate the same formula."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))), 1, 8), 16, 10).cast("double") / 4294967296.0


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, Abramowitz and Stegun 7.1.26 (absolute error up to 1.5e-7)."""
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def normal_p(t: Column) -> Column:
    """Two-sided p-value of a normal score."""
    return erfc(F.abs(t) / F.sqrt(F.lit(2.0)))


def summary(x: str) -> list[Column]:
    c = F.col(x)
    return [F.count(c).alias("n"), F.avg(c).alias("mean"), F.avg(F.when(c.isNotNull(), (c > 0).cast("double"))).alias("win")]


def one_sample_t(x: str, when_flat: Column | None = None) -> Column:
    """t of the mean; for zero deviation `when_flat` (null by default)."""
    sd = F.stddev_samp(x)
    return F.when(sd > 0, F.avg(x) / (sd / F.sqrt(F.count(x)))).otherwise(F.lit(None).cast("double") if when_flat is None else when_flat)


def correlation(a: str, b: str) -> Column:
    """Pearson's r of the rows that have both; null where one doesn't vary."""
    x, y = (F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c)) for c in (a, b))
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y)))


def clustered_t(df: DataFrame, cells: list[str], cluster: str, x: str) -> DataFrame:
    """Per cell n, clusters, mean and cluster-robust t: the mean over sqrt(sum over clusters of squared residual sums) / n."""
    per = df.where(F.col(x).isNotNull()).groupBy(*cells, cluster).agg(F.sum(x).alias("__s"), F.count(x).alias("__n"))
    # sum of (s - n m)^2 = sum s^2 - 2 m sum s n + m^2 sum n^2, so one more pass over cluster sums is enough
    out = per.groupBy(*cells).agg(F.sum("__n").alias("n"), F.count("*").alias("clusters"), F.sum("__s").alias("__S"), F.sum(F.col("__s") ** 2).alias("__ss"), F.sum(F.col("__s") * F.col("__n")).alias("__sn"), F.sum(F.col("__n") ** 2).alias("__nn"))
    m = F.col("__S") / F.col("n")
    spread = F.col("__ss") - 2 * m * F.col("__sn") + m * m * F.col("__nn")
    return out.select(*cells, "n", "clusters", m.alias("mean"), F.when(spread > 0, m / (F.sqrt(spread) / F.col("n"))).alias("t"))


def cluster_mean_t(df: DataFrame, cells: list[str], cluster: str, x: str, least: int = 3) -> DataFrame:
    """t over cluster means, each cluster alike; null under `least` clusters."""
    means = df.groupBy(*cells, cluster).agg(F.avg(x).alias("__m")).where("__m IS NOT NULL")
    return means.groupBy(*cells).agg(F.count("*").alias("clusters"), F.avg("__m").alias("mean"), F.when(F.count("*") >= least, one_sample_t("__m")).alias("t"))


def leave_one_out(df: DataFrame, cells: list[str], group: str, x: str) -> DataFrame:
    """Per cell the smallest mean without one group, the group whose loss gives it, and the mean without the best group."""
    per = df.where(F.col(x).isNotNull()).groupBy(*cells, group).agg(F.sum(x).alias("__s"), F.count(x).alias("__n"))
    w = Window.partitionBy(*cells)
    rest = per.withColumn("__rest", (F.sum("__s").over(w) - F.col("__s")) / F.nullif(F.sum("__n").over(w) - F.col("__n"), F.lit(0)))
    return rest.groupBy(*cells).agg(F.count("*").alias("groups"), F.min("__rest").alias("worst_mean"), F.min_by(group, F.struct("__rest", group)).alias("worst_group"), F.max("__rest").alias("best_mean"), F.min_by("__rest", F.struct(-F.col("__s"), group)).alias("drop_top_mean"))


def concentration(df: DataFrame, cells: list[str], group: str, x: str) -> DataFrame:
    """Largest group's share of the signed total, of the sum of absolute group totals and of the positive total."""
    per = df.where(F.col(x).isNotNull()).groupBy(*cells, group).agg(F.sum(x).alias("__s"))
    return per.groupBy(*cells).agg(
        F.max_by(group, F.struct("__s", F.negate(F.col(group)))).alias("top_group"), (F.max("__s") / F.nullif(F.sum("__s"), F.lit(0.0))).alias("signed_share"),
        (F.max(F.abs("__s")) / F.nullif(F.sum(F.abs("__s")), F.lit(0.0))).alias("absolute_share"), (F.max(F.greatest("__s", F.lit(0.0))) / F.nullif(F.sum(F.greatest("__s", F.lit(0.0))), F.lit(0.0))).alias("positive_share"),
    )


def bh(cells: DataFrame, p: str, by: list[str], level: float, order: list[str]) -> DataFrame:
    """Benjamini-Hochberg: q (running minimum of p m / rank from the top, at most 1) and pass (step-up at `level`) among rows with a p."""
    w = Window.partitionBy(*by)
    ranked = cells.where(F.col(p).isNotNull()).withColumn("__r", F.row_number().over(w.orderBy(p, *order))).withColumn("__m", F.count("*").over(w))
    ranked = ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__r")).over(w.orderBy("__r").rowsBetween(0, Window.unboundedFollowing))))
    last = F.max(F.when(F.col(p) <= F.col("__r") * level / F.col("__m"), F.col("__r"))).over(w)
    return ranked.withColumn("pass", F.coalesce(F.col("__r") <= last, F.lit(False))).drop("__r", "__m")


def _poisson(digest: Column) -> Column:
    """A Poisson(1) weight, up to 7, from the uniform that `uniform` takes from a hex md5.

    v / 2^32 < bound holds just if v < ceil(bound * 2^32), and numbers of eight hex digits order as their digits do: the text is compared as it is.
    """
    bounds, p, total = [], 0.36787944117144233, 0.0
    for k in range(7):
        total += p
        bounds.append(f"{math.ceil(total * 4294967296):08x}")
        p /= k + 1
    out = F.lit(7)
    for k in range(6, -1, -1):
        out = F.when(digest < bounds[k], F.lit(k)).otherwise(out)
    return out


def _replicates(sums: DataFrame, cells: list[str], unit: str, reps: int, seed: str) -> DataFrame:
    """Means of all replicates and what they say, from a sum __s and a count __n per unit that is drawn.

    Units are dealt out once to as many tasks as there is work for, as a few bytes of them already mean many hashes; they are weighted where they
    then lie, and only a row per task, cell and replicate is shuffled.
    """
    spark = sums.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    seeds = F.array(*(F.struct(F.lit(r).alias("rep"), F.lit(f"{seed}|{r}").alias("__seed")) for r in range(1, reps + 1)))
    spread = sums.select(*cells, "__s", "__n", F.col(unit).cast("string").alias("__unit")).repartition(tasks, "__unit").select("*", F.inline(seeds))
    spread = spread.withColumn("__w", _poisson(F.md5(F.concat_ws("|", "__seed", "__unit"))))
    means = spread.groupBy(*cells, "rep").agg((F.sum(F.col("__s") * F.col("__w")) / F.nullif(F.sum(F.col("__n") * F.col("__w")), F.lit(0))).alias("__m"))
    # a number per replicate and cell
    return means.groupBy(*cells).agg(F.count("__m").alias("reps"), F.avg((F.col("__m") <= 0).cast("double")).alias("p"), F.percentile("__m", F.lit(0.05)).alias("low"), F.percentile("__m", F.lit(0.95)).alias("high"))


def cluster_bootstrap(df: DataFrame, cells: list[str], cluster: str, x: str, reps: int, seed: str) -> DataFrame:
    """Per cell the share of replicates whose mean is not above zero, and the 5 % and 95 % points of the means.

    Clusters, not rows, get Poisson(1) weights from hashed uniforms: sums per cluster are taken first.
    """
    per = df.where(F.col(x).isNotNull()).groupBy(*cells, cluster).agg(F.sum(x).alias("__s"), F.count(x).alias("__n"))
    return _replicates(per, cells, cluster, reps, seed)


def row_bootstrap(df: DataFrame, cells: list[str], row_id: str, x: str, reps: int, seed: str) -> DataFrame:
    """The same with each row drawn by itself."""
    return _replicates(df.where(F.col(x).isNotNull()).select(*cells, row_id, F.col(x).alias("__s"), F.lit(1).alias("__n")), cells, row_id, reps, seed)


def sign_flips(df: DataFrame, cells: list[str], cluster: str, x: str, reps: int, seed: str) -> DataFrame:
    """(cell, rep, total under flips): one sign per cluster and replicate, shared by all cells; rep 0 is the data."""
    per = df.where(F.col(x).isNotNull()).groupBy(*cells, cluster).agg(F.sum(x).alias("__s"), F.count(x).alias("__n"))
    spread = per.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps))))
    sign = F.when((F.col("rep") == 0) | (uniform(F.lit(seed), F.col("rep"), F.col(cluster)) < 0.5), 1).otherwise(-1)
    return spread.groupBy(*cells, "rep").agg(F.sum(F.col("__s") * sign).alias("total"), F.sum("__n").alias("n"), F.sqrt(F.sum(F.col("__s") ** 2)).alias("norm"))


def with_average_ranks(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """rank_<c>: ranks from 1 within `by`, ties averaged."""
    for c in columns:
        df = df.withColumn(f"rank_{c}", F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2.0)
    return df
