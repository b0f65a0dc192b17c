"""Keyed merges into tables, ledgers, gap lists and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch


def _first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def unseen(target: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row for each key of `new` that `target` doesn't have: what an idempotent append writes."""
    return _first(new, keys, order).join(target.select(*keys).distinct(), keys, "left_anti")


def first_wins(target: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """target with the unseen rows of new."""
    return target.unionByName(unseen(target, new, keys, order))


def last_wins(target: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last of both by `order`; the new one where that ties."""
    both = target.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return _first(both, keys, [*(c.desc() for c in order), F.desc("__new")]).drop("__new")


def record(target: DataFrame, new: DataFrame, keys: list[str], order: list[Column], ok: str, add: list[str]) -> DataFrame:
    """State per key (keys, the counters `add`, errors) after a batch of results: counters grow, and errors counts those since the last success.

    A key's errors before the batch count on unless the batch has a success of it. `order` tells a key's results apart in time.
    """
    own = new.select(*keys, *add, F.col(ok).alias("__ok"), F.struct(*order).alias("__at"))
    last = own.groupBy(*keys).agg(F.max(F.when(F.col("__ok"), F.col("__at"))).alias("__last"))
    own = own.join(last, keys).withColumn("__error", F.when(~F.col("__ok") & (F.col("__last").isNull() | (F.col("__at") > F.col("__last"))), 1).otherwise(0))
    batch = own.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in add), F.sum("__error").alias("errors"), F.max(F.col("__last").isNotNull()).alias("__reset"))
    t, n = target.select(*keys, *(F.col(c).alias(f"__t_{c}") for c in (*add, "errors"))), batch
    zero = lambda c: F.coalesce(c, F.lit(0))
    before = F.when(F.coalesce("__reset", F.lit(False)), 0).otherwise(zero("__t_errors"))
    return t.join(n, keys, "full_outer").select(*keys, *((zero(c) + zero(f"__t_{c}")).alias(c) for c in add), (zero("errors") + before).alias("errors"))


def _touched(spark: SparkSession, path: str, new: DataFrame, part: str) -> DataFrame:
    """The parts of a partitioned table that a batch has rows of; the others are neither listed nor read. Parts are few: days, or ranges of keys."""
    parts = [r[0] for r in new.select(part).distinct().collect()]
    schema = spark.read.parquet(path).schema
    return spark.read.schema(schema).parquet(path).where(F.col(part).isin(parts)).select(new.columns)


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: list[Column], part: str, *, last: bool) -> None:
    """Merges a batch into a table partitioned by `part`, which must follow from the keys, and rewrites only parts that the batch touches.

    The merged rows are written aside first, as a table can't be read while it is replaced, and then put in place by dynamic partition overwrite;
    a run that is cut short in between leaves the old parts.
    """
    target, scratch = _touched(spark, path, new, part), Scratch(spark)
    merged = scratch.stored((last_wins if last else first_wins)(target, new, [*keys, part], order))
    write_snapshot(merged, path, [part])
    scratch.drop(merged)


def append_unseen(spark: SparkSession, path: str, new: DataFrame, keys: list[str], order: list[Column], part: str) -> None:
    """Adds the rows of a batch whose keys the table, partitioned by `part`, doesn't have in the same part; nothing is rewritten."""
    scratch = Scratch(spark)
    rows = scratch.stored(unseen(_touched(spark, path, new, part), new, [*keys, part], order).select(new.columns))
    rows.write.mode("append").partitionBy(part).parquet(path)
    scratch.drop(rows)


def maintain(target: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Dimension (key, first_seen, active): first_seen never moves later, keys that `current` lacks become inactive."""
    t, c = target.select(key, F.col("first_seen").alias("__t")), current.select(key, F.col("first_seen").alias("__c"))
    return t.join(c, key, "full_outer").select(key, F.least("__t", "__c").alias("first_seen"), F.when(F.col("__c").isNotNull(), 1).otherwise(0).alias("active"))


def gaps(have: DataFrame, keys: list[str], at: str, low: int, high: int, step: int) -> DataFrame:
    """Head and tail ranges [start, end) that each key lacks of [low, high)."""
    span = have.groupBy(*keys).agg(F.min(at).alias("__a"), (F.max(at) + step).alias("__b"))
    part = F.explode(F.array(F.struct(F.lit("head").alias("gap"), F.lit(low).cast("long").alias("start"), F.col("__a").alias("end")), F.struct(F.lit("tail").alias("gap"), F.col("__b").alias("start"), F.lit(high).cast("long").alias("end"))))
    return span.select(*keys, part.alias("g")).select(*keys, "g.*").where("start < end")


def fold_journal(rows: DataFrame, trade: str, action: str, at: str) -> DataFrame:
    """Closed trades of a journal: fields of the entry and of the last exit; trades that were not closed are left out."""
    is_entry, is_exit = F.col(action) == "entry", F.col(action).isin("exit", "partial_exit")
    folded = rows.groupBy(trade).agg(
        F.min_by("price", F.when(is_entry, F.col(at))).alias("entry_px"), F.min(F.when(is_entry, F.col(at))).alias("entry_at"),
        F.max_by("price", F.when(is_exit, F.col(at))).alias("exit_px"), F.max(F.when(is_exit, F.col(at))).alias("exit_at"), F.count_if(is_exit).alias("n_exits"),
    )
    return folded.where("entry_at IS NOT NULL AND exit_at >= entry_at")


def write_split(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder per split, so that a job on dev never opens the sealed part."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def write_snapshot(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces only the (name, day) partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_daily(df: DataFrame, path: str, at: str) -> None:
    """Rows added as JSON lines to the folder of the UTC day of their time (microseconds)."""
    day = F.date_format(F.timestamp_micros(at), "yyyy-MM-dd")
    df.withColumn("dt", day).write.mode("append").partitionBy("dt").json(path)


def write_registered(df: DataFrame, path: str, registry: str, helpers: list[str]) -> None:
    """The table without its helper columns as Parquet, and a registry of its columns (feature, type) as JSON lines beside it."""
    public = df.drop(*helpers)
    public.write.mode("overwrite").parquet(path)
    df.sparkSession.createDataFrame(public.dtypes, "feature string, type string").coalesce(1).write.mode("overwrite").json(registry)


def write_results(df: DataFrame, path: str, p: str, kind: str = "json") -> None:
    """Results in order of p as JSON lines or CSV."""
    df.orderBy(p).write.mode("overwrite").option("header", True).format(kind).save(path)
