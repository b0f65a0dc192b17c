"""Readers: typed tables, keyed tick streams, line-wise JSON with an audit of bad lines, range scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Half-open date ranges of the splits of a study; what lies behind the last one is sealed.
SPLITS = (("dev", "2024-01-01", "2024-01-16"), ("val", "2024-01-16", "2024-01-23"), ("holdout", "2024-01-23", "2024-02-01"))


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder, by the suffix of its name (.csv, .json, .jsonl, .parquet; parquet without one); another suffix is an error."""
    stem, _, kind = name.rpartition(".")
    if not stem:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    if kind == "csv":
        return spark.read.option("header", True).csv(f"{folder}/{name}")
    if kind in ("json", "jsonl"):
        return spark.read.json(f"{folder}/{name}")
    if kind == "parquet":
        return spark.read.parquet(f"{folder}/{name}")
    raise ValueError(f"{name} is neither parquet, csv nor json")


def optional(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """A table that may be absent, which counts as one without rows, so that joins to it give nulls."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return read(spark, folder, name) if there else spark.createDataFrame([], schema)


def micros(column: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone, which then counts as UTC."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """The event stream as price samples: event_id, symbol, us, price, wt (kind), k (magnitude)."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return read(spark, folder, "events").select("event_id", F.col("user_id").alias("symbol"), micros("ts").alias("us"), F.col("value").alias("price"), F.col("event_type").alias("wt"), k.alias("k"))


def metric(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a slow series: key, us, value, priority."""
    return read(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), micros("o_orderdate").alias("us"), F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("priority"))


def range_scan(df: DataFrame, wanted: list[str], keys: DataFrame | None, key: str, at: str, low: int, high: int) -> DataFrame:
    """Rows with low <= at <= high whose key is in `keys`, in the wanted columns that exist; absent ones are null doubles."""
    have = [c for c in wanted if c in df.columns]
    out = df.where(F.col(at).between(low, high)).select(key, at, *(c for c in have if c not in (key, at)))
    out = out if keys is None else out.join(keys.select(key).distinct(), key, "left_semi")
    return out.withColumns({c: F.lit(None).cast("double") for c in wanted if c not in df.columns})


def parsed_lines(lines: DataFrame, column: str, schema: T.StructType | str) -> DataFrame:
    """Each JSON line's fields and a parse_status of ok or bad; bad lines stay, with null fields."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = F.from_json(column, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = lines.withColumn("__parsed", parsed)
    status = F.when(F.col("__parsed").isNull() | F.col("__parsed._bad").isNotNull(), "bad").otherwise("ok")
    return out.select(*lines.columns, *(F.col(f"__parsed.{f.name}").alias(f.name) for f in schema.fields), status.alias("parse_status"))


def split_of(date: Column) -> Column:
    """dev, val or holdout by date; null outside."""
    out = F.lit(None).cast("string")
    for name, low, high in SPLITS:
        out = F.when((date >= F.lit(low).cast("date")) & (date < F.lit(high).cast("date")), name).otherwise(out)
    return out


def column_of(df: DataFrame, candidates: tuple[str, ...], explicit: str | None = None) -> str:
    """The explicit column, else the first candidate that exists, else an error."""
    for c in (explicit,) if explicit else candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {explicit or candidates} in {df.columns}")
