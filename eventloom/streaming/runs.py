"""Running a stream over what is there, and streaming queries without state of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import HOUR
from ..sources import merge
from ..sources.shared import shared_folder


def event_stream(spark: SparkSession, pattern: str, files_per_batch: int = 1) -> DataFrame:
    """Ticks as a stream over the files that a path or glob names: event_id, symbol, ts, us, price, wt, k."""
    schema = spark.read.parquet(pattern).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
    ts = F.col("ts").cast("timestamp")
    return raw.select("event_id", F.col("user_id").alias("symbol"), ts.alias("ts"), F.unix_micros(ts).alias("us"), F.col("value").alias("price"), F.col("event_type").alias("wt"), F.get_json_object("props", "$.k").try_cast("int").alias("k"))


#: Bytes of a file of a replay, and files of a micro-batch for each core.
FILE_BYTES, FILES_PER_CORE = 64 << 20, 4


def in_order(spark: SparkSession, pattern: str, least: int = 3) -> tuple[str, int]:
    """(folder with the rows that a path or glob names, in files of consecutive times and ages; files that one micro-batch should read).

    A stream reads files by age. Where those of a table overlap in time, the first would move the watermark past rows of later ones. There are as
    many files as FILE_BYTES asks for, at least `least`, written by one job; only their ages are then set one by one, in the order of their times.
    A store that keeps no ages gets the files written once more, one after the other.
    """
    out, table = shared_folder(spark), spark.read.parquet(pattern)
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    files = max(least, -(-size // FILE_BYTES))
    table.repartitionByRange(files, "ts").sortWithinPartitions("ts").write.parquet(f"{out}/replay")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/replay")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((s.getPath() for s in store.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    began = store.getFileStatus(folder).getModificationTime() - 1000 * len(parts)
    for i, part in enumerate(parts):
        store.setTimes(part, began + 1000 * i, -1)
    batch = max(1, min(-(-files // least), FILES_PER_CORE * spark.sparkContext.defaultParallelism))
    if all(store.getFileStatus(p).getModificationTime() == began + 1000 * i for i, p in ((0, parts[0]), (len(parts) - 1, parts[-1])) if parts):
        return f"{out}/replay", batch
    for part in parts:
        spark.read.schema(table.schema).parquet(part.toString()).coalesce(1).write.mode("append").parquet(f"{out}/again")
    return f"{out}/again", batch


def drain(stream: DataFrame, out: str | None = None) -> DataFrame:
    """All that an append-mode stream gives for the data that is there, written once per row to the shared folder and read back.

    With a folder `out` an earlier run goes on from its checkpoint there.
    """
    spark, out = stream.sparkSession, out or shared_folder(stream.sparkSession)
    run = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def drain_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Calls handle(batch, number) for each micro-batch of what is there."""
    out = shared_folder(stream.sparkSession)
    run = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{out}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    run.awaitTermination()


def tumbling_bars(stream: DataFrame, width: str, lag: str) -> DataFrame:
    """Closed bars only: a window is given out once the watermark, `lag` behind the newest tick, has passed its end."""
    g = stream.withWatermark("ts", lag).groupBy("symbol", F.window("ts", width))
    return g.agg(F.min_by("price", "us").alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", "us").alias("c"), F.count("*").alias("trades")).select("symbol", F.unix_micros("window.start").alias("start"), "o", "h", "l", "c", "trades")


def sessions(stream: DataFrame, gap: str, lag: str) -> DataFrame:
    """Bursts: ticks of a symbol no more than `gap` apart."""
    g = stream.withWatermark("ts", lag).groupBy("symbol", F.session_window("ts", gap))
    return g.agg(F.count("*").alias("n")).select("symbol", F.unix_micros("session_window.start").alias("start"), F.unix_micros("session_window.end").alias("end"), "n")


def breadth(stream: DataFrame, width: str, lag: str) -> DataFrame:
    return stream.withWatermark("ts", lag).groupBy(F.window("ts", width)).agg(F.count("*").alias("n")).select(F.unix_micros("window.start").alias("start"), "n")


def change_over_snapshots(stream: DataFrame, width: str, slide: str, lag: str) -> DataFrame:
    """Change from the first to the last snapshot of sliding windows; null under two snapshots or from zero."""
    g = stream.withWatermark("ts", lag).groupBy("symbol", F.window("ts", width, slide))
    first, last = F.min_by("price", "us"), F.max_by("price", "us")
    return g.agg(F.count("*").alias("n"), first.alias("a"), last.alias("b")).select("symbol", F.unix_micros("window.start").alias("start"), "n", F.when((F.col("n") >= 2) & (F.col("a") != 0), F.col("b") / F.col("a") - 1).alias("change"))


def once(stream: DataFrame, keys: list[str], lag: str) -> DataFrame:
    """The first row for each key within the watermark; state beyond it is dropped."""
    return stream.withWatermark("ts", lag).dropDuplicatesWithinWatermark(keys)


def enriched(stream: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """Stream-static left join; a file table is read again for each micro-batch, so it may be refreshed meanwhile."""
    return stream.join(static, key, "left")


def routed(stream: DataFrame, push: str) -> tuple[DataFrame, DataFrame]:
    """(archive of all rows by day, rows that `push` holds for): two sinks from one pass over each micro-batch.

    A batch that runs again overwrites its own folder, so each row is written once.
    """
    spark, out = stream.sparkSession, shared_folder(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.withColumn("dt", F.floor(F.col("us") / (24 * HOUR))).write.mode("overwrite").partitionBy("dt").parquet(f"{out}/archive/batch={number}")
        batch.where(push).write.mode("overwrite").parquet(f"{out}/push/batch={number}")
        batch.unpersist()

    drain_batches(stream, write)
    return spark.read.parquet(f"{out}/archive").drop("batch"), spark.read.schema(stream.schema).option("basePath", f"{out}/push").parquet(f"{out}/push/batch=*")


def repaired(stream: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """target with the stream's rows for keys that it lacks: late rows fill gaps and never overwrite."""
    spark, out = stream.sparkSession, shared_folder(stream.sparkSession)
    target.write.parquet(f"{out}/table/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        table = spark.read.option("basePath", f"{out}/table").parquet(f"{out}/table").where(F.col("batch") != number).drop("batch")
        merge.unseen(table, batch, keys, [F.col("us")]).write.mode("overwrite").parquet(f"{out}/table/batch={number}")

    drain_batches(stream.select(target.columns), write)
    return spark.read.parquet(f"{out}/table").drop("batch")
