"""How a stream is doing: counts and newest times of each micro-batch, observed on the way and collected by a listener."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..sources.shared import shared_folder


class Beats(StreamingQueryListener):
    """Observed metrics of each micro-batch of one query, in order of batches."""

    def __init__(self, name: str) -> None:
        self.name, self.rows, self.ended = name, {}, threading.Event()
        self.run: str | None = None

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if event.name == self.name:
            self.run = str(event.runId)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.name == self.name and "beat" in p.observedMetrics and p.numInputRows:
            self.rows[p.batchId] = p.observedMetrics["beat"]

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if str(event.runId) == self.run:
            self.ended.set()


def heartbeat(stream: DataFrame, source: str, sources: list[str], wait: float = 60.0) -> DataFrame:
    """(batch, source, n, newest) of a stream's micro-batches for all rows (source null) and for each named value of a column.

    Rows only pass by: counts and newest times (column us) are taken where the stream runs anyway, and a row per batch reaches the driver.
    """
    spark, out = stream.sparkSession, shared_folder(stream.sparkSession)
    one = lambda i, of: [F.count(F.when(of, 1)).alias(f"n{i}"), F.max(F.when(of, F.col("us"))).alias(f"newest{i}")]
    parts = [(None, F.lit(True)), *((s, F.col(source) == s) for s in sources)]
    metrics = [m for i, (_, of) in enumerate(parts) for m in one(i, of)]
    beats = Beats(f"beat-{out.rpartition('/')[2]}")
    spark.streams.addListener(beats)
    try:
        run = stream.observe("beat", *metrics).writeStream.queryName(beats.name).format("noop").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
        if not beats.ended.wait(wait):  # progress reaches listeners some time after the query has ended
            raise TimeoutError("the stream's progress was not reported")
    finally:
        spark.streams.removeListener(beats)
    rows: list[Row] = [(batch, name, r[f"n{i}"], r[f"newest{i}"]) for batch, r in sorted(beats.rows.items()) for i, (name, _) in enumerate(parts)]
    return spark.createDataFrame(rows, "batch long, source string, n long, newest long")


def staleness(beats: DataFrame) -> DataFrame:
    """source, n, newest and age: how far each source's newest message lies behind the newest of all (null if it has none)."""
    total = beats.groupBy("source").agg(F.sum("n").alias("n"), F.max("newest").alias("newest"))
    now = total.where("source IS NULL").select(F.col("newest").alias("now"))  # one row
    return total.where("source IS NOT NULL").join(F.broadcast(now)).select("source", "n", "newest", (F.col("now") - F.col("newest")).alias("age"))
