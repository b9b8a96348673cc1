"""The access log as a stream: counts over windows, sessions, and co-access consolidated in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.link import co_access


def sessions(log: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Sessions of each user, batch or stream; late accesses join as long as the watermark lets them."""
    rows = log.withWatermark("accessed_at", watermark) if log.isStreaming else log
    return rows.groupBy("user_id", F.session_window("accessed_at", gap).alias("w")).agg(F.count("*").alias("accesses")).select("user_id", F.col("w.start").alias("started"), "accesses")


def window_counts(log: DataFrame, size: str = "1 hour", slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Accesses of each node in tumbling windows, or sliding ones."""
    rows = log.withWatermark("accessed_at", watermark) if log.isStreaming else log
    w = F.window("accessed_at", size, slide) if slide else F.window("accessed_at", size)
    return rows.groupBy("node_id", w.alias("w")).agg(F.count("*").alias("accesses")).select("node_id", F.col("w.start").alias("started"), "accesses")


def consolidate(stream: DataFrame, log_path: str, checkpoint: str, write: Callable[[DataFrame], None], seconds: int = 86400, least: int = 3) -> StreamingQuery:
    """Append each micro-batch to the log, which is a folder of days, and write the co-access edges of the time before its latest access.

    A batch is a folder of its own, so one that is run again replaces itself. The latest access is kept beside the log, and only the days of the
    look-back time are read."""
    state = f"{log_path.rstrip('/')}-latest"

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        dated = rows.withColumn("day", F.to_date("accessed_at"))
        dated.write.mode("overwrite").partitionBy("day").parquet(f"{log_path}/batch={number}")
        last = spark.read.schema(rows.schema).parquet(f"{log_path}/batch={number}").agg(F.max("accessed_at").cast("timestamp").alias("last")).first()[0]
        try:
            before = spark.read.parquet(state).agg(F.max("last")).first()[0]
        except AnalysisException:  # the first batch finds no state
            before = None
        last = max((x for x in (before, last) if x is not None), default=None)
        if last is None:
            return
        spark.createDataFrame([(last, number)], "last timestamp, number long").write.mode("overwrite").parquet(f"{state}/batch={number % 2}")
        end = F.lit(last).cast("timestamp")
        log = spark.read.option("basePath", log_path).parquet(f"{log_path}/batch=*").where(F.col("day") >= F.to_date(F.timestamp_seconds(F.unix_seconds(end) - seconds)))
        write(co_access(log, end, seconds, least))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
