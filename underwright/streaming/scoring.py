"""The same scoring on a feed: decisions and rejects to two sinks, deduplication, decision counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from underwright.operators.scoring import DEFAULT_THRESHOLD
from underwright.plans.batch_scoring import predict_batch
from underwright.sources.contract import ID


def applicant_stream(spark: SparkSession, path: str, ddl: str, files_per_batch: int | None = None) -> DataFrame:
    """Applicant files as a stream, under a declared schema."""
    reader = spark.readStream.schema(ddl)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], decisions: str, rejects: str, checkpoint: str,
                 threshold: float = DEFAULT_THRESHOLD, keep: tuple[str, ...] = (ID,), available_now: bool = True) -> StreamingQuery:
    """Validate and score every micro-batch; broken rows go to ``rejects``.

    Each batch overwrites its own folder, so a batch that is run again after a failure leaves no
    second copy.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            scored, rejected = predict_batch(batch, score, threshold, strict=False, keep=keep)
            scored.write.mode("overwrite").parquet(f"{decisions}/batch={number}")
            rejected.write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_dedup(stream: DataFrame, time_col: str = "ts", horizon: str = "1 hour", id_col: str = ID) -> DataFrame:
    """First row of each id within the horizon; state older than the watermark is dropped.

    Rows that are older than the watermark of the batch before are late and dropped. An id that comes again when its state is gone stays again.
    """
    return stream.withWatermark(time_col, horizon).dropDuplicatesWithinWatermark([id_col])


def decision_monitor(decided: DataFrame, time_col: str = "ts", width: str = "1 hour", delay: str | None = None) -> DataFrame:
    """Decisions and approval rate per tumbling window; on a stream, ``delay`` is the watermark."""
    rows = decided.withWatermark(time_col, delay) if delay else decided
    counts = rows.groupBy(F.window(time_col, width).alias("w")).agg(
        F.expr("count(*) AS n"), F.expr("count_if(decision = 'Approve') AS approved"),
        F.expr("count_if(decision = 'Reject') AS rejected"))
    return counts.selectExpr("w.start AS window_start", "n", "approved", "rejected", "round(approved / n, 4) AS approval_rate")
