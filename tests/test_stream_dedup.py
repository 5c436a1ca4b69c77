"""Deduplication of a feed with repeats beyond the horizon and late rows, against a replay of the batches."""

from __future__ import annotations

from datetime import datetime, timedelta

from underwright.session import scratch_path
from underwright.streaming.scoring import stream_dedup

START = datetime(2024, 1, 1)
#: Minutes after the start, by batch.
BATCHES = [
    [("a", 0), ("a", 5), ("b", 7), (None, 3)],
    [("a", 31), ("c", 40), (None, 44)],
    [("d", 190), ("c", 95)],  # the watermark is at 130 from the next batch on
    [("a", 191), ("z", 195)],  # a is still known
    [("a", 200), ("b", 20), ("d", 210), ("e", 100)],  # a comes again after the horizon; b and e are late
    [("a", 215), ("f", 500)],
    [("z", 501)],
    [("a", 560), ("f", 505), ("g", 300), ("c", 502)],
]


def replay(batches, horizon):
    """Rows that stay, by Spark's rules for a feed.

    The watermark of a batch comes from the batches before it. A row is late against the watermark of the batch before its own. At the
    end of a batch, ids go whose first row is older than the batch's watermark by the horizon.
    """
    kept, state, latest, watermark, late = [], {}, None, None, None
    for batch in batches:
        first = {}
        for i, t in batch:
            if late is None or t > late:
                first.setdefault(i, t)
        for i, t in first.items():
            if i not in state:
                kept.append(i)
                state[i] = t + horizon
        state = {i: until for i, until in state.items() if watermark is None or until > watermark}
        latest = max(t for _, t in batch) if latest is None else max(latest, *(t for _, t in batch))
        late, watermark = watermark, latest - horizon
    return sorted(kept, key=str)


def test_repeats_beyond_the_horizon_and_late_rows(spark):
    path, out, checkpoint = (scratch_path(spark, k) for k in ("feed", "kept", "checkpoint"))
    for batch in BATCHES:
        rows = [(i, START + timedelta(minutes=t)) for i, t in batch]
        spark.createDataFrame(rows, "customer_id string, ts timestamp").coalesce(1).write.mode("append").parquet(path)

    def run():
        stream = spark.readStream.schema("customer_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
        query = stream_dedup(stream).select("customer_id").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()
        return sorted((r[0] for r in spark.read.schema("customer_id string").parquet(out).collect()), key=str)

    expected = replay(BATCHES, 60)
    assert expected.count("a") == 3 and expected.count("b") == 1 and expected.count("c") == 2 and "g" not in expected
    assert run() == expected
    # a restart from the checkpoint goes on with the state
    more = [("f", 520), ("g", 530), ("f", 470)]
    spark.createDataFrame([(i, START + timedelta(minutes=t)) for i, t in more], "customer_id string, ts timestamp").coalesce(1).write.mode("append").parquet(path)
    assert run() == replay([*BATCHES, more], 60)
