"""The replay window as a stream: an extension; batches do it by tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def without_replays(stream: DataFrame, *, key: str = "txn_id", event_ts: str = "txn_ts", late: str = "3 days") -> DataFrame:
    """The first row of each key within the watermark; the state of older keys is dropped."""
    return stream.withWatermark(event_ts, late).dropDuplicatesWithinWatermark([key])
