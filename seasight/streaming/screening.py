"""Screening pixels as they arrive: every batch's tiles go to the history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from seasight.operators.screening import screen


def screen_stream(pixels: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the verdicts on each batch's tiles to ``path``; a batch run again replaces its own part."""

    def put(batch: DataFrame, number: int) -> None:
        screen(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pixels.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
