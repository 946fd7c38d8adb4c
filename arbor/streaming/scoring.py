"""Models on streams: scoring is a projection, so a streaming frame of points is scored like a stored one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from arbor.operators.models import Model


def score_stream(points: DataFrame, model: Model, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write predictions of a streaming frame ``(id, label, features array<double>)`` to Parquet, each input row once.

    once: take what is there and stop; else keep running.
    """
    writer = model.predict(points).select("id", "label", "prediction").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
