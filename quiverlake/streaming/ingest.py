"""A stream of vectors into an index, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def ingest(stream: DataFrame, index, checkpoint: str, **trigger) -> StreamingQuery:
    """Insert each micro-batch of ``stream(vec, [vec_id], [metadata], [seq])`` into ``index``.

    Inserting is idempotent by content (K-means, which keeps duplicates, aside), so a batch that is replayed after a failure does no harm. ``trigger``
    is passed on, ``availableNow=True`` by default.
    """

    def insert(batch: DataFrame, _: int) -> None:
        index.insert(batch)

    return stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
