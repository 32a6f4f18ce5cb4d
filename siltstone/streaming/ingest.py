"""Continuous ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.table import Table


def upsert_stream(changes: DataFrame, table: Table, checkpoint: str, order_by: str | None = None, **trigger) -> StreamingQuery:
    """Each micro-batch of (key, value, op, order_by) is one atomic run of ``table``.

    The manifest version that adds the run also records the batch's number
    for ``checkpoint``, so a batch replayed after its commit is skipped and
    cannot overtake puts made since.  ``trigger`` as in
    ``DataStreamWriter.trigger``.
    """

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            table.upsert(batch, order_by=order_by, batch_id=(checkpoint, number))

    out = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(**trigger) if trigger else out).start()


def latest_stream(changes: DataFrame) -> DataFrame:
    """Newest (seq, op, value) per key of a stream of versioned rows; late rows do not win, their seq is smaller."""
    newest = F.max_by(F.struct("seq", "op", "value"), "seq").alias("_new")
    return changes.groupBy("key").agg(newest).select("key", "_new.seq", "_new.op", "_new.value")
