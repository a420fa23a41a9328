"""Appending a stream to a table: each micro-batch is one transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from millrace.engine import Engine
from millrace.errors import TransactionConflict


def append_stream(stream: DataFrame, engine: Engine, table: str, checkpoint: str, attempts: int = 10) -> StreamingQuery:
    """Start a query that appends what is there now and stops. A batch that loses a conflict is tried again.

    ``checkpoint`` holds the stream's progress; keep it in a folder that all executors share.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        for k in range(attempts):
            try:
                engine.connect().insert(table, batch)
                return
            except TransactionConflict:
                if k == attempts - 1:
                    raise

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
