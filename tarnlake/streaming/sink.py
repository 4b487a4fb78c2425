"""Structured Streaming into log tables, exactly once, and the change feed of a table by versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tarnlake.operators.logtable import LogTable


def write_stream(df: DataFrame, table: LogTable, app_id: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch is one commit that records (app_id, batch id); a batch that is replayed after a failure finds itself in the log and does nothing."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        table.refresh()
        if table.current.txns.get(app_id, -1) < batch_id:
            table.write(batch, "append", (app_id, batch_id))

    return df.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class ChangeReader:
    """Hands out a table's changes since the last call."""

    def __init__(self, table: LogTable, start: int = 0) -> None:
        self.table, self.next = table, start

    def poll(self) -> DataFrame | None:
        latest = self.table.latest_version()
        if latest < self.next:
            return None
        self.table.refresh()
        out = self.table.changes(self.next, latest)
        self.next = latest + 1
        return out
