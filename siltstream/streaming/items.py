"""A stream of items into the validated sink: flushes by time and size, a dead-letter side, a hook, flush and close."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from siltstream.sources.sinks import REQUIRED, write_items

#: Seconds between flushes.
INTERVAL = 5


class ItemSink:
    """Writes micro-batches of items with ``write_items``; each is one flush, and told to ``on_flush``.

    A flush comes every ``interval`` seconds with what has arrived; a source's own limit on files or rows a trigger
    bounds its size, ``rows_per_file`` that of a file. After a restart from the checkpoint a batch may be delivered
    again: its number is part of its folder, so it replaces itself and nothing is written twice.
    """

    def __init__(
        self, folder: str, required: tuple[str, ...] = REQUIRED, rules: dict[str, Column] | None = None, rows_per_file: int = 0,
        on_flush: Callable[[int, dict[str, int]], None] | None = None,
    ) -> None:
        self.folder, self.required, self.rules, self.rows_per_file, self.on_flush = folder, required, rules, rows_per_file, on_flush
        self.written, self.failed, self.flushes = 0, 0, 0
        self.query: StreamingQuery | None = None

    def __call__(self, batch: DataFrame, number: int) -> None:
        counts = write_items(batch, self.folder, rows_per_file=self.rows_per_file, required=self.required, rules=self.rules, batch=number)
        self.written, self.failed, self.flushes = self.written + counts["items"], self.failed + counts["failed"], self.flushes + 1
        if self.on_flush:
            self.on_flush(number, counts)

    def start(self, items: DataFrame, checkpoint: str, interval: float = INTERVAL) -> "ItemSink":
        """Begin to write a stream of items, from where ``checkpoint`` says that an earlier sink ended."""
        writer = items.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        self.query = writer.trigger(processingTime=f"{interval} seconds").start()
        return self

    def flush(self) -> None:
        """Return when all that had arrived is written."""
        if self.query is not None:
            self.query.processAllAvailable()

    def close(self) -> dict[str, int]:
        """Flush, stop, and tell how much was written."""
        if self.query is not None:
            self.flush()
            self.query.stop()
            self.query.awaitTermination()
            self.query = None
        return self.stats()

    def stats(self) -> dict[str, int]:
        return {"written": self.written, "failed": self.failed, "flushes": self.flushes}
