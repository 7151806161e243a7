"""A change feed: every micro-batch of a stream goes to several receivers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


@dataclass(frozen=True)
class Receiver:
    """``send`` takes a batch and its number; a batch that is sent again after a failure has the same number."""

    send: Callable[[DataFrame, int], None]
    authenticated: bool = False


def to_table(folder: str) -> Callable[[DataFrame, int], None]:
    """Keeps every batch in a folder of its own number, so one that comes again replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")


def broadcast(changes: DataFrame, receivers: Sequence[Receiver], checkpoint: str, public: str = "public", **options: str) -> StreamingQuery:
    """Sends every change to all authenticated receivers and, where the flag ``public`` is set, to the others.

    Each batch is read once and kept while it is sent round. A null flag is not public.
    """

    def fan_out(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for r in receivers:
                r.send((kept if r.authenticated else kept.filter(F.coalesce(F.col(public), F.lit(False)))).drop(public), number)
        finally:
            kept.unpersist()

    return changes.writeStream.foreachBatch(fan_out).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start()
