"""Stock movements applied as they arrive.

Every micro-batch is a replay on the store's current version and is committed as the next one: decisions,
ledger, documents, inventory and order status together. The version carries the batch's number, so a batch
that was committed before a failure is not applied again when the stream restarts, and one that was not leaves
nothing that anyone reads. Within a micro-batch movements are taken in ``seq`` order; across batches
in order of arrival, so there is no watermark. ``seq`` has to be unique within a micro-batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from binledger.operators import movements
from binledger.sources.snapshots import Snapshots


def apply_batch(commands: DataFrame, store: Snapshots, batch: str, now: Column | None = None) -> int:
    """Replay commands on the current version and commit them, unless ``batch`` has been committed."""
    done = store.version_of(batch)
    if done is not None:
        return done
    result = movements.replay(commands, store.load(), now)
    version = movements.commit_replay(result, store, batch)
    result.discard()  # the store has all of it
    return version


def start(commands: DataFrame, store: Snapshots, name: str, checkpoint: str, now: Column | None = None, **trigger) -> StreamingQuery:
    """Apply a stream of commands to a store. ``name`` tells the batches of this stream from those of others.

    ``checkpoint`` and ``name`` belong together: a new checkpoint counts batches from 0 again and needs a new name.
    """

    def each(batch: DataFrame, number: int) -> None:
        apply_batch(batch, Snapshots(batch.sparkSession, store.folder), f"{name}/{number}", now)

    return (
        commands.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
