"""Replaying a stream of changes into a snapshot store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from marginalia.scratch import Scratch, scratch_scope
from marginalia.sources.commits import commit_changes


def apply_batch(
    batch: DataFrame, store: str, source: str, coalesce: bool = True, hold: bool = False
) -> int | None:
    """Commit one batch of changes; returns the snapshot number, or None if it is in already or empty.

    ``source`` is "stream#batch". Commits remember the last batch of every stream, so
    a batch that is delivered again after a failure is recognised and changes
    nothing, also if another stream has committed in between. With ``hold``, changes behind
    a client's first failed one wait in the store's queue (``commit_changes``).
    """
    spark = batch.sparkSession
    with scratch_scope(spark):
        changes = Scratch(spark, "batch").save(batch)
        if changes.isEmpty():
            return None
        return commit_changes(spark, store, changes, source, hold=hold, coalesce=coalesce)


def stream_apply(
    changes: DataFrame,
    store: str,
    checkpoint: str,
    trigger: dict | None = None,
    coalesce: bool = True,
    hold: bool = False,
) -> StreamingQuery:
    """Start replaying ``changes`` into ``store``.

    A batch writes the buckets it changes; by default the query takes all that is waiting
    and stops. Changes that are rejected stay readable in the snapshot's rejects.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, store, f"{checkpoint}#{batch_id}", coalesce, hold)

    return (
        changes.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
