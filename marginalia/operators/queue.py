"""The queue of pending changes: one entry per note, replayed in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.sorting import sort_once


def read_changes(changes: DataFrame) -> DataFrame:
    """The queue in replay order."""
    return sort_once(changes, "ts", "key", "seq")


def coalesce_changes(changes: DataFrame) -> DataFrame:
    """The last entry of each key: greatest ``ts``, then greatest ``seq``, which is unique.

    The winners are found on three narrow columns, aggregated before the shuffle, so
    a key with most of the entries sends one row per task and no body takes part.
    """
    winners = newest_entries(changes)
    return changes.join(winners.select("seq"), "seq", "left_semi").select(*changes.columns)


def newest_entries(changes: DataFrame) -> DataFrame:
    """``(key, ts, seq)`` of the newest entry of each key."""
    newest = F.max(F.struct("ts", "seq"))
    return changes.groupBy("key").agg(newest.alias("newest")).select("key", "newest.*")


def pending_count(changes: DataFrame) -> DataFrame:
    return changes.agg(F.count("*").alias("pending"))


def replay_prefix(results: DataFrame, queue: str = "client_id") -> DataFrame:
    """Mark what a replay that stops at the first failure gets done.

    ``results`` has ``ok`` per entry; an unknown result is a failure. Entries are
    replayed by ``(ts, key, seq)``. Those before the first failed one of their queue
    are ``applied``, that one is ``failed`` and the rest are ``queued``. The first
    failure per queue is a small aggregate, so a queue of any length stays spread
    over tasks.
    """
    place = F.struct("ts", "key", "seq")
    first = (
        results.filter(~F.coalesce(F.col("ok"), F.lit(False)))
        .groupBy(queue)
        .agg(F.min(place).alias("stop"))
    )
    status = (
        F.when(F.col("stop").isNull() | (place < F.col("stop")), "applied")
        .when(place == F.col("stop"), "failed")
        .otherwise("queued")
    )
    return results.join(first, queue, "left").withColumn("status", status).drop("stop")
