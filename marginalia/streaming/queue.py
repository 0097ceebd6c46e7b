"""The change queue as a stream: one live entry per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

#: How long the state remembers that a key's newest entry was applied: a week.
KEEP_MS = 7 * 24 * 3600 * 1000
#: Keys share a state with those of the same bucket, as a call for each key would cost more than its entries.
BUCKETS = 1024
_PLACES = """key array<string>, ts array<bigint>, seq array<bigint>, done_ts array<bigint>, done_seq array<bigint>,
  due array<bigint>"""
_QUEUE = "key string, ts bigint, seq bigint, pending boolean"


def stream_coalesce(changes: DataFrame) -> DataFrame:
    """``(key, ts, seq, pending)``: the newest entry of each key so far; write it in ``update`` mode.

    "Newest" is by ``(ts, seq)``, so an entry that arrives late never replaces a
    newer one, and the result does not depend on how the stream was cut. A row with
    ``applied`` true (if there is such a column) reports the entry of its ``ts`` and
    ``seq`` as applied: the key is pending only while it has a newer one. The state is
    these few numbers per key; bodies stay in the log, under ``seq``.
    """
    if not changes.isStreaming:
        raise ValueError("stream_coalesce expects a streaming DataFrame")
    applied = F.coalesce(F.col("applied"), F.lit(False)) if "applied" in changes.columns else F.lit(False)
    place = F.struct("ts", "seq")
    latest = changes.groupBy("key").agg(
        F.max(F.when(~applied, place)).alias("newest"), F.max(F.when(applied, place)).alias("done")
    )
    pending = F.col("newest").isNotNull() & (F.col("done").isNull() | (F.col("newest") > F.col("done")))
    return latest.select("key", "newest.ts", "newest.seq", pending.alias("pending"))


def stream_pending(changes: DataFrame, keep_ms: int = KEEP_MS, clock_skew: str = "1 hour") -> DataFrame:
    """``stream_coalesce`` with a state that ends: what is pending, and for a while what was applied.

    ``changes`` has the column ``applied``. A key whose newest entry is reported as applied comes out once
    more, not pending, and leaves the state ``keep_ms`` and ``clock_skew`` of running time later, with a batch that
    comes then; so does a report whose entry has not come by then. An entry is never refused for being late: one
    that comes after its key has left is taken as new. ``clock_skew`` is how far the driver's clock may go back. The newest entry and report of a key go to its state, found in each task before the
    shuffle, where each bucket of keys has one state, so a busy key sends a row or two for each Arrow batch. Rows without key, ``ts`` or ``seq`` take no part.
    """
    if not changes.isStreaming:
        raise ValueError("stream_pending expects a streaming DataFrame")
    applied = F.coalesce("applied", F.lit(False)).alias("applied")
    rows = changes.select("key", F.col("ts").cast("bigint"), F.col("seq").cast("bigint"), applied).dropna()
    newest = rows.mapInPandas(_newest, "key string, ts bigint, seq bigint, applied boolean")
    # The watermark goes by arrival and not by ``ts``, so that late entries are not behind it.
    arrived = newest.withColumn("at", F.current_timestamp()).withWatermark("at", clock_skew)

    placed = arrived.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))

    def follow(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = {}  # of each key [ts, seq, done_ts, done_seq, when it leaves if it is not pending]
        if state.exists:
            kept = {key: own for key, *own in zip(*state.get, strict=True)}
        touched = {}
        for part in parts:
            columns = (part[name].tolist() for name in ("key", "ts", "seq", "applied"))
            for key, ts, seq, applied in zip(*columns, strict=True):
                if key not in touched:
                    was = kept.get(key, [None] * 5)
                    touched[key] = [None if was[1] is None else (was[0], was[1]), None if was[3] is None else (was[2], was[3])]
                place = touched[key]
                place[applied] = max(place[applied] or (ts, seq), (ts, seq))
        passed = state.getCurrentWatermarkMs()
        leaves = max(state.getCurrentProcessingTimeMs() + keep_ms, passed + 1)
        kept = {key: own for key, own in kept.items() if key not in touched and (own[4] is None or own[4] >= passed)}
        out = []
        for key, (entry, done) in touched.items():
            pending = entry is not None and (done is None or entry > done)
            kept[key] = [*(entry or (None, None)), *(done or (None, None)), None if pending else leaves]
            if entry is not None:
                out.append((key, *entry, pending))
        if kept:
            state.update((list(kept), *(list(column) for column in zip(*kept.values(), strict=True))))
            due = [own[4] for own in kept.values() if own[4] is not None]
            if due:
                state.setTimeoutTimestamp(min(due))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["key", "ts", "seq", "pending"])

    return placed.groupBy("bucket").applyInPandasWithState(follow, _QUEUE, _PLACES, "update", "EventTimeTimeout")


def _newest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield part.sort_values(["ts", "seq"]).groupby(["key", "applied"], as_index=False).tail(1)
