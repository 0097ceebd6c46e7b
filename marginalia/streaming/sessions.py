"""Sliding sessions over a stream of activity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from marginalia.operators.sessions import SESSION_TTL_MS

LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def stream_sessions(
    events: DataFrame,
    token: str = "token",
    ts: str = "ts",
    ttl_ms: int = SESSION_TTL_MS,
    watermark: str = "1 hour",
) -> DataFrame:
    """Closed sessions, as ``sessions`` gives them; write in ``append`` mode.

    ``ts`` is epoch milliseconds. A session comes out once the watermark has
    passed its expiry. Events of a busy token are merged before the shuffle, for which
    the session's setting LOCAL_MERGE is switched on and stays so: it is read when the
    query starts.
    """
    events.sparkSession.conf.set(LOCAL_MERGE, True)
    return (
        events.select(F.col(token).alias("token"), F.col(ts).alias("ts"))
        .withColumn("at", F.timestamp_millis("ts"))
        .withWatermark("at", watermark)
        .groupBy("token", F.session_window("at", f"{ttl_ms} milliseconds").alias("window"))
        .agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n_events"))
        .select(
            "token", "start", "last", (F.col("last") + ttl_ms).alias("expires"), "n_events"
        )
    )


SESSION = "token string, start bigint, last bigint, expires bigint, n_events bigint"
# Of each token the open session (nulls: none) and whether it is logged out, and by its place among the tokens, ``who``,
# activity the watermark has not passed.
STATE = """token array<string>, start array<bigint>, last array<bigint>, n array<bigint>, ended array<boolean>,
  who array<int>, at array<bigint>, counts array<bigint>, outs array<bigint>"""
#: Tokens share a state with those of the same bucket, as a call for each token would cost more than its events.
BUCKETS = 1024


def stream_sessions_logout(
    events: DataFrame,
    logout: Column,
    token: str = "token",
    ts: str = "ts",
    ttl_ms: int = SESSION_TTL_MS,
    watermark: str = "1 hour",
) -> DataFrame:
    """Closed sessions, as ``sessions`` gives them with ``logout``; write in ``append`` mode.

    A session comes out once the watermark has passed its expiry, or the logout that ends it. What a
    token does after its first logout is refused, also when it arrived before it: activity waits in
    the state until the watermark has passed it and is then taken in order of time. A state holds, for the tokens of
    a bucket, the open session and one entry for each distinct time that waits; of a token that logged out only that it
    did, for good. Equal times of a busy token are counted together before the shuffle.
    Events without token or time take no part, a null ``logout`` is none.
    """
    activity = events.select(
        F.col(token).cast("string").alias("token"),
        F.col(ts).cast("bigint").alias("ts"),
        F.coalesce(logout, F.lit(False)).cast("bigint").alias("out"),
    ).dropna()
    counted = activity.mapInPandas(_counted, "token string, ts bigint, out bigint, n bigint")
    timed = counted.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", watermark)
    timed = timed.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int"))

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens = {}  # of each [start, last, n, ended, what waits by time]
        if state.exists:
            names, starts, lasts, ns, ended, *lists = state.get
            tokens = {name: [*own, {}] for name, *own in zip(names, starts, lasts, ns, ended, strict=True)}
            waits = [own[4] for own in tokens.values()]
            for who, at, count, out in zip(*lists, strict=True):
                waits[who][at] = (count, out)
        for part in parts:
            columns = (part[name].tolist() for name in ("token", "ts", "n", "out"))
            for name, at, count, out in zip(*columns, strict=True):
                waiting = tokens.setdefault(name, [None, None, None, False, {}])[4]
                before = waiting.get(at, (0, 0))
                waiting[at] = (before[0] + count, max(before[1], out))
        passed = state.getCurrentWatermarkMs()
        closed, due = [], []
        for name, own in list(tokens.items()):
            closed.extend((name, *session) for session in _pass(own, passed, ttl_ms))
            start, last, _, ended, waiting = own
            if start is None and not ended and not waiting:
                del tokens[name]
            due.extend([min(waiting)] if waiting else [])
            due.extend([] if start is None else [last + ttl_ms])
        if tokens:
            lists = [(who, at, *own[4][at]) for who, own in enumerate(tokens.values()) for at in sorted(own[4])]
            columns = [list(column) for column in zip(*(own[:4] for own in tokens.values()), strict=True)]
            state.update((list(tokens), *columns, *([row[i] for row in lists] for i in range(4))))
            if due:
                state.setTimeoutTimestamp(max(min(due) - 1, passed))  # comes up once the watermark is beyond it
        else:
            state.remove()
        if closed:
            yield pd.DataFrame(closed, columns=["token", "start", "last", "expires", "n_events"])

    return timed.groupBy("bucket").applyInPandasWithState(follow, SESSION, STATE, "append", "EventTimeTimeout")


def _pass(own: list, passed: int, ttl_ms: int) -> Iterator[tuple[int, int, int, int]]:
    """Move one token's state on to a watermark; gives ``(start, last, expires, n_events)`` of what closes by then."""
    start, last, n, ended, waiting = own
    for at in sorted(at for at in waiting if at <= passed):
        count, out = waiting.pop(at)
        if ended:
            continue
        if start is not None and at - last > ttl_ms:
            yield start, last, last + ttl_ms, n
            start = None
        start, n = (at, count) if start is None else (start, n + count)
        last = at
        if out:
            yield start, last, at, n
            start, ended = None, True
    if start is not None and last + ttl_ms <= passed:
        yield start, last, last + ttl_ms, n
        start = None
    if start is None:
        last = n = None
    if ended:
        waiting.clear()
    own[:4] = start, last, n, ended


def _counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield part.groupby(["token", "ts", "out"], as_index=False).size().rename(columns={"size": "n"})
