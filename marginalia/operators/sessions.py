"""Sessions that live as long as their token is active."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: 30 days of inactivity end a session.
SESSION_TTL_MS = 30 * 24 * 60 * 60 * 1000


def sessions(
    events: DataFrame,
    token: str = "token",
    ts: str = "ts",
    ttl_ms: int = SESSION_TTL_MS,
    logout: Column | None = None,
) -> DataFrame:
    """``(token, start, last, expires, n_events)``; a gap over the TTL starts a new session.

    ``ts`` is epoch milliseconds. Events of one token that fall in the same
    TTL-long slot are never further apart than the TTL, so each slot first
    collapses to one row. What is then ordered per token is bounded by the time
    span over the TTL, however many events a token has.

    With ``logout``, the first such event of a token ends it for good: the
    session expires there and what the token does later is refused.
    """
    activity = events.select(
        F.col(token).alias("token"),
        F.col(ts).alias("ts"),
        (F.lit(False) if logout is None else F.coalesce(logout, F.lit(False))).alias("out"),
    )
    if logout is not None:
        ended = activity.filter("out").groupBy("token").agg(F.min("ts").alias("ended"))
        activity = activity.join(ended, "token", "left").filter(
            F.col("ended").isNull() | (F.col("ts") <= F.col("ended"))
        )
    slots = activity.groupBy("token", (F.col("ts") - F.pmod("ts", F.lit(ttl_ms))).alias("slot")).agg(
        F.min("ts").alias("start"),
        F.max("ts").alias("last"),
        F.count("*").alias("n"),
        F.max(F.when(F.col("out"), F.col("ts"))).alias("ended"),
    )
    by_time = Window.partitionBy("token").orderBy("slot")
    fresh = F.coalesce(F.col("start") - F.lag("last").over(by_time) > ttl_ms, F.lit(True))
    numbered = slots.withColumn("fresh", fresh.cast("int")).withColumn(
        "session", F.sum("fresh").over(by_time)
    )
    return (
        numbered.groupBy("token", "session")
        .agg(
            F.min("start").alias("start"),
            F.max("last").alias("last"),
            F.sum("n").alias("n_events"),
            F.max("ended").alias("ended"),
        )
        .select(
            "token",
            "start",
            "last",
            F.coalesce("ended", F.col("last") + ttl_ms).alias("expires"),
            "n_events",
        )
    )


def session_expiry(
    events: DataFrame, token: str = "token", ts: str = "ts", ttl_ms: int = SESSION_TTL_MS
) -> DataFrame:
    """``(token, expires)`` from the last activity of each token."""
    return events.groupBy(F.col(token).alias("token")).agg(
        (F.max(ts) + ttl_ms).alias("expires")
    )


def live_sessions(expiring: DataFrame, now_ms: int, at_load: bool = False) -> DataFrame:
    """Sessions still valid at ``now_ms``.

    A running session is accepted up to and including its expiry; loading a
    stored one asks for an expiry still to come.
    """
    expires = F.col("expires")
    return expiring.filter(expires > now_ms if at_load else expires >= now_ms)
