"""Continuous counterparts on Structured Streaming."""

from marginalia.streaming.ingest import ingest_batch, stream_ingest
from marginalia.streaming.queue import stream_coalesce, stream_pending
from marginalia.streaming.replay import apply_batch, stream_apply
from marginalia.streaming.sessions import stream_sessions, stream_sessions_logout

__all__ = [
    "apply_batch",
    "ingest_batch",
    "stream_apply",
    "stream_coalesce",
    "stream_ingest",
    "stream_pending",
    "stream_sessions",
    "stream_sessions_logout",
]
