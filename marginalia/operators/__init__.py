"""Queries over notes, and changes to them."""

from marginalia.operators.changes import apply_changes
from marginalia.operators.diff import snapshot_diff, to_parse
from marginalia.operators.listing import (
    enrich,
    get_note,
    list_notes,
    named_notes,
    note_full,
    note_meta,
    ordered,
    subtree,
)
from marginalia.operators.queue import (
    coalesce_changes,
    pending_count,
    read_changes,
    replay_prefix,
)
from marginalia.operators.search import batch_search, search_notes
from marginalia.operators.sessions import live_sessions, session_expiry, sessions
from marginalia.operators.tree import (
    all_folders,
    folder_children,
    folder_nodes,
    folder_preorder,
    folder_tree,
)

__all__ = [
    "all_folders",
    "apply_changes",
    "batch_search",
    "coalesce_changes",
    "enrich",
    "folder_children",
    "folder_nodes",
    "folder_preorder",
    "folder_tree",
    "get_note",
    "list_notes",
    "live_sessions",
    "named_notes",
    "note_full",
    "note_meta",
    "ordered",
    "pending_count",
    "read_changes",
    "replay_prefix",
    "search_notes",
    "session_expiry",
    "sessions",
    "snapshot_diff",
    "subtree",
    "to_parse",
]
