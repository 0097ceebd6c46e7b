"""Where notes come from and go to."""

from marginalia.sources.commits import commit_changes
from marginalia.sources.files import (
    refresh_notes,
    render_notes,
    scan_changed,
    scan_files,
    scan_folders,
    scan_notes,
    write_files,
    write_notes,
)
from marginalia.sources.ingest import as_creates, classify, ingest_gate
from marginalia.sources.store import (
    CommitConflict,
    expire_snapshots,
    read_folder,
    read_note,
    read_queue,
    read_rejects,
    read_store,
    read_tagged,
    write_buckets,
    write_snapshot,
)

__all__ = [
    "CommitConflict",
    "as_creates",
    "classify",
    "commit_changes",
    "expire_snapshots",
    "ingest_gate",
    "read_folder",
    "read_note",
    "read_queue",
    "read_rejects",
    "read_store",
    "read_tagged",
    "refresh_notes",
    "render_notes",
    "scan_changed",
    "scan_files",
    "scan_folders",
    "scan_notes",
    "write_buckets",
    "write_files",
    "write_notes",
    "write_snapshot",
]
