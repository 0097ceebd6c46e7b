"""Folder changes: checked in log order, then applied to all paths as one fold.

A run of folder changes is short and its effect on any path is a fold, so only
the changes themselves and the few folders they name are looked at one by one.
The folder and note tables are never iterated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

# Creating folders never depends on what was there, so any number of creates is
# one set operation; the other kinds have to be taken in order.
CREATE_KIND = "create_folder"
ORDERED_KINDS = ("rename_folder", "delete_folder", "move_folder")


@dataclass(frozen=True)
class FolderOp:
    seq: int
    kind: str
    path: str | None  # normalised; None when illegal
    folder: str | None  # normalised destination of a move
    name: str | None  # new name of a rename


@dataclass(frozen=True)
class Applied:
    """An accepted change: ``old`` became ``new`` (None: deleted) after ``made`` was ensured."""

    old: str | None = None
    new: str | None = None
    made: str | None = None


def under(path: str, folder: str) -> bool:
    return path == folder or path.startswith(folder + "/")


def _parent(path: str) -> str:
    return path.rpartition("/")[0]


def _join(folder: str, name: str) -> str:
    return f"{folder}/{name}" if folder else name


def origin(path: str, applied: Sequence[Applied]) -> str | bool:
    """Where a folder was before ``applied``: a path, or whether it exists for certain."""
    for change in reversed(applied):
        if change.old is not None:
            if change.new is not None and under(path, change.new):
                path = change.old + path[len(change.new) :]
            elif under(path, change.old):
                return False
        if change.made and under(change.made, path):
            return True
    return path


def resolve_run(
    ops: Sequence[FolderOp], lookup: Callable[[set[str]], Iterable[str]]
) -> tuple[list[Applied], dict[int, str]]:
    """Accept or reject ``ops`` in order. ``lookup`` says which of some paths are folders.

    Existence before the run is asked for in batches: unknown answers are
    guessed, collected, fetched together, and the run is replayed with them.
    """
    known: dict[str, bool] = {}
    while True:
        unknown: set[str] = set()

        def exists(path: str, applied: list[Applied], guess: bool) -> bool:
            before = origin(path, applied)
            if isinstance(before, bool):
                return before
            if before not in known:
                unknown.add(before)
                return guess
            return known[before]

        applied: list[Applied] = []
        rejects: dict[int, str] = {}
        for op in ops:
            outcome = _check(op, applied, exists)
            if isinstance(outcome, str):
                rejects[op.seq] = outcome
            elif outcome is not None:
                applied.append(outcome)
        if not unknown:
            return applied, rejects
        found = set(lookup(unknown))
        known.update((path, path in found) for path in unknown)


def _check(op: FolderOp, applied: list[Applied], exists) -> Applied | str | None:
    """The change to apply, a reason to reject it, or None when there is nothing to do."""
    if not op.path:
        return "illegal_path"
    if op.kind == "delete_folder":
        return Applied(old=op.path)
    if op.kind == "rename_folder":
        name = op.name or ""
        if not name or name in (".", "..") or "/" in name:
            return "illegal_path"
        target, made = _join(_parent(op.path), name), None
    else:
        if op.folder is None:
            return "illegal_path"
        target, made = _join(op.folder, op.path.rpartition("/")[2]), op.folder
    if not exists(op.path, applied, True):
        return "not_found"
    if target == op.path:
        return None
    if under(target, op.path):
        return "into_itself"
    if exists(target, applied, False):
        return "exists"
    return Applied(old=op.path, new=target, made=made)


def rewrites(applied: Iterable[Applied]) -> list[tuple[str, str | None]]:
    return [(change.old, change.new) for change in applied if change.old is not None]


def made_folders(applied: Sequence[Applied]) -> list[str]:
    """Folders the run ensured, ancestors included, as they are named at its end."""
    out = []
    for i, change in enumerate(applied):
        later = rewrites(applied[i:])
        parts = change.made.split("/") if change.made else []
        for n in range(1, len(parts) + 1):
            path: str | None = "/".join(parts[:n])
            for old, new in later:
                if path is not None and under(path, old):
                    path = None if new is None else new + path[len(old) :]
            if path is not None:
                out.append(path)
    return out
