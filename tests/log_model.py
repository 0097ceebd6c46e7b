"""A one-change-at-a-time model of the change log, to compare the engine with."""

from __future__ import annotations

import datetime as dt
import re

RESERVED = {"CON", "PRN", "AUX", "NUL"} | {f"{p}{i}" for p in ("COM", "LPT") for i in range(1, 10)}


def stamp(ms):
    moment = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=ms // 1000)
    return moment.strftime("%Y-%m-%d_%H%M%S")


def normalize(path):
    if path is None:
        return None
    parts = []
    for part in path.split("/"):
        if part in ("", "."):
            continue
        if part == "..":
            if not parts:
                return None
            parts.pop()
        else:
            parts.append(part)
    return "/".join(parts)


def sanitize(name):
    name = name.replace("\\", "/").rstrip("/").rpartition("/")[2]
    name = re.sub(r'[\x00-\x1f\x7f/\\:*?"<>|]', "_", name)[:200].strip(" .")
    return "_" + name if name.rpartition(".")[0].upper() in RESERVED or name.upper() in RESERVED else name


def join(folder, name):
    return f"{folder}/{name}" if folder else name


def split(path):
    folder, _, name = path.rpartition("/")
    return folder, name


def under(path, folder):
    return path == folder or path.startswith(folder + "/")


def md(name):
    return name if name.endswith(".md") else name + ".md"


class Model:
    def __init__(self, notes, folders=()):
        self.notes = {p: (c, list(t), m) for p, c, t, m in notes}
        self.folders = set()
        self.rejects = {}
        for folder in folders:
            self.mkdir(folder)
        for path in self.notes:
            self.mkdir(split(path)[0])

    def mkdir(self, folder):
        parts = folder.split("/") if folder else []
        for i in range(1, len(parts) + 1):
            self.folders.add("/".join(parts[:i]))

    def apply(self, changes):
        for change in sorted(changes, key=lambda c: c["seq"]):
            reason = self.one(change)
            if reason:
                self.rejects[change["seq"]] = reason

    def one(self, c):
        kind = c["kind"]
        if kind.endswith("_folder"):
            return self.folder_change(c)
        if kind == "create" or (kind == "save" and not c["path"]):
            return self.create(c)
        path = normalize(c["path"])
        if not path:
            return "illegal_path"
        if kind == "delete":
            return None if self.notes.pop(path, None) else "not_found"
        if kind == "duplicate":
            return self.duplicate(path, c)
        folder, base = split(path)
        if kind == "move":
            folder = normalize(c["folder"] or "")
        else:
            renames = c["name"] is not None if kind == "update" else bool(c["name"])
            if renames and "/" in c["name"]:
                return "illegal_path"
            if renames:
                base = md(c["name"] if c["name"].strip() else stamp(c["ts"]))
            if kind == "save" and c["folder"] is not None:
                folder = normalize(c["folder"])
        if folder is None:
            return "illegal_path"
        if path not in self.notes:
            return "not_found"
        target = join(folder, base)
        if target != path and target in self.notes:
            return "exists"
        content, tags, mod_time = self.notes.pop(path)
        if kind != "move":
            content = content if c["content"] is None else c["content"]
            tags, mod_time = c["tags"] or [], c["ts"]
        self.notes[target] = (content, tags, mod_time)
        if target != path:
            self.mkdir(folder)
        return None

    def create(self, c):
        folder = normalize(c["folder"] or "")
        if folder is None:
            return "illegal_path"
        name = md(sanitize(c["name"] or "") or stamp(c["ts"]))
        path, n = join(folder, name), 1
        while path in self.notes:
            path = join(folder, stamp(c["ts"]) + ("_" if n == 1 else f"-{n}_") + name)
            n += 1
        self.notes[path] = (c["content"] or "", c["tags"] or [], c["ts"])
        self.mkdir(folder)
        return None

    def duplicate(self, path, c):
        if path not in self.notes:
            return "not_found"
        base, n = path.removesuffix(".md"), 1
        while (copy := base + (" (copy).md" if n == 1 else f" (copy {n}).md")) in self.notes:
            n += 1
        content, tags, _ = self.notes[path]
        self.notes[copy] = (content, tags, c["ts"])
        return None

    def folder_change(self, c):
        path = normalize(c["path"])
        if not path:
            return "illegal_path"
        if c["kind"] == "create_folder":
            self.mkdir(path)
            return None
        if c["kind"] == "delete_folder":
            self.notes = {p: v for p, v in self.notes.items() if not under(p, path)}
            self.folders = {p for p in self.folders if not under(p, path)}
            return None
        if c["kind"] == "rename_folder":
            name = c["name"] or ""
            if name in ("", ".", "..") or "/" in name:
                return "illegal_path"
            into, target = None, join(split(path)[0], name)
        else:
            into = normalize(c["folder"] or "")
            if into is None:
                return "illegal_path"
            target = join(into, split(path)[1])
        if path not in self.folders:
            return "not_found"
        if target == path:
            return None
        if under(target, path):
            return "into_itself"
        if target in self.folders:
            return "exists"
        if into:
            self.mkdir(into)

        def moved(p):
            return target + p[len(path) :] if under(p, path) else p

        self.notes = {moved(p): v for p, v in self.notes.items()}
        self.folders = {moved(p) for p in self.folders}
        return None
