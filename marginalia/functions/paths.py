"""Slash-separated relative paths. The root folder is the empty string."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.left(path, F.length(path) - F.length(basename(path)) - 1)


def note_name(path: Column) -> Column:
    """The base name without one trailing ``.md``."""
    base = basename(path)
    return F.when(F.endswith(base, F.lit(".md")), F.left(base, F.length(base) - 3)).otherwise(base)


def join_path(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def is_under(path: Column, folder: Column) -> Column:
    """Path equals the folder or lies below it. ``_`` and ``%`` are plain characters."""
    return (path == folder) | F.startswith(path, F.concat(folder, F.lit("/")))


def depth(folder: Column) -> Column:
    return F.size(F.split(folder, "/")) - 1


def ancestors(folder: Column) -> Column:
    """Every prefix folder of ``folder``, itself included; empty for the root."""
    parts = F.split(folder, "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
    return F.when(folder == "", F.array().cast("array<string>")).otherwise(prefixes)


def normalize_path(path: Column) -> Column:
    """Resolve ``.``, ``..`` and repeated slashes; NULL when the path leaves the root."""
    start = F.struct(
        F.array().cast("array<string>").alias("parts"), F.lit(True).alias("inside")
    )

    def step(acc: Column, part: Column) -> Column:
        return (
            F.when(~acc["inside"] | part.isin("", "."), acc)
            .when(
                part == "..",
                F.struct(
                    F.slice(
                        acc["parts"], F.lit(1), F.greatest(F.size(acc["parts"]) - 1, F.lit(0))
                    ).alias("parts"),
                    (F.size(acc["parts"]) > 0).alias("inside"),
                ),
            )
            .otherwise(
                F.struct(
                    F.array_append(acc["parts"], part).alias("parts"), F.lit(True).alias("inside")
                )
            )
        )

    return F.aggregate(
        F.split(path, "/"),
        start,
        step,
        lambda acc: F.when(acc["inside"], F.array_join(acc["parts"], "/")),
    )


def normal_constant(path: str) -> str | None:
    """``normalize_path`` of a query parameter, so that a filter on it is a plain constant."""
    parts: list[str] = []
    for part in path.split("/"):
        if part == ".." and not parts:
            return None
        if part == "..":
            parts.pop()
        elif part not in ("", "."):
            parts.append(part)
    return "/".join(parts)


def rewrite_prefix(path: Column, ops: Sequence[tuple[str, str | None]] | Column) -> Column:
    """Fold ordered ``(old, new)`` folder rewrites over a path; ``new`` None deletes.

    ``ops`` is a short list, or an ``array<struct<old,new>>`` column. A deleted
    path comes out NULL and stays NULL for the rest of the fold.
    """
    if not isinstance(ops, Column):
        if not ops:
            return path
        ops = F.array(
            *[
                F.struct(
                    F.lit(old).cast("string").alias("old"), F.lit(new).cast("string").alias("new")
                )
                for old, new in ops
            ]
        )
    return F.aggregate(
        ops,
        path,
        lambda p, op: F.when(
            is_under(p, op["old"]),
            F.concat(op["new"], F.substring(p, F.length(op["old"]) + 1, F.length(p))),
        ).otherwise(p),
    )
