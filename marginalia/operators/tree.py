"""The folder tree as flat tables: folders with their parent, notes with their folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.paths import ancestors, basename, depth, dirname
from marginalia.operators.listing import named_notes
from marginalia.operators.sorting import sort_once
from marginalia.schema import folders_from_paths


def all_folders(notes: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Explicit folders, folders that notes lie in, and the ancestors of both.

    Folder names are made distinct before their ancestors are spelled out, so
    what is shuffled follows the number of folders, not of notes.
    """
    named = notes.select(F.col("folder").alias("path"))
    if folders is not None:
        named = named.union(folders.select("path"))
    implied = named.distinct().select(F.explode(ancestors(F.col("path"))).alias("path"))
    return folders_from_paths(implied.distinct())


def folder_nodes(notes: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """One row per folder with its numbers of direct children and of direct notes."""
    nodes = all_folders(notes, folders)
    children = nodes.groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("n_children"))
    inside = notes.groupBy(F.col("folder").alias("path")).agg(
        F.count("*").alias("n_notes"), F.max("mod_time").alias("last_mod_time")
    )
    return (
        nodes.join(children, "path", "left")
        .join(inside, "path", "left")
        .fillna(0, ["n_children", "n_notes"])
    )


def folder_children(notes: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """``(parent, path, name)`` of every folder, in name order within each parent."""
    nodes = all_folders(notes, folders)
    return nodes.select("parent", "path", "name").orderBy("parent", "name")


def folder_preorder(folders: DataFrame) -> DataFrame:
    """Folders in pre-order with their depth, as a picker shows them.

    Ordering by path segments keeps ``a/b`` before ``a b``, which ordering by
    the text would not.
    """
    return folders.select("path", "name", "depth").orderBy(F.split("path", "/"))


def folder_tree(
    notes: DataFrame, folders: DataFrame | None = None, named_only: bool = False
) -> DataFrame:
    """The whole tree, flat: a row per note under its folder, and a row per folder without notes.

    Notes in the root are not part of the tree. A note knows its folder, so note
    rows need no join, and a folder that holds most of the notes stays spread over
    the tasks that read it; only folders without notes are found by joining.
    """
    nodes = all_folders(notes, folders)
    shown = named_notes(notes) if named_only else notes
    filed = shown.filter(F.col("folder") != "").select(
        F.col("folder"),
        F.col("path").alias("note_path"),
        F.col("name").alias("note_name"),
        "tags",
        "mod_time",
        "preview",
    )
    occupied = shown.select("folder").distinct()
    empty = nodes.join(occupied, nodes["path"] == occupied["folder"], "left_anti").select(
        F.col("path").alias("folder"),
        *[F.lit(None).cast(filed.schema[c].dataType).alias(c) for c in filed.columns[1:]],
    )
    folder = F.col("folder")
    rows = filed.unionByName(empty).select(
        folder,
        dirname(folder).alias("parent"),
        basename(folder).alias("folder_name"),
        depth(folder).cast("int").alias("depth"),
        *filed.columns[1:],
    )
    return sort_once(rows, F.split("folder", "/"), F.desc("mod_time"), "note_path")
