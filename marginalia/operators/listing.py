"""Projections, lookups and folder listings over the notes table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.markdown import strip_markdown
from marginalia.functions.names import is_timestamp_name
from marginalia.functions.paths import is_under, normal_constant
from marginalia.operators.sorting import sort_once

META = ("path", "name", "tags", "mod_time", "preview")

ORDERS = ("modified-desc", "modified-asc")


def note_meta(notes: DataFrame) -> DataFrame:
    """Everything but the body, which column pruning keeps from being read."""
    return notes.select(*META)


def note_full(notes: DataFrame) -> DataFrame:
    return notes.select(*META, "content")


def enrich(meta: DataFrame) -> DataFrame:
    """Add the plain text of the (already cut) preview and whether the name was chosen."""
    return meta.withColumns(
        {
            "has_custom_name": ~is_timestamp_name(F.col("name")),
            "plain_preview": strip_markdown(F.col("preview")),
        }
    )


def ordered(meta: DataFrame, order: str = "modified-desc") -> DataFrame:
    """Sort by modification time; the path breaks ties, so the order is total."""
    if order not in ORDERS:
        raise ValueError(f"order is one of {ORDERS}, not {order!r}")
    newest_first = order == "modified-desc"
    return sort_once(
        meta, F.desc("mod_time") if newest_first else F.asc("mod_time"), F.asc("path")
    )


def get_note(notes: DataFrame, path: str) -> DataFrame:
    return note_full(notes.filter(F.col("path") == _clean(path)))


def list_notes(notes: DataFrame, folder: str, order: str = "modified-desc") -> DataFrame:
    """The notes directly in ``folder``. A missing or illegal folder lists nothing."""
    return ordered(note_meta(notes.filter(F.col("folder") == _clean(folder))), order)


def subtree(notes: DataFrame, folder: str) -> DataFrame:
    """The notes anywhere under ``folder``."""
    return ordered(note_meta(notes.filter(is_under(F.col("path"), _clean(folder)))))


def named_notes(notes: DataFrame) -> DataFrame:
    """Leave out notes that only carry a timestamp name."""
    return notes.filter(~is_timestamp_name(F.col("name")))


def _clean(path: str) -> Column:
    return F.lit(normal_constant(path)).cast("string")
