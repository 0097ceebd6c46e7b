"""Note names: timestamps, sanitising, and the families of derived names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.paths import basename, dirname, join_path, note_name
from marginalia.functions.text import trim_blanks

# Name rules that must give the same names everywhere.
TIMESTAMP_NAME = r"^\d{4}-\d{2}-\d{2}_\d{6}"
NAME_CHARS = 200
FORBIDDEN_NAME_CHARS = r'[\x00-\x1F\x7F/\\:*?"<>|]'
NAME_EDGE_CHARS = " ."
RESERVED_NAMES = (
    "CON", "PRN", "AUX", "NUL",
    "COM1", "COM2", "COM3", "COM4", "COM5", "COM6", "COM7", "COM8", "COM9",
    "LPT1", "LPT2", "LPT3", "LPT4", "LPT5", "LPT6", "LPT7", "LPT8", "LPT9",
)

# Names this engine derives: "<stamp>_<name>" or "<stamp>-<n>_<name>" for a
# created note whose name is taken, "<name> (copy)" or "<name> (copy <n>)" for
# a duplicate.
STAMP_PREFIXES = r"^(?:\d{4}-\d{2}-\d{2}_\d{6}(?:-\d+)?_)+"
COPY_SUFFIXES = r"(?: \(copy(?: \d+)?\))+$"
STAMPED = r"^(\d{4}-\d{2}-\d{2}_\d{6})(?:-([1-9]\d*))?_(.*)$"
COPIED = r"(?s)^(.*) \(copy(?: ([1-9]\d*))?\)$"


def is_timestamp_name(name: Column) -> Column:
    """True when the name begins like ``2024-01-31_235959`` (a prefix test)."""
    return F.rlike(name, F.lit(TIMESTAMP_NAME))


def timestamp_name(epoch_ms: Column) -> Column:
    """``yyyy-MM-dd_HHmmss`` in UTC, whatever the session time zone is."""
    seconds = F.floor(epoch_ms / 1000)
    stamp = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")
    )
    text = stamp.cast("string")
    return F.concat(
        F.substring(text, 1, 10), F.lit("_"), F.replace(F.substring(text, 12, 8), F.lit(":"), F.lit(""))
    )


def sanitize_name(name: Column) -> Column:
    """A safe single-segment name; blank when nothing usable is left."""
    unified = F.replace(name, F.lit("\\"), F.lit("/"))
    bare = F.rtrim(unified, F.lit("/"))
    last = F.when((bare == "") & (unified != ""), "/").otherwise(basename(bare))
    safe = F.regexp_replace(last, FORBIDDEN_NAME_CHARS, "_")
    cut = F.btrim(F.left(safe, F.lit(NAME_CHARS)), F.lit(NAME_EDGE_CHARS))
    stem = F.when(
        F.contains(cut, F.lit(".")),
        F.left(cut, F.length(cut) - F.length(F.substring_index(cut, ".", -1)) - 1),
    ).otherwise(cut)
    return F.when(F.upper(stem).isin(*RESERVED_NAMES), F.concat(F.lit("_"), cut)).otherwise(cut)


def with_md(name: Column) -> Column:
    return F.when(F.endswith(name, F.lit(".md")), name).otherwise(F.concat(name, F.lit(".md")))


def name_or_timestamp(name: Column, epoch_ms: Column) -> Column:
    """``name``, or the timestamp name when it is NULL or blank."""
    blank = name.isNull() | (trim_blanks(name) == "")
    return F.when(blank, timestamp_name(epoch_ms)).otherwise(name)


def family(path: Column) -> Column:
    """A key shared by a note and every name this engine could derive from it.

    Stripping all stamps and copy marks means that a collision name or a copy
    always stays in the family of the note it came from, so two changes can only
    meet in a path when they share a family.
    """
    core = F.regexp_replace(F.regexp_replace(note_name(path), STAMP_PREFIXES, ""), COPY_SUFFIXES, "")
    return join_path(dirname(path), core)


def copy_parts(name: Column) -> Column:
    """``struct(base, n)`` of a copy's name; NULL ``n`` when it is not a copy name."""
    digits = F.regexp_extract(name, COPIED, 2)
    number = (
        F.when(~F.rlike(name, F.lit(COPIED)), F.lit(None))
        .when(digits == "", F.lit(1))
        .when(F.length(digits) <= 18, digits.cast("bigint"))
    )
    return F.struct(
        F.regexp_extract(name, COPIED, 1).alias("base"),
        F.when((digits != "") & (number < 2), F.lit(None)).otherwise(number).cast("bigint").alias("n"),
    )


def copy_name(base: Column, n: Column) -> Column:
    """``base (copy)``, then ``base (copy 2)``, ``base (copy 3)`` and so on."""
    return F.when(n == 1, F.concat(base, F.lit(" (copy)"))).otherwise(
        F.concat(base, F.lit(" (copy "), n.cast("string"), F.lit(")"))
    )


def stamped_parts(name: Column) -> Column:
    """``struct(stamp, base, n)`` of a collision name; NULL ``n`` when it is not one."""
    pattern = "(?s)" + STAMPED
    digits = F.regexp_extract(name, pattern, 2)
    number = (
        F.when(~F.rlike(name, F.lit(pattern)), F.lit(None))
        .when(digits == "", F.lit(1))
        .when(F.length(digits) <= 18, digits.cast("bigint"))
    )
    return F.struct(
        F.regexp_extract(name, pattern, 1).alias("stamp"),
        F.regexp_extract(name, pattern, 3).alias("base"),
        F.when((digits != "") & (number < 2), F.lit(None)).otherwise(number).cast("bigint").alias("n"),
    )


def stamped_name(base: Column, stamp: Column, n: Column) -> Column:
    """``stamp_base``, then ``stamp-2_base``, ``stamp-3_base`` and so on."""
    mark = F.when(n == 1, F.lit("_")).otherwise(F.concat(F.lit("-"), n.cast("string"), F.lit("_")))
    return F.concat(stamp, mark, base)
