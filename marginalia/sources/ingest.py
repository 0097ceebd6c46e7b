"""The gate for incoming files: accept as notes, or reject with a reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.frontmatter import parse_front_matter
from marginalia.functions.names import name_or_timestamp, sanitize_name
from marginalia.functions.paths import basename, join_path, normalize_path
from marginalia.schema import CHANGES

# What the gate lets in.
ACCEPTED_EXTENSIONS = (".md", ".txt")
MAX_BYTES = 1 << 20


def _file_name(path: Column) -> Column:
    return basename(F.replace(path, F.lit("\\"), F.lit("/")))


def _extension(name: Column) -> Column:
    last = F.substring_index(name, ".", -1)
    return F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), last)).otherwise("")


def classify(files: DataFrame, folder: str = "") -> DataFrame:
    """Incoming files with ``reason`` (NULL when accepted), checked in a fixed order."""
    name = _file_name(F.col("path"))
    reason = (
        F.when(~F.lower(_extension(name)).isin(*ACCEPTED_EXTENSIONS), "extension")
        .when(F.col("length") > MAX_BYTES, "too_large")
        .when(~F.is_valid_utf8(F.col("content").cast("string")), "not_utf8")
        .when(F.contains(F.col("content"), F.lit(b"\x00")), "nul_byte")
        .when(normalize_path(F.lit(folder)).isNull(), "illegal_path")
    )
    return files.withColumn("reason", reason)


def ingest_gate(files: DataFrame, folder: str = "", keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Split incoming files (the binary reader's columns) into ``(accepted, rejected)``.

    Accepted rows carry the note they would become, and the columns ``keep`` of their files. Committing them, with names
    that are taken resolved, is ``apply_changes`` over ``as_creates(accepted)``.
    """
    checked = classify(files, folder)
    name = _file_name(F.col("path"))
    extension = _extension(name)
    mod_time = F.unix_millis(F.col("modificationTime"))
    stem = F.left(name, F.length(name) - F.length(extension))
    note = name_or_timestamp(sanitize_name(stem), mod_time)
    parsed = parse_front_matter(F.col("content").cast("string"))
    accepted = checked.filter("reason IS NULL").select(
        F.col("path").alias("source_path"),
        join_path(normalize_path(F.lit(folder)), F.concat(note, F.lit(".md"))).alias("path"),
        normalize_path(F.lit(folder)).alias("folder"),
        note.alias("name"),
        parsed["body"].alias("content"),
        parsed["tags"].alias("tags"),
        mod_time.alias("mod_time"),
        F.col("length").alias("size"),
        *keep,
    )
    rejected = checked.filter("reason IS NOT NULL").select("path", "length", "reason")
    return accepted, rejected


def as_creates(accepted: DataFrame, seq: Column) -> DataFrame:
    """Accepted files as ``create`` changes; ``seq`` numbers them in the log."""
    return accepted.select(
        seq.cast("bigint").alias("seq"),
        F.concat(F.lit("file::"), F.col("source_path")).alias("key"),
        F.lit(None).cast("string").alias("client_id"),
        F.lit("create").alias("kind"),
        F.lit(None).cast("string").alias("path"),
        # A name that itself ends in ".md" keeps it, under one more suffix.
        F.when(F.endswith("name", F.lit(".md")), F.concat("name", F.lit(".md")))
        .otherwise(F.col("name"))
        .alias("name"),
        "folder",
        "content",
        "tags",
        F.col("mod_time").alias("ts"),
    )


def as_rejects(rejected: DataFrame) -> DataFrame:
    """Rejected files as ``create`` changes that were refused, without their contents, as a store keeps rejects."""
    blank = [F.lit(None).cast(field.dataType).alias(field.name) for field in CHANGES.fields]
    named = {
        "key": F.concat(F.lit("file::"), F.col("path")),
        "kind": F.lit("create"),
        "path": F.col("path"),
    }
    columns = [named[f.name].alias(f.name) if f.name in named else b for f, b in zip(CHANGES.fields, blank, strict=True)]
    return rejected.select(*columns, "reason")
