"""Explicit schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.functions.frontmatter import build_front_matter, parse_front_matter
from marginalia.functions.paths import basename, depth, dirname, note_name
from marginalia.functions.text import preview

NOTES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("folder", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("mod_time", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("preview", T.StringType()),
        # The header as it stands in the file; NULL for one that is made from the tags.
        T.StructField("header", T.StringType()),
    ]
)

FOLDERS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("parent", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("depth", T.IntegerType()),
    ]
)

CHANGES = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("client_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("folder", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("ts", T.LongType()),
    ]
)

QUERIES = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("q", T.StringType()),
        T.StructField("tag", T.StringType()),
    ]
)


def notes_from_parts(parts: DataFrame) -> DataFrame:
    """Notes from ``(path, content, tags, mod_time)``, with the derived columns filled in."""
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    content = F.coalesce(F.col("content"), F.lit(""))
    size = F.octet_length(build_front_matter(tags)) + F.octet_length(content)
    return parts.select(
        "path",
        dirname(F.col("path")).alias("folder"),
        note_name(F.col("path")).alias("name"),
        content.alias("content"),
        tags.alias("tags"),
        F.col("mod_time").cast("bigint").alias("mod_time"),
        size.cast("bigint").alias("size"),
        preview(content).alias("preview"),
        F.lit(None).cast("string").alias("header"),
    )


def notes_from_raw(files: DataFrame) -> DataFrame:
    """Notes from ``(path, raw, mod_time, size)``: the header is split off the body, and kept."""
    parsed = files.withColumn("parsed", parse_front_matter(F.col("raw")))
    header = F.substr(F.col("raw"), F.lit(1), F.length("raw") - F.length("parsed.body"))
    return parsed.select(
        "path",
        dirname(F.col("path")).alias("folder"),
        note_name(F.col("path")).alias("name"),
        F.col("parsed.body").alias("content"),
        F.col("parsed.tags").alias("tags"),
        F.col("mod_time").cast("bigint").alias("mod_time"),
        F.col("size").cast("bigint").alias("size"),
        preview(F.col("parsed.body")).alias("preview"),
        header.alias("header"),
    )


def folders_from_paths(paths: DataFrame) -> DataFrame:
    """The folder table of a one-column ``path`` DataFrame of distinct folder paths."""
    path = F.col("path")
    return paths.select(
        path,
        dirname(path).alias("parent"),
        basename(path).alias("name"),
        depth(path).cast("int").alias("depth"),
    )
