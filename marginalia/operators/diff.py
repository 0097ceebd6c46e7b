"""What changed between two snapshots of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(path, status)``: added, changed, removed or unchanged.

    A path with the same modification time and size counts as unchanged. Only
    these three columns are read.
    """
    before = old.select("path", F.col("mod_time").alias("m0"), F.col("size").alias("s0"))
    after = new.select("path", F.col("mod_time").alias("m1"), F.col("size").alias("s1"))
    status = (
        F.when(F.col("m0").isNull(), "added")
        .when(F.col("m1").isNull(), "removed")
        .when((F.col("m0") == F.col("m1")) & (F.col("s0") == F.col("s1")), "unchanged")
        .otherwise("changed")
    )
    return before.join(after, "path", "full_outer").select("path", status.alias("status"))


def to_parse(files: DataFrame, known: DataFrame) -> DataFrame:
    """The files an incremental ingest still has to read: new ones and changed ones."""
    version = ["path", "mod_time", "size"]
    return files.join(known.select(*version), version, "left_anti")
