"""Intermediate tables in the shared folder the cluster names in ``spark.checkpoint.dir``.

Cutting lineage with a written table, rather than a cache, survives lost
executors, and reading it back gives the planner true sizes, so a small side is
broadcast because it is known to be small.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
# How texts are compressed that stay or lie beside others, which takes two thirds of the space of Spark's own choice.
BODIES = "zstd"
# Shuffle files go when the query that wrote them is done, and not when the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; local sessions without one get a temporary folder."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="marginalia-")
    spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


_SCOPES: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete the tables of every ``Scratch`` made inside when the work inside is done.

    For work whose results are written elsewhere, as what it returns may read those tables. The shuffle files of
    each query inside go with the query, unless the session says otherwise.
    """
    roots: list[str] = []
    _SCOPES.append(roots)
    unset = spark.conf.get(FREE_SHUFFLES, None) is None
    if unset:
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if unset:
            spark.conf.unset(FREE_SHUFFLES)
        _SCOPES.remove(roots)
        for root in roots:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """A run's own folder for written tables."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._count = 0
        if _SCOPES:
            _SCOPES[-1].append(self.root)

    def save(self, df: DataFrame, bodies: bool = False) -> DataFrame:
        """Write ``df`` and return it as a plain table scan. Tables of ``bodies`` are compressed for their size."""
        path = f"{self.root}/{self._count}"
        self._count += 1
        (df.write.option("compression", BODIES) if bodies else df.write).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
