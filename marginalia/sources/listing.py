"""Directory trees listed by executors, one level of folders per round.

Folder and file names never gather on the driver, and files that Spark's own
readers leave out (empty files, names beginning with ``.`` or ``_``) are seen.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.scratch import Scratch

LISTING = "path string, is_dir boolean, mod_time bigint, size bigint"
_ARROW = pa.schema(
    [("path", pa.string()), ("is_dir", pa.bool_()), ("mod_time", pa.int64()), ("size", pa.int64())]
)
_BATCH = 10_000
_TRIES = 4
_WAIT_S = 0.5
# The names that Spark and its file systems know the same stores by.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}
T = TypeVar("T")


def open_root(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system and base path of a URI as Spark takes it, or of a local path."""
    filesystem, base = pafs.FileSystem.from_uri(_uri(root))
    return filesystem, base.rstrip("/")


def _uri(root: str) -> str:
    scheme, mark, rest = root.partition("://")
    if mark:
        return f"{_SCHEMES.get(scheme, scheme)}://{rest}"
    return root if root.startswith("file:") else os.path.abspath(root)


def unless_gone(read: Callable[[], T]) -> T | None:
    """What ``read`` gives, None if its file or folder is gone. Other errors are tried again, then raised."""
    for tried in range(1, _TRIES + 1):
        try:
            return read()
        except FileNotFoundError:
            return None
        except OSError:
            if tried == _TRIES:
                raise
            time.sleep(_WAIT_S * 2**tried)
    return None


def _lister(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = open_root(root)
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                selector = pafs.FileSelector(f"{base}/{folder}" if folder else base)
                infos = unless_gone(lambda s=selector: filesystem.get_file_info(s)) or []
                for start in range(0, len(infos), _BATCH):
                    yield _rows(infos[start : start + _BATCH], len(base) + 1)

    return run


def _rows(infos: list[pafs.FileInfo], skip: int) -> pa.RecordBatch:
    wanted = [i for i in infos if i.type in (pafs.FileType.File, pafs.FileType.Directory)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([i.path[skip:] for i in wanted], pa.string()),
            pa.array([i.type == pafs.FileType.Directory for i in wanted], pa.bool_()),
            pa.array([(i.mtime_ns or 0) // 1_000_000 for i in wanted], pa.int64()),
            pa.array([i.size or 0 for i in wanted], pa.int64()),
        ],
        schema=_ARROW,
    )


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every file and folder below ``root``, with paths relative to it."""
    scratch = Scratch(spark, "listing")
    frontier = spark.createDataFrame([("",)], "path string")
    levels = []
    while True:
        level = scratch.save(frontier.mapInArrow(_lister(root), LISTING))
        levels.append(level)
        frontier = level.filter("is_dir").select("path")
        if frontier.isEmpty():
            break
        # One listing call per folder: spread the folders over all the tasks.
        frontier = frontier.repartition(spark.sparkContext.defaultParallelism, "path")
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def hidden(path) -> F.Column:
    """Some segment begins with ``.`` or ``_``, so Spark's readers skip the file."""
    return F.rlike(path, F.lit(r"(?:^|/)[._]"))
