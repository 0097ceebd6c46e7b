"""Reading a folder of Markdown files as notes and folders, and writing one."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.frontmatter import build_front_matter
from marginalia.operators.diff import to_parse
from marginalia.schema import folders_from_paths, notes_from_raw
from marginalia.scratch import Scratch
from marginalia.sources.listing import hidden, list_tree, open_root, unless_gone

MARKDOWN_SUFFIX = ".md"
_RAW = "path string, raw binary, mod_time bigint, size bigint"
# What a task reads before it hands it on, so that small files do not travel one by one.
_READ_BYTES = 4 << 20
_READ_FILES = 2000
_READ = pa.schema([("path", pa.string()), ("raw", pa.binary()), ("mod_time", pa.int64()), ("size", pa.int64())])


def scan_notes(spark: SparkSession, root: str) -> DataFrame:
    """All ``.md`` files at any depth. Files that are gone by then are left out; one that
    cannot be read, after some tries, fails the scan, so no note is lost silently.

    The executors list the folders and read the files: no path passes through the driver, which
    Spark's binary reader would make a list of, and empty and hidden files are there too.
    """
    listing = _listed(spark, root)
    seen, unseen = listing.filter(~hidden(F.col("path"))), listing.filter(hidden(F.col("path")))
    # Bytes that are no text stay as they are, but in hidden files.
    return notes_from_raw(_read_listed(spark, root, seen, exact=True).unionByName(_read_listed(spark, root, unseen)))


def scan_files(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame:
    """Files of any kind below ``root``, or of them ``files`` of a listing, in the columns of Spark's binary reader.

    As there, empty and hidden files are left out; executors list and read, so no path passes through the driver.
    """
    wanted = visible_files(spark, root) if files is None else files
    raw = _read_bytes(spark, root, wanted, exact=True)
    return raw.select(
        F.concat(F.lit(_qualified(spark, root) + "/"), "path").alias("path"),
        F.timestamp_millis("mod_time").alias("modificationTime"),
        F.col("size").alias("length"),
        F.col("raw").alias("content"),
    )


def visible_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, mod_time, size)`` of the files below ``root`` that Spark's readers see, with something in them."""
    files = list_tree(spark, root).filter(~F.col("is_dir") & (F.col("size") > 0) & ~hidden(F.col("path")))
    return files.select("path", "mod_time", "size")


def scan_changed(spark: SparkSession, root: str, known: DataFrame) -> DataFrame:
    """The notes that are new or changed since ``known`` was scanned; no other file is opened."""
    return notes_from_raw(_read_listed(spark, root, to_parse(_listed(spark, root), known)))


def refresh_notes(spark: SparkSession, root: str, known: DataFrame) -> DataFrame:
    """``known`` brought up to date with the folder, opening only new and changed files.

    What is stale is found on paths, times and sizes; the kept bodies are only
    filtered by it.
    """
    scratch = Scratch(spark, "refresh")
    listing = scratch.save(_listed(spark, root))
    version = ["path", "mod_time", "size"]
    stale = scratch.save(
        known.select(*version).join(listing.select(*version), version, "left_anti").select("path")
    )
    fresh = notes_from_raw(_read_listed(spark, root, to_parse(listing, known)))
    return known.join(stale, "path", "left_anti").select(*fresh.columns).unionByName(fresh)


def _listed(spark: SparkSession, root: str) -> DataFrame:
    return list_tree(spark, root).filter(
        ~F.col("is_dir") & F.endswith("path", F.lit(MARKDOWN_SUFFIX))
    )


def _read_listed(spark: SparkSession, root: str, files: DataFrame, exact: bool = False) -> DataFrame:
    """Contents of listed files as texts, read by executors. Unless ``exact``, what is no text in them is replaced."""
    return _read_bytes(spark, root, files, exact).withColumn("raw", F.col("raw").cast("string"))


def _read_bytes(spark: SparkSession, root: str, files: DataFrame, exact: bool) -> DataFrame:
    spread = files.select("path", "mod_time", "size").repartition(
        spark.sparkContext.defaultParallelism, "path"
    )
    return spread.mapInArrow(_reader(root, exact), _RAW)


def _qualified(spark: SparkSession, root: str) -> str:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    filesystem = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return filesystem.makeQualified(path).toString()


def _reader(root: str, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = open_root(root)
        rows, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                raw = unless_gone(lambda path=f"{base}/{row['path']}": _read(filesystem, path))
                if raw is None:
                    continue
                row["raw"] = raw if exact else raw.decode("utf-8", "replace").encode("utf-8")
                rows.append(row)
                held += len(row["raw"])
                if held >= _READ_BYTES or len(rows) >= _READ_FILES:
                    yield pa.RecordBatch.from_pylist(rows, _READ)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _READ)

    return run


def _read(filesystem: pafs.FileSystem, path: str) -> bytes:
    with filesystem.open_input_stream(path) as stream:
        return stream.readall()


def scan_folders(spark: SparkSession, root: str) -> DataFrame:
    """Every directory below ``root``, empty ones included."""
    return folders_from_paths(list_tree(spark, root).filter("is_dir").select("path"))


def render_notes(notes: DataFrame, front_matter: bool = True) -> DataFrame:
    """``(path, text)`` as it stands in a file; without the header for an export.

    A header that came from a file is written as it was; others are made from the tags.
    """
    text = F.col("content")
    if front_matter:
        text = F.concat(F.coalesce("header", build_front_matter(F.col("tags"))), text)
    return notes.select("path", text.alias("text"))


def write_notes(notes: DataFrame, root: str, front_matter: bool = True) -> int:
    """Write one Markdown file per note below ``root``; returns the number written.

    Executors write their own notes. A retried task writes the same files again.
    """
    rendered = render_notes(notes, front_matter)
    return write_files(rendered.select("path", F.col("text").cast("binary").alias("content")), root)


def write_files(files: DataFrame, root: str) -> int:
    """Write ``(path, content)``, bytes as they are, as files below ``root``; returns the number written."""
    written = files.select("path", "content").mapInArrow(_writer(root), "written bigint")
    return written.agg(F.coalesce(F.sum("written"), F.lit(0))).first()[0]


def _writer(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = open_root(root)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(
                batch.column("path").to_pylist(), batch.column("content").to_pylist()
            ):
                target = f"{base}/{path}"
                folder = target.rpartition("/")[0]
                if folder not in made:
                    filesystem.create_dir(folder, recursive=True)
                    made.add(folder)
                _replace_file(filesystem, target, content)
            yield pa.RecordBatch.from_pydict({"written": pa.array([batch.num_rows], pa.int64())})

    return run


def _replace_file(filesystem: pafs.FileSystem, target: str, data: bytes) -> None:
    # Each attempt writes a file of its own, so a second, speculative one does no harm.
    partial = f"{target}.{uuid.uuid4().hex}.tmp"
    with filesystem.open_output_stream(partial) as stream:
        stream.write(data)
    filesystem.move(partial, target)
