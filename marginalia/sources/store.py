"""A store of snapshots that share what they have in common.

Notes lie in buckets (``buckets.Layout``). A commit writes the buckets it changes, as new folders, or the notes it adds to them, and a
marker that says for every bucket which commits' folders hold it now. Readers keep the snapshot they opened,
and nothing that is being read is ever overwritten.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia.operators.search import has_tag
from marginalia.operators.tree import all_folders
from marginalia.schema import CHANGES, FOLDERS, NOTES
from marginalia.scratch import BODIES
from marginalia.sources.buckets import Layout, plan_layout

_COMMITS = "_commits"
_REJECTS = T.StructType([*CHANGES.fields, T.StructField("reason", T.StringType())])
_BUCKET = "bucket"
_TAG_INDEX = "tags"
_TAGS = f"tag string, {_BUCKET} int, path string"
_PLACED = f"path string, tags array<string>, {_BUCKET} int"
#: How often a commit looks again after another writer was faster, and how long it waits in between.
ATTEMPTS = 20
_WAIT_S = 0.1
#: Folder tables that commits may add before one of them writes all as one again.
FOLDER_PARTS = 20
#: Parts that a bucket may lie in before a commit that adds to it writes it as one again.
BUCKET_PARTS = 20


class CommitConflict(RuntimeError):
    """Another writer changed what this commit has read or writes."""


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


# ---- markers ----


def last_commit(spark: SparkSession, store: str) -> dict | None:
    """The newest commit marker, or None for a store that was never written.

    ``sources`` has the last batch that each stream committed. ``notes`` has the folders
    of the snapshot, each with its buckets, and ``folders`` those of its folder table.
    """
    for number in reversed(_numbers(spark, store)):
        body = _marker(spark, store, number)
        if body is not None:
            return body
    return None


def _numbers(spark: SparkSession, store: str) -> list[int]:
    filesystem, folder = _filesystem(spark, f"{store}/{_COMMITS}")
    if not filesystem.exists(folder):
        return []
    names = [status.getPath().getName() for status in filesystem.listStatus(folder)]
    return sorted(int(name) for name in names if name.isdigit())


def _marker(spark: SparkSession, store: str, number: int) -> dict | None:
    """One marker; None while its writer has not finished it."""
    filesystem, path = _filesystem(spark, f"{store}/{_COMMITS}/{number:012d}")
    stream = filesystem.open(path)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return {"sources": {}, **json.loads(text), "number": number}
    except ValueError:
        return None


def _mark(spark: SparkSession, store: str, number: int, body: dict) -> None:
    """Write a marker that must not be there yet: of two writers only one can create it."""
    filesystem, path = _filesystem(spark, f"{store}/{_COMMITS}/{number:012d}")
    filesystem.mkdirs(path.getParent())
    try:
        stream = filesystem.create(path, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        raise CommitConflict(f"commit {number} was taken by another writer") from error
    stream.write(json.dumps(body).encode("utf-8"))
    stream.close()


def committed(commit: dict | None, source: str) -> bool:
    """Whether a batch, "stream#batch", or a later one of its stream, is in the store."""
    stream, _, batch = source.rpartition("#")
    return bool(commit) and bool(stream) and commit["sources"].get(stream, -1) >= int(batch)


def layout_of(commit: dict) -> Layout:
    return Layout(commit["layout"]["buckets"], commit["layout"]["hot"])


# ---- reading ----


def read_store(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """``(notes, folders)`` of the current snapshot; empty tables for a new store.

    ``folders`` has all folders, those that only notes imply included.
    """
    commit = last_commit(spark, store)
    if commit is None:
        return spark.createDataFrame([], NOTES), spark.createDataFrame([], FOLDERS)
    return read_buckets(spark, store, commit), read_folders(spark, store, commit)


def read_buckets(spark: SparkSession, store: str, commit: dict, wanted: Iterable[int] | None = None) -> DataFrame:
    """The notes of some buckets of a commit, or of all."""
    chosen = None if wanted is None else set(wanted)
    paths = [
        f"{store}/{name}/notes/{_BUCKET}={bucket}"
        for name, buckets in commit["notes"].items()
        for bucket in buckets
        if chosen is None or bucket in chosen
    ]
    return spark.read.schema(NOTES).parquet(*paths) if paths else spark.createDataFrame([], NOTES)


def read_folders(spark: SparkSession, store: str, commit: dict) -> DataFrame:
    paths = [f"{store}/{name}/folders" for name in commit["folders"]]
    folders = spark.read.schema(FOLDERS).parquet(*paths) if paths else spark.createDataFrame([], FOLDERS)
    return folders.dropDuplicates(["path"]) if len(paths) > 1 else folders


def read_folder(spark: SparkSession, store: str, folder: str) -> DataFrame:
    """The notes directly in a folder of the current snapshot; only its buckets are opened."""
    commit = last_commit(spark, store)
    if commit is None:
        return spark.createDataFrame([], NOTES)
    buckets = spark.range(1).select(layout_of(commit).of_folder(F.lit(folder)).alias("b")).first().b
    return read_buckets(spark, store, commit, buckets).filter(F.col("folder") == folder)


def read_note(spark: SparkSession, store: str, path: str) -> DataFrame:
    """The note at a path of the current snapshot, or none; only its bucket is opened."""
    commit = last_commit(spark, store)
    if commit is None:
        return spark.createDataFrame([], NOTES)
    place = layout_of(commit).bucket(F.lit(path.rpartition("/")[0]), F.lit(path))
    bucket = spark.range(1).select(place.alias("b")).first().b
    return read_buckets(spark, store, commit, [bucket]).filter(F.col("path") == path)


def read_tagged(spark: SparkSession, store: str, tag: str) -> DataFrame:
    """The notes of the current snapshot that carry a tag, in any case; only buckets that hold some are opened.

    Which those are is read from the tag index: each commit's own (tag, path) table, clustered by tag, of
    which the rows of buckets that later commits have written anew no longer count.
    """
    commit = last_commit(spark, store)
    if commit is None:
        return spark.createDataFrame([], NOTES)
    wanted, found = F.lower(F.lit(tag)), set()
    for holder, buckets in commit["notes"].items():
        if holder not in commit.get("tagged", []):  # a commit of before there was an index
            found.update(buckets)
            continue
        index = spark.read.schema(_TAGS).parquet(f"{store}/{holder}/{_TAG_INDEX}")
        hits = index.filter(F.col("tag") == wanted).select(_BUCKET).distinct()
        found.update({row.bucket for row in hits.collect()} & set(buckets))
    return read_buckets(spark, store, commit, found).filter(has_tag(tag))


def read_table(spark: SparkSession, store: str, commit: dict | None, name: str, schema: T.StructType) -> DataFrame:
    """A table that commits carry besides notes and folders; empty if none has written it."""
    holder = (commit or {}).get("tables", {}).get(name)
    return spark.read.schema(schema).parquet(f"{store}/{holder}/{name}") if holder else spark.createDataFrame([], schema)


def read_queue(spark: SparkSession, store: str) -> DataFrame:
    """The changes that wait behind a failed one of their client, and those failed ones."""
    return read_table(spark, store, last_commit(spark, store), "queue", CHANGES)


def read_rejects(spark: SparkSession, store: str) -> DataFrame:
    """Rejected changes of every commit of the store, with the snapshot they belong to."""
    markers = [_marker(spark, store, number) for number in _numbers(spark, store)]
    paths = [f"{store}/{m['snapshot']}/rejects" for m in markers if m and m.get("rejects")]
    if paths:
        rejects = spark.read.schema(_REJECTS).parquet(*paths)
    else:
        rejects = spark.createDataFrame([], _REJECTS)
    return rejects.withColumn(
        "snapshot", F.regexp_extract(F.input_file_name(), r"/(snapshot-\d+-[0-9a-f]+)/", 1)
    )


# ---- writing ----


def _write_notes(notes: DataFrame, layout: Layout, base: str) -> list[int]:
    """Write notes into their buckets; returns those that have some.

    Each bucket is sorted by folder and path, so filters on them skip most of its files, and
    the range is over all three, so a large bucket is written by several tasks.
    """
    order = [_BUCKET, "folder", "path"]
    placed = notes.withColumn(_BUCKET, layout.bucket(F.col("folder"), F.col("path")))
    placed = placed.select(_BUCKET, *NOTES.fieldNames()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed.write.option("compression", BODIES).partitionBy(_BUCKET).parquet(f"{base}/notes")
    filesystem, path = _filesystem(notes.sparkSession, f"{base}/notes")
    names = [status.getPath().getName() for status in filesystem.listStatus(path)]
    return sorted(int(name.partition("=")[2]) for name in names if name.startswith(f"{_BUCKET}="))


def _write_tags(spark: SparkSession, written: list[int], base: str) -> bool:
    """The tag index of the notes just written; only paths and tags are read again."""
    if not written:
        return False
    notes = spark.read.schema(_PLACED).parquet(f"{base}/notes")
    tags = notes.select(F.explode(F.array_distinct(F.transform("tags", lambda t: F.lower(t)))).alias("tag"), _BUCKET, "path")
    order = ["tag", _BUCKET, "path"]
    tags.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{base}/{_TAG_INDEX}")
    return True


def _with_source(commit: dict | None, source: str) -> dict[str, int]:
    sources = dict(commit["sources"]) if commit else {}
    stream, mark, batch = source.rpartition("#")
    if mark and batch.isdigit():
        sources[stream] = int(batch)
    return sources


def write_snapshot(
    notes: DataFrame,
    folders: DataFrame,
    store: str,
    rejects: DataFrame | None = None,
    source: str = "",
    cluster: bool = True,
    expected: int | None = None,
    buckets: int | None = None,
    tables: dict[str, DataFrame] | None = None,
) -> int:
    """Write a whole snapshot, then make it current in one step; returns its number.

    A writer that fails before its marker leaves the store as it was. ``expected`` names the commit
    the new snapshot was computed from, so a concurrent commit is detected. ``buckets`` is
    how many there will be; without it their number follows the size of the notes. Every snapshot written as
    a whole plans its layout anew, so a store that has grown far is laid out again by
    writing what it holds. A ``source`` "stream#batch" is remembered for its stream through all later
    commits. ``cluster`` is kept for older callers; buckets are always sorted.
    """
    spark = notes.sparkSession
    commit = last_commit(spark, store)
    number = commit["number"] if commit else 0
    if expected is not None and expected != number:
        raise CommitConflict(f"store is at {number}, not {expected}")
    name = f"snapshot-{number + 1:012d}-{uuid.uuid4().hex}"
    layout = plan_layout(notes, buckets)
    written = _write_notes(notes, layout, f"{store}/{name}")
    tagged = _write_tags(spark, written, f"{store}/{name}")
    all_folders(notes, folders).write.parquet(f"{store}/{name}/folders")
    if rejects is not None:
        rejects.write.parquet(f"{store}/{name}/rejects")
    for key, table in (tables or {}).items():
        table.write.parquet(f"{store}/{name}/{key}")
    body = {
        "snapshot": name,
        "tables": {**(commit or {}).get("tables", {}), **dict.fromkeys(tables or {}, name)},
        "source": source,
        "sources": _with_source(commit, source),
        "rejects": rejects is not None,
        "layout": {"buckets": layout.buckets, "hot": layout.hot},
        "notes": {name: written},
        "tagged": [name] if tagged else [],
        "folders": [name],
        "changed": None,  # everything
    }
    _mark(spark, store, number + 1, body)
    return number + 1


def write_buckets(
    spark: SparkSession,
    store: str,
    base: dict,
    notes: DataFrame,
    changed: Iterable[int],
    read: Iterable[int] = (),
    added_to: Iterable[int] = (),
    new_folders: DataFrame | None = None,
    all_new_folders: DataFrame | None = None,
    rejects: DataFrame | None = None,
    source: str = "",
    tables: dict[str, DataFrame] | None = None,
    before_mark: Callable[[], None] | None = None,
) -> int:
    """Commit ``notes`` as the whole content of the ``changed`` buckets, and on top of that of other buckets ``added_to``, on commit ``base``.

    What else there is stays where it is. ``read`` has the buckets that decided what ``notes`` are, besides the
    changed ones. If others have committed since ``base``, the commit goes on top of theirs when
    they changed none of these buckets, and is a ``CommitConflict`` otherwise. ``new_folders`` are added to
    the folder table; ``all_new_folders`` replace it, and such a commit goes on top of no other.
    ``tables`` are named tables that the commit carries; a commit that replaces one goes on top of no other that
    has done so. ``before_mark`` is called when all is written.
    """
    replaced, changed = set(changed), sorted({*changed, *added_to})
    name = f"snapshot-{base['number'] + 1:012d}-{uuid.uuid4().hex}"
    written = _write_notes(notes, layout_of(base), f"{store}/{name}") if changed else []
    if not set(written) <= set(changed):
        raise ValueError("notes lie in buckets that are not among the changed ones")
    tagged = _write_tags(spark, written, f"{store}/{name}")
    replaces = all_new_folders is not None
    parts = base["folders"]
    if new_folders is not None and len(parts) >= FOLDER_PARTS:
        # All of ``base`` as one table; what others have added since stays beside it.
        new_folders = read_folders(spark, store, base).unionByName(new_folders).dropDuplicates(["path"])
        parts = []
    table = all_new_folders if replaces else new_folders
    if table is not None:
        table.write.parquet(f"{store}/{name}/folders")
    if rejects is not None:
        rejects.write.parquet(f"{store}/{name}/rejects")
    for key, carried in (tables or {}).items():
        carried.write.parquet(f"{store}/{name}/{key}")
    if before_mark:
        before_mark()
    mine, last = {*changed, *read}, CommitConflict("")
    for attempt in range(ATTEMPTS):
        top = last_commit(spark, store)
        if committed(top, source):
            raise CommitConflict(f"{source} was committed by another writer")
        _check_disjoint(spark, store, base["number"], top["number"], mine, replaces)
        if any(top.get("tables", {}).get(key) != base.get("tables", {}).get(key) for key in tables or {}):
            raise CommitConflict("another writer has replaced a table that this commit replaces")
        others = [part for part in top["folders"] if part not in base["folders"]]
        kept = {d: [b for b in buckets if b not in replaced] for d, buckets in top["notes"].items()}
        held = {d: buckets for d, buckets in {**kept, name: written}.items() if buckets}
        indexed = {*top.get("tagged", []), *([name] if tagged else [])}
        body = {
            "snapshot": name,
            "tables": {**top.get("tables", {}), **dict.fromkeys(tables or {}, name)},
            "source": source,
            "sources": _with_source(top, source),
            "rejects": rejects is not None,
            "layout": top["layout"],
            "notes": held,
            "tagged": sorted(indexed & held.keys()),
            "folders": [name] if replaces else [*parts, *others, *([name] if table is not None else [])],
            "changed": None if replaces else changed,
        }
        try:
            _mark(spark, store, top["number"] + 1, body)
            return top["number"] + 1
        except CommitConflict as conflict:
            last = conflict
            time.sleep(_WAIT_S * attempt)
    raise last


def _check_disjoint(spark: SparkSession, store: str, base: int, top: int, mine: set[int], replaces: bool) -> None:
    for number in range(base + 1, top + 1):
        other = _marker(spark, store, number)
        if other is None:
            continue
        theirs = other["changed"]
        if replaces or theirs is None or mine & set(theirs):
            raise CommitConflict(f"commit {number} changed what this one, made on commit {base}, has read or writes")


def expire_snapshots(spark: SparkSession, store: str, keep: int = 2) -> int:
    """Delete what only commits before the last ``keep`` hold; returns how many those are.

    Buckets and folder tables that a kept commit shares with older ones stay, and so do rejects and
    markers. Nobody may still be reading the expired snapshots.
    """
    numbers = _numbers(spark, store)
    cut = len(numbers) - keep if keep else 0
    bodies = [_marker(spark, store, number) for number in numbers]

    def held(some: list[dict | None]) -> set[str]:
        notes = {f"{d}/notes/{_BUCKET}={b}" for m in some if m for d, buckets in m["notes"].items() for b in buckets}
        carried = {f"{d}/{key}" for m in some if m for key, d in m.get("tables", {}).items()}
        indexes = {f"{d}/{_TAG_INDEX}" for m in some if m for d in m.get("tagged", [])}
        return notes | indexes | carried | {f"{part}/folders" for m in some if m for part in m["folders"]}

    for part in sorted(held(bodies[:cut]) - held(bodies[cut:])):
        filesystem, path = _filesystem(spark, f"{store}/{part}")
        filesystem.delete(path, True)
    return max(cut, 0)
