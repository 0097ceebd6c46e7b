"""Committing change logs to a store: only the buckets they touch are read and written."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.paths import dirname
from marginalia.operators.changes import Apply
from marginalia.operators.queue import coalesce_changes, replay_prefix
from marginalia.schema import CHANGES, FOLDERS, NOTES
from marginalia.scratch import Scratch, scratch_scope
from marginalia.sources.store import (
    BUCKET_PARTS,
    CommitConflict,
    committed,
    last_commit,
    layout_of,
    read_buckets,
    read_folders,
    read_table,
    write_buckets,
    write_snapshot,
)

#: How often a log is worked out again after a conflicting commit of another writer.
RETRIES = 3


def _buckets(paths: DataFrame, bucket: Column) -> set[int]:
    """The distinct values of a bucket column: at most as many as the store has."""
    return {row.bucket for row in paths.select(bucket.alias("bucket")).distinct().collect()}


def commit_changes(
    spark: SparkSession,
    store: str,
    changes: DataFrame,
    source: str = "",
    retries: int = RETRIES,
    hold: bool = False,
    coalesce: bool = False,
    refused: DataFrame | None = None,
    written: bool = False,
) -> int | None:
    """Apply a change log to a store and commit the outcome; returns its number, None if ``source`` is in already.

    Deciding reads the buckets of the folders that the log names, narrow columns only; after folder
    changes, the paths of all notes. Then the buckets that notes were changed in or went from are written anew, those that
    only got new ones get them as one more part, and no other is read or written. If another writer has changed any of these buckets meanwhile the log is worked out again on
    top of that commit, ``retries`` times; disjoint commits don't stand in each other's way.

    With ``hold``, a client's changes end at its first one, by ``(ts, key, seq)``, that can't be applied: that
    one and all behind it stay in the store's queue (``read_queue``) and are tried again with the next
    log; the rejects then have the ones that failed. ``coalesce`` keeps the last change of
    each key, those in the queue included. ``refused`` are changes, with a ``reason``, that were turned away
    before; the commit only keeps them among its rejects. ``written``: ``changes`` are read from a table of their own, which is not copied.
    """
    while True:
        commit = last_commit(spark, store)
        if committed(commit, source):
            return None
        try:
            with scratch_scope(spark):
                return _commit(spark, store, commit, changes, source, hold, coalesce, refused, written)
        except CommitConflict:
            if not retries:
                raise
            retries -= 1


def _held_back(scratch: Scratch, changes: DataFrame, resolve) -> tuple[Apply, DataFrame, DataFrame]:
    """``(log, queue, failed)``: what can be applied when every client stops at its first failure.

    Leaving changes out can make others fail that built on them, so the rest is resolved again until nothing
    fails; each round leaves out more, and one more is enough unless clients build on each other.
    """
    active, failed = changes, scratch.spark.createDataFrame([], "seq bigint, reason string")
    while True:
        log = resolve(active)
        bad = scratch.save(log.all_rejects().select("seq", "reason"))
        if bad.isEmpty():
            break
        results = active.join(bad.select("seq", F.lit(False).alias("ok")), "seq", "left")
        results = results.withColumns({"ok": F.coalesce("ok", F.lit(True)), "_queue": F.coalesce("client_id", F.lit(""))})
        marked = scratch.save(replay_prefix(results, "_queue").select(*CHANGES.fieldNames(), "status"))
        failed = failed.unionByName(bad.join(marked.filter("status = 'failed'").select("seq"), "seq", "left_semi"))
        active = scratch.save(marked.filter("status = 'applied'").drop("status"))
    queue = changes.join(active.select("seq"), "seq", "left_anti")
    return log, queue, changes.join(failed, "seq").select(*CHANGES.fieldNames(), "reason")


def _commit(
    spark: SparkSession,
    store: str,
    commit: dict | None,
    changes: DataFrame,
    source: str,
    hold: bool,
    coalesce: bool,
    refused: DataFrame | None,
    written: bool,
) -> int:
    scratch = Scratch(spark, "commit")
    changes = changes.select(*CHANGES.fieldNames())
    if hold:
        changes = changes.unionByName(read_table(spark, store, commit, "queue", CHANGES))
    if coalesce or hold or not written:
        changes = scratch.save(coalesce_changes(changes) if coalesce else changes)
    layout, read = layout_of(commit) if commit else None, set()

    def near(plan: DataFrame) -> DataFrame:
        """The notes of the folders that a plan names: families never cross folders."""
        folders = plan.select(F.explode(F.array(dirname(F.col("family")), dirname(F.col("target_family")))).alias("folder"))
        folders = folders.filter("folder IS NOT NULL").distinct()
        found = _buckets(folders.select(F.explode(layout.of_folder(F.col("folder"))).alias("bucket")), F.col("bucket"))
        read.update(found)
        return read_buckets(spark, store, commit, found)

    if commit:
        before = read_buckets(spark, store, commit), read_folders(spark, store, commit)
    else:
        before = spark.createDataFrame([], NOTES), spark.createDataFrame([], FOLDERS)

    def resolve(some: DataFrame) -> Apply:
        log = Apply(*before, some, near=near if commit else None, complete=True)
        log.resolve()
        return log

    if hold:
        log, queue, rejects = _held_back(scratch, changes, resolve)
        tables = {"queue": queue}
    else:
        log, tables = resolve(changes), None
        rejects = log.all_rejects()
    if refused is not None:
        rejects = rejects.select(*CHANGES.fieldNames(), "reason").unionByName(refused)
    if not commit:
        notes = scratch.save(log.new_notes(), bodies=True)
        return write_snapshot(notes, log.new_folders(), store, rejects, source=source, expected=0, tables=tables)
    if log.moves:
        read.update(b for buckets in commit["notes"].values() for b in buckets)
    paths = scratch.save(log.changed_paths())
    place = layout.bucket(dirname(F.col("path")), F.col("path"))
    changed = _buckets(paths.select("path").filter("path IS NOT NULL"), place)
    added_to = _buckets(paths.select(F.col("new_path").alias("path")).filter("path IS NOT NULL"), place)
    # A bucket in many parts is written as one again.
    changed |= added_to & {b for b, n in Counter(b for held in commit["notes"].values() for b in held).items() if n >= BUCKET_PARTS}
    copied = _buckets(log.copied_paths(), layout.bucket(dirname(F.col("path")), F.col("path")))
    notes = log.new_notes(read_buckets(spark, store, commit, changed), read_buckets(spark, store, commit, copied))
    added = log.added_folders()
    if added is not None:
        added = scratch.save(added)
        added = None if added.isEmpty() else added
    return write_buckets(
        spark,
        store,
        commit,
        notes,
        changed,
        read=read | copied,
        added_to=added_to,
        new_folders=added,
        all_new_folders=None if log.folder_set is None else log.new_folders(),
        rejects=rejects,
        source=source,
        tables=tables,
    )
