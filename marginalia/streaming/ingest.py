"""Files that drop into a folder, taken into a store as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.operators.allocate import order_blocks, ordinal_within
from marginalia.operators.sorting import sort_once
from marginalia.scratch import Scratch, scratch_scope
from marginalia.sources.commits import commit_changes
from marginalia.sources.files import scan_files, visible_files
from marginalia.sources.ingest import as_creates, as_rejects, ingest_gate
from marginalia.sources.store import _filesystem, committed, last_commit

_TAKEN = "path string, mod_time bigint, size bigint, batch bigint"


def ingest_batch(files: DataFrame, store: str, source: str, folder: str = "") -> int | None:
    """Commit one drop of files as new notes of ``folder``; returns the snapshot number, or None if it is in already.

    Files that the gate refuses are kept in the commit's rejects with their reason. Names are
    given out in order of time and path, so a batch that is worked out again gives the same notes.
    """
    spark = files.sparkSession
    if committed(last_commit(spark, store), source):
        return None
    with scratch_scope(spark):
        scratch = Scratch(spark, "ingest")
        with scratch_scope(spark):  # the files as they came are gone before the commit needs the space
            creates, refused = _gated(scratch, Scratch(spark, "files"), files, folder)
        return commit_changes(spark, store, creates, source, refused=refused, written=True)


def _gated(scratch: Scratch, passing: Scratch, files: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """``(creates, refused)`` of a drop, both written; only narrow rows are sorted."""
    came = passing.save(files.withColumn("_file", F.monotonically_increasing_id()), bodies=True)
    in_order = sort_once(came.select("_file", F.unix_millis("modificationTime").alias("mod_time"), "path"), "mod_time", "path")
    places = passing.save(in_order.select("_file", F.monotonically_increasing_id().alias("_place")))
    accepted, rejected = ingest_gate(came, folder, keep=["_file"])
    creates = scratch.save(as_creates(accepted.join(places, "_file"), F.col("_place")), bodies=True)
    return creates, scratch.save(as_rejects(rejected))


def stream_ingest(
    spark: SparkSession,
    drop: str,
    store: str,
    checkpoint: str,
    folder: str = "",
    trigger: dict | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Start taking the files below ``drop`` into ``store``; by default all that are there, and stop.

    Each file is taken once, in one batch, and each batch is committed once: one that comes again after
    a failure is recognised by its number. Empty files and names that begin with ``.`` or ``_``, which is
    how a file that is still being written stays out, are not seen.

    A trigger only asks for a look at the folder. Executors list it, and the checkpoint keeps a table of the paths that
    were taken and their batches, so neither paths nor contents gather on the driver, as those of
    Spark's file source do.
    """
    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()

    def handle(_: DataFrame, look: int) -> None:
        with scratch_scope(spark):
            files = _taken(spark, drop, f"{checkpoint}/taken", look, files_per_batch)
            first, last = files.agg(F.min("batch"), F.max("batch")).first()
            for number in [] if first is None else range(first, last + 1):
                batch = scan_files(spark, drop, files.filter(F.col("batch") == number))
                ingest_batch(batch, store, f"{checkpoint}#{number}", folder)

    return (
        clock.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _taken(spark: SparkSession, drop: str, table: str, look: int, most: int | None) -> DataFrame:
    """The files that a look finds new, with the numbers of their batches; a look that is repeated finds the same."""
    own = f"{table}/look={look}"
    if not _there(spark, f"{own}/_SUCCESS"):
        before = spark.createDataFrame([], _TAKEN)
        if _there(spark, table):  # what a look that failed has left there does not count
            before = spark.read.schema(f"{_TAKEN}, look bigint").parquet(table).filter(F.col("look") < look).drop("look")
        new = visible_files(spark, drop).join(before.select("path"), "path", "left_anti")
        number = F.lit(before.agg(F.coalesce(F.max("batch"), F.lit(-1)) + 1).first()[0]).cast("bigint")
        if most:
            in_order = sort_once(new, "mod_time", "path").withColumn("at", F.monotonically_increasing_id())
            saved = Scratch(spark, "drop").save(in_order)
            new = ordinal_within(saved, [], "at", "place", order_blocks(saved, "at"))
            number = number + F.call_function("div", F.col("place") - 1, F.lit(most))
        new.select("path", "mod_time", "size", number.alias("batch")).write.mode("overwrite").parquet(own)
    return spark.read.schema(_TAKEN).parquet(own)


def _there(spark: SparkSession, path: str) -> bool:
    filesystem, at = _filesystem(spark, path)
    return filesystem.exists(at)
