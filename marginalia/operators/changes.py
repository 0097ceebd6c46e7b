"""Applying an ordered change log to a snapshot of notes and folders.

Order is decided on narrow rows (paths, tags, times) of the touched notes only.
Bodies are read once, at the end, when the new snapshot is put together.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.frontmatter import build_front_matter
from marginalia.functions.names import family
from marginalia.functions.paths import ancestors, dirname, normalize_path, note_name, rewrite_prefix
from marginalia.functions.text import preview
from marginalia.operators.change_plan import plan_changes
from marginalia.operators.folder_ops import (
    CREATE_KIND,
    ORDERED_KINDS,
    FolderOp,
    made_folders,
    resolve_run,
    rewrites,
)
from marginalia.operators.rounds import STATE_COLUMNS, apply_plan
from marginalia.operators.tree import all_folders
from marginalia.schema import CHANGES, NOTES, folders_from_paths
from marginalia.scratch import Scratch

# Folder changes fetched at a time; a longer log is worked through in further fetches.
FOLDER_OPS_PER_FETCH = 500


def apply_changes(
    notes: DataFrame, folders: DataFrame, changes: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(notes, folders, rejects)`` after applying ``changes`` in the order of ``seq``.

    ``seq`` is unique, like a log position; a log in which it repeats or is missing
    is refused. A change that cannot be applied has
    no effect and is kept in ``rejects`` with a ``reason``: illegal_path,
    not_found, exists or into_itself.
    """
    return Apply(notes, folders, changes).run()


class Apply:
    """A change log on its way into a snapshot.

    ``near``, if given, returns the notes that can share a family with a plan's; it is asked while no folder has
    moved. ``complete`` says that ``folders`` has all folders, those that only notes imply included.
    """

    def __init__(
        self,
        notes: DataFrame,
        folders: DataFrame,
        changes: DataFrame,
        near: Callable[[DataFrame], DataFrame] | None = None,
        complete: bool = False,
    ):
        self.spark = changes.sparkSession
        self.near = near
        self.complete = complete
        self.scratch = Scratch(self.spark, "apply")
        self.notes = notes
        self.folders = folders
        self.changes = changes
        self.state: DataFrame | None = None  # touched notes, once there are any
        self.moves: list[tuple[str, str | None]] = []
        self.made: list[DataFrame] = []
        self.rejects: list[DataFrame] = []
        self.folder_set: DataFrame | None = None

    def run(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        self.resolve()
        return self.new_notes(), self.new_folders(), self.all_rejects()

    def resolve(self) -> None:
        """Decide what becomes of every change."""
        rows, distinct = self.changes.agg(F.count("*"), F.count_distinct("seq")).first()
        if rows != distinct:
            raise ValueError(f"{rows} changes have {distinct} different values of seq; each needs its own")
        kind = F.col("kind")
        folder_log = self.scratch.save(
            self.changes.filter(kind.isin(*ORDERED_KINDS)).select(
                "seq",
                "kind",
                normalize_path(F.col("path")).alias("path"),
                normalize_path(F.coalesce("folder", F.lit(""))).alias("folder"),
                "name",
            )
        )
        self.plan = self.scratch.save(
            plan_changes(self.changes.filter(~kind.isin(*ORDERED_KINDS)))
        )
        done = None
        while True:
            rest = folder_log if done is None else folder_log.filter(F.col("seq") > done)
            fetched = rest.orderBy("seq").limit(FOLDER_OPS_PER_FETCH).collect()
            if not fetched:
                break
            if self.folder_set is None:
                known = self.folders if self.complete else all_folders(self.notes, self.folders)
                added = _union([known.select("path"), *self.made])
                self.folder_set = self.scratch.save(added.distinct())
            done = self._interleave([FolderOp(*row) for row in fetched], done)
        self._note_phase(self.plan if done is None else self.plan.filter(F.col("seq") > done))

    def _interleave(self, ops: list[FolderOp], done: int | None) -> int:
        """Note changes up to the last of ``ops``, each run of folder changes in its place."""
        between = self.plan.filter(F.col("seq") < ops[-1].seq)
        if done is not None:
            between = between.filter(F.col("seq") > done)
        seqs = F.array(*[F.lit(op.seq) for op in ops])
        passed = F.size(F.filter(seqs, lambda s: s < F.col("seq")))
        breaks = {row[0] for row in between.select(passed).distinct().collect()}
        starts = sorted({0, *breaks})
        for start, stop in zip(starts, [*starts[1:], len(ops)]):
            first = ops[start].seq
            if start in breaks:
                part = between.filter(F.col("seq") < first)
                if start:
                    part = part.filter(F.col("seq") > ops[start - 1].seq)
                self._note_phase(part)
            self._folder_run(ops[start:stop])
        return ops[-1].seq

    def _folder_run(self, ops: list[FolderOp]) -> None:
        known = self.folder_set

        def lookup(paths: set[str]) -> list[str]:
            found = known.filter(F.col("path").isin(*sorted(paths)))
            return [row.path for row in found.collect()]

        applied, rejects = resolve_run(ops, lookup)
        if rejects:
            self.rejects.append(
                self.spark.createDataFrame(sorted(rejects.items()), "seq bigint, reason string")
            )
        moves = rewrites(applied)
        made = self.spark.createDataFrame([(p,) for p in made_folders(applied)], "path string")
        self.moves += moves
        if self.state is not None:
            self.state = self.state.withColumn("path", rewrite_prefix(F.col("path"), moves))
        moved = known.select(rewrite_prefix(F.col("path"), moves).alias("path"))
        self.folder_set = self.scratch.save(
            moved.filter("path IS NOT NULL").unionByName(made).distinct()
        )

    def _note_phase(self, plan: DataFrame) -> None:
        """Note changes, and folders created, between two runs of ordered folder changes."""
        actions = {row.action for row in plan.select("action").distinct().collect()}
        if not actions:
            return
        created = plan.filter(F.col("action") == CREATE_KIND)
        self.rejects.append(created.filter("reason IS NOT NULL").select("seq", "reason"))
        made = created.filter("reason IS NULL").select("path")
        if actions != {CREATE_KIND}:
            plan = plan.filter(F.col("action") != CREATE_KIND)
            outcome = apply_plan(self.scratch, plan, self._pull(plan))
            self.state = outcome.state
            self.rejects += outcome.rejects
            made = _union([made, *outcome.made])
        if self.folder_set is None:
            self.made.append(made)
            return
        added = made.distinct().select(F.explode(ancestors(F.col("path"))).alias("path"))
        self.folder_set = self.scratch.save(self.folder_set.unionByName(added).distinct())

    def _pull(self, plan: DataFrame) -> DataFrame:
        """The touched notes: those already in the state, and the rest of the families named."""
        named = plan.select(F.explode(F.array("family", "target_family")).alias("family"))
        notes = self.notes if self.near is None or self.moves else self.near(plan)
        here = notes.select(
            rewrite_prefix(F.col("path"), self.moves).alias("path"),
            F.col("path").alias("own_path"),
            F.col("path").alias("body_path"),
            F.lit(None).cast("bigint").alias("body_seq"),
            "tags",
            "mod_time",
            F.lit(False).alias("dirty"),
        ).filter("path IS NOT NULL")
        pulled = (
            here.withColumn("family", family(F.col("path")))
            .join(named.distinct(), "family", "left_semi")
            .drop("family")
        )
        if self.state is not None:
            known = self.state.select("own_path")
            pulled = self.state.unionByName(pulled.join(known, "own_path", "left_anti"))
        return self.scratch.save(pulled.select(*STATE_COLUMNS))

    def changed_paths(self) -> DataFrame:
        """``(path, new_path)`` of the notes that the log changes: new ones have no path, deleted ones no new path."""
        path, new = F.col("path"), F.col("new_path")
        parts = []
        if self.state is not None:
            own = self.state.select(F.col("own_path").alias("path"), path.alias("new_path"), "dirty", "body_seq")
            same = path.eqNullSafe(new) & ~F.col("dirty") & F.col("body_seq").isNull()
            parts.append(own.filter(~same & (path.isNotNull() | new.isNotNull())).select("path", "new_path"))
        if self.moves:
            moved = self.notes.select("path", rewrite_prefix(path, self.moves).alias("new_path"))
            moved = moved.filter(~path.eqNullSafe(new))
            if self.state is not None:
                known = self.state.select(F.col("own_path").alias("path"))
                moved = moved.join(known, "path", "left_anti")
            parts.append(moved)
        return _union(parts) if parts else self.spark.createDataFrame([], "path string, new_path string")

    def copied_paths(self) -> DataFrame:
        """``(path)`` of the notes whose bodies are copied under other paths."""
        if self.state is None:
            return self.spark.createDataFrame([], "path string")
        copies = self.state.filter("path IS NOT NULL AND own_path IS NULL AND body_seq IS NULL AND body_path IS NOT NULL")
        return copies.select(F.col("body_path").alias("path"))

    def added_folders(self) -> DataFrame | None:
        """The folders that are not there yet; None where folder changes leave no plain addition."""
        if self.folder_set is not None:
            return None
        made = _union([self.spark.createDataFrame([], "path string"), *self.made]).distinct()
        made = made.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
        known = self.folders if self.complete else all_folders(self.notes, self.folders)
        return folders_from_paths(made.join(known.select("path"), "path", "left_anti"))

    def new_notes(self, old: DataFrame | None = None, originals: DataFrame | None = None) -> DataFrame:
        """The new snapshot: bodies come from the old one, or from the log.

        ``old`` are the notes to start from if not all of them, and ``originals`` those that have the copied bodies.
        """
        old = self.notes if old is None else old
        originals = self.notes if originals is None else originals
        if self.state is None:
            return self._moved_only(old)
        own = self.state.filter("own_path IS NOT NULL").select(
            F.col("own_path").alias("path"),
            F.col("path").alias("new_path"),
            "body_seq",
            F.col("tags").alias("new_tags"),
            F.col("mod_time").alias("new_time"),
            "dirty",
            F.lit(True).alias("touched"),
        )
        touched = F.col("touched").isNotNull()
        kept = old.join(own, "path", "left").filter("body_seq IS NULL")
        kept = kept.select(
            F.when(touched, F.col("new_path"))
            .otherwise(rewrite_prefix(F.col("path"), self.moves))
            .alias("path"),
            "content",
            F.when(touched, F.col("new_tags")).otherwise(F.col("tags")).alias("tags"),
            F.when(touched, F.col("new_time")).otherwise(F.col("mod_time")).alias("mod_time"),
            "size",
            "preview",
            "header",
            F.coalesce("dirty", F.lit(False)).alias("dirty"),
        ).filter("path IS NOT NULL")

        live = self.state.filter("path IS NOT NULL")
        meta = ["path", "tags", "mod_time", "dirty"]
        bodies = originals.select(F.col("path").alias("body_path"), "content", "size", "preview", "header")
        copied = live.filter(
            "own_path IS NULL AND body_seq IS NULL AND body_path IS NOT NULL"
        ).join(bodies, "body_path")
        log = self.changes.select(F.col("seq").alias("body_seq"), "content")
        written = live.filter("body_seq IS NOT NULL").join(log, "body_seq")
        blank = live.filter("body_seq IS NULL AND body_path IS NULL").withColumn(
            "content", F.lit("")
        )
        fresh = written.select(*meta, "content").unionByName(blank.select(*meta, "content"))
        fresh = fresh.withColumns(
            {
                "size": F.lit(None).cast("bigint"),
                "preview": preview(F.col("content")),
                "header": F.lit(None).cast("string"),
                "dirty": F.lit(True),
            }
        )
        columns = [*meta, "content", "size", "preview", "header"]
        merged = (
            kept.select(*columns)
            .unionByName(copied.select(*columns))
            .unionByName(fresh.select(*columns))
        )
        full_size = F.octet_length(build_front_matter(F.col("tags"))) + F.octet_length("content")
        return merged.withColumns(
            {
                "folder": dirname(F.col("path")),
                "name": note_name(F.col("path")),
                "size": F.when(F.col("dirty"), full_size.cast("bigint")).otherwise(F.col("size")),
                # Only a note that was written gets a header made from its tags.
                "header": F.when(~F.col("dirty"), F.col("header")),
            }
        ).select(*NOTES.fieldNames())

    def _moved_only(self, old: DataFrame) -> DataFrame:
        """Folder changes alone rewrite paths in place; no row meets another."""
        moved = old.withColumn("path", rewrite_prefix(F.col("path"), self.moves))
        return (
            moved.filter("path IS NOT NULL")
            .withColumns(
                {"folder": dirname(F.col("path")), "name": note_name(F.col("path"))}
            )
            .select(*NOTES.fieldNames())
        )

    def new_folders(self) -> DataFrame:
        if self.folder_set is not None:
            return folders_from_paths(self.folder_set)
        made = _union([self.folders.select("path"), *self.made])
        return all_folders(self.notes, made)

    def all_rejects(self) -> DataFrame:
        reasons = _union(self.rejects)
        columns = CHANGES.fieldNames()
        if reasons is None:
            reasons = self.spark.createDataFrame([], "seq bigint, reason string")
        # Written, so that it is known how few they mostly are, and the bodies need not be exchanged to meet them.
        return self.changes.join(self.scratch.save(reasons), "seq").select(*columns, "reason")


def _union(frames: list[DataFrame]) -> DataFrame | None:
    return reduce(lambda a, b: a.unionByName(b), frames) if frames else None
