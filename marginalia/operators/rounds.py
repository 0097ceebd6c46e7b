"""Applying note changes to the notes they touch, as many at a time as order allows."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.names import copy_name, copy_parts, stamped_name, stamped_parts
from marginalia.functions.paths import dirname, join_path, note_name
from marginalia.operators.allocate import Blocks, free_numbers, order_blocks, ordinal_within
from marginalia.operators.chains import fold_chains
from marginalia.operators.change_plan import touches
from marginalia.scratch import Scratch

# A touched note. ``path`` is NULL once it is gone. ``own_path`` is the snapshot
# row it stands for (NULL when it was made by a change); its body is that of the
# snapshot row ``body_path``, or of the change ``body_seq`` when that is set.
STATE_COLUMNS = ("path", "own_path", "body_path", "body_seq", "tags", "mod_time", "dirty")


@dataclass
class Outcome:
    state: DataFrame
    rejects: list[DataFrame] = field(default_factory=list)  # (seq, reason)
    made: list[DataFrame] = field(default_factory=list)  # (path) of folders


def apply_plan(scratch: Scratch, plan: DataFrame, state: DataFrame) -> Outcome:
    """Apply planned changes in the order of their ``seq``.

    Each round takes every change that no earlier unfinished one stands in the
    way of. Changes to unrelated notes, repeated writes to one note, creates of
    one name and copies of one note all go in one round, and chains of changes to one note
    are folded into one (``fold_chains``), so the number of rounds follows the longest chain of changes
    that really decide about each other.
    """
    out = Outcome(state)
    illegal = plan.filter("reason IS NOT NULL").select("seq", "reason")
    out.rejects.append(illegal)
    pending = plan.filter("reason IS NULL").drop("reason")
    width = order_blocks(plan, "seq")
    while True:
        alive = out.state.filter("path IS NOT NULL").select("path").withColumn("present", F.lit(True))
        pending = scratch.save(
            pending.drop("present")
            .join(alive, "path", "left")
            .withColumn("present", F.coalesce("present", F.lit(False)))
        )
        actions = {row.action for row in pending.select("action").distinct().collect()}
        if not actions:
            return out
        pending, made = fold_chains(scratch, pending, out.state, actions)
        if made is not None:
            out.made.append(made)
            actions = {row.action for row in pending.select("action").distinct().collect()}
        ready, blocked = _split(scratch, pending, actions)
        deferred = _round(scratch, ready, actions, out, width)
        waiting = [df for df in (blocked, deferred) if df is not None]
        if not waiting:
            return out
        pending = waiting[0] if len(waiting) == 1 else waiting[0].unionByName(waiting[1])


# Any number of changes of one of these kinds alone can be applied together.
BULK_ACTIONS = ("write", "delete", "duplicate")


def _split(
    scratch: Scratch, pending: DataFrame, actions: set[str]
) -> tuple[DataFrame, DataFrame | None]:
    """The changes that can be applied now, and the others (None when there are none)."""
    if len(actions) == 1 and actions <= set(BULK_ACTIONS):
        return pending, None
    touched = touches(pending, actions)
    mixed = touched.groupBy("resource").agg(
        F.min("label").alias("one"), F.max("label").alias("other")
    )
    if mixed.filter("one != other").isEmpty():
        return pending, None
    heads = touched.groupBy("resource").agg(F.min_by("label", "seq").alias("head"))
    stops = (
        touched.join(heads, "resource")
        .filter("label != head")
        .groupBy("resource")
        .agg(F.min("seq").alias("stop"))
    )
    held = scratch.save(
        touched.join(stops, "resource").filter("seq >= stop").select("seq").distinct()
    )
    return (
        pending.join(held, "seq", "left_anti"),
        pending.join(held, "seq", "left_semi"),
    )


def _round(
    scratch: Scratch, ready: DataFrame, actions: set[str], out: Outcome, width: Blocks
) -> DataFrame | None:
    """Apply mutually independent changes to ``out``; returns those to try again."""
    state, deferred = out.state, None
    added = []
    if actions & {"write", "rewrite", "move", "delete"}:
        effects, rejects = _static_effects(ready, state, actions)
        out.rejects.append(rejects)
        effects = scratch.save(effects)
        if actions & {"rewrite", "move"}:
            made = effects.filter("made").select(dirname(F.col("new_path")).alias("path"))
            out.made.append(made)
        state = _apply_effects(state, effects)
    if "create" in actions:
        created = scratch.save(_created(ready.filter("action = 'create'"), out.state, width))
        out.made.append(created.select(dirname(F.col("path")).alias("path")))
        added.append(created)
    if "duplicate" in actions:
        copies, rejects, deferred = _duplicates(
            scratch, ready.filter("action = 'duplicate'"), out.state, width
        )
        out.rejects.append(rejects)
        added.append(copies)
    for rows in added:
        state = state.unionByName(rows.select(*STATE_COLUMNS))
    out.state = scratch.save(state)
    return deferred


def _static_effects(
    ready: DataFrame, state: DataFrame, actions: set[str]
) -> tuple[DataFrame, DataFrame]:
    """One effect per touched path, and the changes that had none."""
    static = ready.filter(F.col("action").isin("write", "rewrite", "move", "delete"))
    missing = static.filter("NOT present").select("seq", F.lit("not_found").alias("reason"))
    found = static.filter("present")
    effects, rejects = [], [missing]
    if "write" in actions:
        effects.append(_writes(found.filter("action = 'write'")))
    if "delete" in actions:
        deletes = found.filter("action = 'delete'")
        firsts = deletes.groupBy("path").agg(F.min("seq").alias("seq"))
        again = deletes.join(firsts, ["path", "seq"], "left_anti")
        effects.append(firsts.select("path", *_effect()))
        rejects.append(again.select("seq", F.lit("not_found").alias("reason")))
    if actions & {"rewrite", "move"}:
        relocating = found.filter(F.col("action").isin("rewrite", "move"))
        taken = state.filter("path IS NOT NULL").select(F.col("path").alias("target"))
        clash = (
            relocating.filter("path != target")
            .join(taken, "target", "left_semi")
            .select("seq", F.lit("exists").alias("reason"))
        )
        writing = F.col("action") == "rewrite"
        relocated = relocating.join(clash, "seq", "left_anti").select(
            "path",
            *_effect(
                new_path=F.col("target"),
                content_seq=F.when(writing, F.col("body_seq")),
                tags=F.when(writing, F.col("tags")),
                mod_time=F.when(writing, F.col("ts")),
                made=F.col("path") != F.col("target"),
            ),
        )
        effects.append(relocated)
        rejects.append(clash)
    return reduce(DataFrame.unionByName, effects), reduce(DataFrame.unionByName, rejects)


def _effect(new_path=None, content_seq=None, tags=None, mod_time=None, made=None) -> list[Column]:
    """The columns of an effect; a note without a new path is gone."""
    return [
        F.lit(new_path).cast("string").alias("new_path"),
        F.lit(content_seq).cast("bigint").alias("content_seq"),
        F.lit(tags).cast("array<string>").alias("tags"),
        F.lit(mod_time).cast("bigint").alias("mod_time"),
        F.coalesce(F.lit(made).cast("boolean"), F.lit(False)).alias("made"),
    ]


def _writes(writes: DataFrame) -> DataFrame:
    """Writes in place, folded per note: the last tags, and the last body that was given."""
    folded = writes.groupBy("path").agg(
        F.max("body_seq").alias("content_seq"),
        F.max_by(F.struct("tags", "ts"), "seq").alias("last"),
    )
    return folded.select(
        "path",
        *_effect(
            new_path=F.col("path"),
            content_seq=F.col("content_seq"),
            tags=F.col("last.tags"),
            mod_time=F.col("last.ts"),
        ),
    )


def _apply_effects(state: DataFrame, effects: DataFrame) -> DataFrame:
    change = effects.select(
        "path",
        "new_path",
        "content_seq",
        F.col("tags").alias("new_tags"),
        F.col("mod_time").alias("new_time"),
        F.lit(True).alias("hit"),
    )
    hit = F.col("hit").isNotNull()
    return state.join(change, "path", "left").select(
        F.when(hit, F.col("new_path")).otherwise(F.col("path")).alias("path"),
        "own_path",
        "body_path",
        F.coalesce("content_seq", "body_seq").alias("body_seq"),
        F.coalesce("new_tags", "tags").alias("tags"),
        F.coalesce("new_time", "mod_time").alias("mod_time"),
        (F.col("dirty") | F.col("new_tags").isNotNull()).alias("dirty"),
    )


def _created(creates: DataFrame, state: DataFrame, width: Blocks) -> DataFrame:
    """New notes: the first create of a free path gets it, the others a stamped name."""
    named = creates.withColumns(
        {
            "into": dirname(F.col("target")),
            "base": note_name(F.col("target")),
        }
    ).withColumn("bare", F.col("target"))
    ranked = ordinal_within(named, ["bare"], "seq", "rank", width)
    taken = state.filter("path IS NOT NULL").select(
        F.col("path").alias("bare"), F.lit(True).alias("taken")
    )
    ranked = ranked.join(taken, "bare", "left")
    direct = F.col("taken").isNull() & (F.col("rank") == 1)
    firsts = ranked.filter(direct).select("seq", F.col("target").alias("path"), "tags", "ts", "has_content")

    keys = ["into", "base", "stamp"]
    rest = ordinal_within(
        ranked.filter(~direct).select("seq", *keys, "tags", "ts", "has_content"),
        keys,
        "seq",
        "ordinal",
        width,
    )
    parts = stamped_parts(note_name(F.col("path")))
    used = (
        state.filter("path IS NOT NULL")
        .select(dirname(F.col("path")).alias("into"), parts.alias("parts"))
        .filter("parts.n IS NOT NULL")
        .select("into", "parts.base", "parts.stamp", "parts.n")
    )
    name = stamped_name(F.col("base"), F.col("stamp"), F.col("n"))
    others = free_numbers(rest, used, keys).select(
        "seq",
        join_path(F.col("into"), F.concat(name, F.lit(".md"))).alias("path"),
        "tags",
        "ts",
        "has_content",
    )
    return firsts.unionByName(others).select(
        "path",
        F.lit(None).cast("string").alias("own_path"),
        F.lit(None).cast("string").alias("body_path"),
        F.when(F.col("has_content"), F.col("seq")).alias("body_seq"),
        "tags",
        F.col("ts").alias("mod_time"),
        F.lit(True).alias("dirty"),
    )


def _duplicates(
    scratch: Scratch, duplicates: DataFrame, state: DataFrame, width: Blocks
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Copies under the smallest free copy numbers, rejects, and copies of copies to come."""
    missing = duplicates.filter("NOT present")
    soonest = (
        duplicates.filter("present").groupBy("family").agg(F.min("seq").alias("soonest"))
    )
    # A missing original may be a copy that an earlier duplicate of this round makes.
    unclear = scratch.save(missing.join(soonest, "family", "left"))
    later = F.coalesce(F.col("soonest") < F.col("seq"), F.lit(False))
    rejects = unclear.filter(~later).select("seq", F.lit("not_found").alias("reason"))
    deferred = unclear.filter(later).drop("soonest")

    keys = ["into", "base"]
    requests = ordinal_within(
        duplicates.filter("present")
        .select("seq", "path", "ts")
        .withColumns({"into": dirname(F.col("path")), "base": note_name(F.col("path"))}),
        keys,
        "seq",
        "ordinal",
        width,
    )
    used = (
        state.filter("path IS NOT NULL")
        .select(
            dirname(F.col("path")).alias("into"),
            copy_parts(note_name(F.col("path"))).alias("parts"),
        )
        .filter("parts.n IS NOT NULL")
        .select("into", "parts.base", "parts.n")
    )
    name = F.concat(copy_name(F.col("base"), F.col("n")), F.lit(".md"))
    placed = free_numbers(requests, used, keys).select(
        "path", "ts", join_path(F.col("into"), name).alias("new_path")
    )
    originals = state.filter("path IS NOT NULL").select(
        "path", "body_path", "body_seq", "tags", "dirty"
    )
    copies = scratch.save(
        placed.join(originals, "path").select(
            F.col("new_path").alias("path"),
            F.lit(None).cast("string").alias("own_path"),
            "body_path",
            "body_seq",
            "tags",
            F.col("ts").alias("mod_time"),
            "dirty",
        )
    )
    return copies, rejects, None if deferred.isEmpty() else deferred
