"""Folding chains of changes to one note, however long, into one change each.

A note that is renamed, written, moved and deleted one after the other leads along paths. Where those paths
belong to nobody else, each step's outcome is known beforehand, so the whole way is one step from the first path to
the last, with the last tags and the last body. The steps of a way are found by pointer doubling, in a
number of joins that follows the logarithm of its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.names import family
from marginalia.functions.paths import dirname
from marginalia.scratch import Scratch

#: Changes that leave a path, and those whose families may meet in ways that are decided change by change.
MOVING = ("rewrite", "move", "delete")
NUMBERED = ("create", "duplicate")


def fold_chains(
    scratch: Scratch, pending: DataFrame, state: DataFrame, actions: set[str]
) -> tuple[DataFrame, DataFrame | None]:
    """``(pending, made)``: pending changes with every clear chain folded, and the folders that its steps made.

    A chain is clear when it begins at a path that is there, goes only over paths that are not, and no
    other change moves to, from or over any of them, so that none of its changes can be rejected. Writes
    on the way belong to it. Chains that share a family with a create or a duplicate are left as they are.
    """
    if not actions & {"rewrite", "move"}:
        return pending, None
    moving = pending.filter(F.col("action").isin(*MOVING))
    going = moving.filter("action != 'delete'")
    steps = pending.filter(F.col("action").isin("write", *MOVING)).select("seq", "path")
    following = going.select(F.col("target").alias("path"), F.col("seq").alias("before")).join(steps, "path")
    if following.filter("seq > before").isEmpty():
        return pending, None
    busy = pending.filter(F.col("action").isin(*NUMBERED))
    busy = scratch.save(busy.select(F.explode(F.array("family", "target_family")).alias("family")).distinct())

    kind = _path_kinds(pending, moving, going, state, busy)
    kind = scratch.save(kind.filter("kind IS NOT NULL"))
    into = kind.select(F.col("path"), F.col("kind").alias("from_kind"), F.col("out_seq").alias("before"))
    onto = kind.select(F.col("path").alias("target"), F.col("kind").alias("to_kind"))
    ends = F.coalesce(F.col("to_kind").isin("link", "tail"), F.lit(False))
    nodes = moving.join(into, "path", "left").join(onto, "target", "left").select(
        "seq",
        "before",
        F.coalesce(F.col("from_kind") == "head", F.lit(False)).alias("head"),
        (F.col("from_kind").isNotNull() & ((F.col("action") == "delete") | ends)).alias("clear"),
    )
    roots = _roots(scratch, scratch.save(nodes))
    # The way up to the first step that is not clear; that one waits for what comes before.
    ways = roots.groupBy("root").agg(F.min(F.when(~F.col("clear"), F.col("seq"))).alias("stop"), F.max("head").alias("head"))
    way = roots.select("seq", "root").join(ways.filter("head"), "root").filter("stop IS NULL OR seq < stop")
    members = scratch.save(way.select("seq", "root"))

    # Writes belong to the step that left the note where they find it, or to the one that takes it away.
    writes = pending.filter("action = 'write'").join(kind, "path").select("seq", F.coalesce("out_seq", "in_seq").alias("step"))
    writes = writes.join(members.select(F.col("seq").alias("step"), "root"), "step").select("seq", "root")
    absorbed = scratch.save(members.unionByName(writes))
    parts = pending.join(absorbed, "seq")
    writing = F.col("action").isin("write", "rewrite")
    leaving = F.col("action").isin(*MOVING)
    folded = parts.groupBy("root").agg(
        F.max(F.when(leaving, F.col("seq"))).alias("seq"),
        F.max_by("action", F.when(leaving, F.col("seq"))).alias("last"),
        F.min_by("path", F.when(leaving, F.col("seq"))).alias("path"),
        F.max_by("target", F.when(leaving, F.col("seq"))).alias("target"),
        F.max_by(F.struct("tags", "ts"), F.when(writing, F.col("seq"))).alias("written"),
        F.max(F.when(writing, F.col("body_seq"))).alias("body_seq"),
        F.max(writing).alias("wrote"),
    )
    action = F.when(F.col("last") == "delete", "delete").when(F.col("wrote"), "rewrite").otherwise("move")
    target = F.when(F.col("last") != "delete", F.col("target"))
    whole = folded.withColumns(
        {
            "action": action,
            "target": target,
            "tags": F.col("written.tags"),
            "ts": F.col("written.ts"),
            "has_content": F.col("body_seq").isNotNull(),
            "present": F.lit(True),
            "stamp": F.lit(None).cast("string"),
            "family": family(F.col("path")),
            "target_family": family(F.coalesce(target, F.col("path"))),
        }
    )
    made = parts.filter("action IN ('rewrite', 'move')").select(dirname(F.col("target")).alias("path")).distinct()
    rest = pending.join(absorbed.select("seq"), "seq", "left_anti")
    return scratch.save(rest.unionByName(whole.select(*pending.columns))), scratch.save(made)


def _path_kinds(pending: DataFrame, moving: DataFrame, going: DataFrame, state: DataFrame, busy: DataFrame) -> DataFrame:
    """``(path, kind, in_seq, out_seq)``: what a path can be in a clear chain, from sums over its changes.

    A head is there and is left once, a tail is not there and is reached once, and a link is not there, reached
    and then left; writes come only while the note is there. NULL is any other path.
    """
    seq = F.col("seq")
    nothing = F.lit(None).cast("bigint")

    def touch(rows: DataFrame, path: str, fam: str, column: str) -> DataFrame:
        columns = {c: (seq if c == column else nothing) for c in ("in_seq", "out_seq", "write_seq")}
        return rows.select(F.col(path).alias("path"), F.col(fam).alias("family"), *[v.alias(c) for c, v in columns.items()])

    writes = pending.filter("action = 'write'")
    touches = touch(moving, "path", "family", "in_seq").unionByName(touch(writes, "path", "family", "write_seq"))
    touches = touches.unionByName(touch(going, "target", "target_family", "out_seq"))
    paths = touches.groupBy("path", "family").agg(
        F.count("in_seq").alias("n_in"),
        F.count("out_seq").alias("n_out"),
        F.min("in_seq").alias("in_seq"),
        F.min("out_seq").alias("out_seq"),
        F.min("write_seq").alias("first_write"),
        F.max("write_seq").alias("last_write"),
    )
    alive = state.filter("path IS NOT NULL").select("path", F.lit(True).alias("there"))
    paths = paths.join(busy, "family", "left_anti").join(alive, "path", "left")
    there = F.col("there").isNotNull()
    after = F.col("first_write").isNull() | (F.col("first_write") > F.col("out_seq"))
    before = F.col("last_write").isNull() | (F.col("last_write") < F.col("in_seq"))
    once_in, once_out = F.col("n_in") == 1, F.col("n_out") == 1
    kind = (
        F.when(there & once_in & (F.col("n_out") == 0) & before, "head")
        .when(~there & once_out & (F.col("n_in") == 0) & after, "tail")
        .when(~there & once_out & once_in & (F.col("out_seq") < F.col("in_seq")) & after & before, "link")
    )
    return paths.select("path", kind.alias("kind"), "in_seq", "out_seq")


def _roots(scratch: Scratch, nodes: DataFrame) -> DataFrame:
    """``nodes`` (seq, before, head, clear) with the ``root`` their ``before`` leads back to."""
    hops = nodes.select("seq", F.coalesce("before", "seq").alias("root"))
    hops = scratch.save(hops)
    while True:
        further = hops.select(F.col("seq").alias("root"), F.col("root").alias("further"))
        hops = scratch.save(
            hops.join(further, "root").select("seq", F.col("further").alias("root"), (F.col("further") != F.col("root")).alias("moved"))
        )
        if hops.filter("moved").isEmpty():
            return nodes.join(hops.select("seq", "root"), "seq")
        hops = hops.drop("moved")
