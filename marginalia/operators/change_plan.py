"""Note changes in a narrow form: what each one touches and where it leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.names import (
    family,
    name_or_timestamp,
    sanitize_name,
    stamped_parts,
    timestamp_name,
    with_md,
)
from marginalia.functions.paths import basename, dirname, join_path, normalize_path, note_name
from marginalia.operators.folder_ops import CREATE_KIND


def plan_changes(changes: DataFrame) -> DataFrame:
    """One narrow row per note change; bodies stay behind in the log.

    ``action`` is create, write (in place), rewrite (a write that also changes the
    path), delete, move, duplicate or create_folder. ``target`` is where a write
    or a move leaves the note, or where a create wants it; ``body_seq`` is the change that has the body. A ``save`` without a
    path is a create; with one it is a write that also renames when it has a name
    and moves when it has a folder, all or nothing.
    """
    kind, name, ts = F.col("kind"), F.col("name"), F.col("ts")
    path = normalize_path(F.col("path"))
    folder = normalize_path(F.coalesce("folder", F.lit("")))
    pathless = F.coalesce("path", F.lit("")) == ""
    creates = (kind == "create") | ((kind == "save") & pathless)
    renames = F.when(kind == "update", name.isNotNull()).otherwise(
        F.coalesce(name, F.lit("")) != ""
    )
    new_base = F.when(renames, with_md(name_or_timestamp(name, ts))).otherwise(basename(path))
    moved_to = F.when((kind == "save") & F.col("folder").isNotNull(), folder).otherwise(
        dirname(path)
    )
    safe = sanitize_name(F.coalesce("name", F.lit("")))
    created = F.when(safe == "", timestamp_name(ts)).otherwise(safe)
    action = (
        F.when(creates, "create")
        .when(kind.isin("update", "save"), "write")
        .when(kind.isin("delete", "move", "duplicate", CREATE_KIND), kind)
        .otherwise("unknown")
    )
    target = (
        F.when(action == "create", join_path(folder, with_md(created)))
        .when(action == "write", join_path(moved_to, new_base))
        .when(action == "move", join_path(folder, basename(path)))
    )
    illegal = (
        F.when(action == "unknown", True)
        .when(action == "create", folder.isNull())
        .when(path.isNull() | (path == ""), True)
        .when((action == "write") & renames, F.contains(name, F.lit("/")))
        .otherwise(False)
    ) | (action.isin("write", "move") & folder.isNull())
    step = F.when((action == "write") & (target != path), "rewrite").otherwise(action)
    return changes.select(
        "seq",
        step.alias("action"),
        F.when(action != "create", path).alias("path"),
        target.alias("target"),
        timestamp_name(ts).alias("stamp"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.col("content").isNotNull().alias("has_content"),
        F.when(F.col("content").isNotNull(), F.col("seq")).alias("body_seq"),
        "ts",
        F.when(illegal, "illegal_path").alias("reason"),
    ).withColumns(
        {
            "family": family(F.coalesce("path", "target")),
            "target_family": family(F.coalesce("target", "path")),
        }
    )


def touches(pending: DataFrame, actions: set[str]) -> DataFrame:
    """``(seq, resource, label)``: what each pending change depends on.

    ``actions`` are those that occur, so that no others are looked for.

    Changes with the same label on a resource can be applied together; a change
    with another label has to wait for the earlier ones. ``pending`` says in
    ``present`` whether the note a change is about exists at this point.

    Resources are a path, a family of derived names, and the collision names of
    a created note.
    """
    action = F.col("action")
    path, target = F.col("path"), F.col("target")
    alone = F.concat(F.lit("only:"), F.col("seq").cast("string"))
    stamped = stamped_parts(note_name(target))
    child_of = join_path(dirname(target), F.concat(stamped["base"], F.lit(".md")))
    always = F.lit(True)

    def touch(kind: str, resource: Column, label: Column | str, condition: Column = always) -> Column:
        label = F.lit(label) if isinstance(label, str) else label
        name = F.concat(F.lit(kind + "|"), resource)
        return F.when(condition, F.struct(name.alias("resource"), label.alias("label")))

    relocation = [
        touch("path", path, alone),
        touch("path", target, alone),
        touch("family", F.col("family"), "static"),
        touch("family", F.col("target_family"), "static"),
    ]
    touched = {
        "write": [
            touch("path", path, "write"),
            touch("family", F.col("family"), "static", ~F.col("present")),
        ],
        "rewrite": relocation,
        "move": relocation,
        "delete": [touch("path", path, "delete"), touch("family", F.col("family"), "static")],
        "create": [
            touch("family", F.col("family"), "create"),
            touch("stamps", target, "own"),
            touch("stamps", child_of, "child", stamped["n"].isNotNull()),
        ],
        "duplicate": [
            touch("family", F.col("family"), "duplicate"),
            touch("path", path, "copy"),
        ],
    }
    entries = F.lit(None)
    for name in sorted(actions):
        entries = F.when(action == name, F.array_compact(F.array(*touched[name]))).otherwise(entries)
    return pending.select("seq", F.explode(F.array_distinct(entries)).alias("touch")).select(
        "seq", "touch.resource", "touch.label"
    )
