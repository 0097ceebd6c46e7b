"""Registered queries that apply change logs to the corpus, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.changes import apply_changes
from marginalia.operators.queue import coalesce_changes
from marginalia.plans import corpus
from marginalia.plans.corpus import START_MS, explicit_folders, notes_of, table
from marginalia.schema import CHANGES, notes_from_parts

Build = Callable[[SparkSession, str], DataFrame]


def change_log(df: DataFrame, **columns: Column | str) -> DataFrame:
    """A change table from the given columns; those left out are NULL."""
    values = {}
    for field in CHANGES.fields:
        value = columns.get(field.name)
        value = F.lit(value) if value is None or isinstance(value, str) else value
        values[field.name] = value.cast(field.dataType).alias(field.name)
    return df.select(*[values[name] for name in CHANGES.fieldNames()])


def shown(notes: DataFrame) -> DataFrame:
    """A snapshot in comparable form; bodies as digests."""
    return notes.select(
        "path",
        "folder",
        "name",
        "mod_time",
        "size",
        F.array_join("tags", "|").alias("tags"),
        F.md5("content").alias("digest"),
        F.md5("preview").alias("preview_digest"),
    )


def applied(log: Build, notes: Build = notes_of) -> Build:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = apply_changes(
            notes(spark, sf_dir), explicit_folders(spark, sf_dir), log(spark, sf_dir)
        )
        return shown(result[0])

    return run


def folders_after(log: Build, notes: Build = notes_of) -> Build:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return apply_changes(
            notes(spark, sf_dir), explicit_folders(spark, sf_dir), log(spark, sf_dir)
        )[1]

    return run


def rejects_of(log: Build, notes: Build = notes_of) -> Build:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rejects = apply_changes(
            notes(spark, sf_dir), explicit_folders(spark, sf_dir), log(spark, sf_dir)
        )[2]
        return rejects.select("seq", "kind", "path", "reason")

    return run


def sql_shown(source: str) -> str:
    """``shown`` over rows of (path, content, tags, mod_time)."""
    return f"""SELECT path, {corpus.sql_folder("path")} AS folder, {corpus.sql_name("path")} AS name,
  mod_time, {corpus.sql_size("tags", "content")} AS size, array_to_string(tags, '|') AS tags,
  md5(content) AS digest, md5({corpus.sql_preview("content")}) AS preview_digest FROM {source}"""


# ---- folder changes ----


def folder_log(kind: str, path: str, name: str | None = None, folder: str | None = None) -> Build:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return change_log(
            spark.range(1, 2),
            seq=F.col("id"),
            kind=kind,
            path=path,
            name=name,
            folder=folder,
            ts=F.lit(START_MS),
        )

    return build


def folder_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames, moves and deletes that build on each other, some of them impossible."""
    rows = [
        (1, "rename_folder", "src1", "renamed", None),
        (2, "rename_folder", "src2", "renamed", None),
        (3, "move_folder", "src3", None, "renamed/en"),
        (4, "move_folder", "renamed", None, "renamed/en/src3"),
        (5, "move_folder", "renamed", None, "archive"),
        (6, "delete_folder", "src5", None, None),
        (7, "rename_folder", "src5", "ghost", None),
        (8, "rename_folder", "src6", "src5", None),
        (9, "rename_folder", "archive/renamed/en/src3", "third", None),
    ]
    log = spark.createDataFrame(
        rows, "seq bigint, kind string, path string, name string, folder string"
    )
    columns = {c: F.col(c) for c in log.columns}
    return change_log(log, ts=F.lit(START_MS), **columns)


def _sql_moved(steps: list[tuple[str, str | None]]) -> str:
    """Paths of the documents through ordered prefix rewrites."""
    out = [f"WITH {corpus.DOCS}, r0 AS (SELECT path, content, tags, mod_time FROM docs)"]
    for i, (old, new) in enumerate(steps):
        here = f"starts_with(path, '{old}/')"
        if new is None:
            step = f"SELECT * FROM r{i} WHERE NOT {here}"
        else:
            renamed = f"'{new}' || substr(path, {len(old) + 1})"
            step = (
                f"SELECT CASE WHEN {here} THEN {renamed} ELSE path END AS path, "
                f"content, tags, mod_time FROM r{i}"
            )
        out.append(f"r{i + 1} AS ({step})")
    return ", ".join(out) + " " + sql_shown(f"r{len(steps)}")


def folders_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder created for the address of every page, and one that leaves the root."""
    pages = table(spark, sf_dir, "pages")
    return change_log(
        pages,
        seq=F.col("page_id") + 1,
        kind="create_folder",
        path=F.concat(
            F.when(F.col("page_id") % 50 == 7, "../").otherwise("pages/"),
            F.regexp_extract("url", "^https?://([^/]*)/", 1),
            F.lit("/"),
            F.regexp_extract("url", "^https?://[^/]*/([^/?#]*)", 1),
        ),
        ts=F.lit(START_MS),
    )


_SQL_PAGE_FOLDER = (
    "'pages/' || regexp_extract(url, '^https?://([^/]*)/', 1) || '/' || "
    "regexp_extract(url, '^https?://[^/]*/([^/?#]*)', 1)"
)
SQL_FOLDERS_CREATED = f"""WITH {corpus.NOTES}, named AS (
  SELECT folder AS path FROM notes
  UNION SELECT 'archive/quality_' || quality || '/toxic_' || toxic FROM labels
  UNION SELECT rtrim({_SQL_PAGE_FOLDER}, '/') FROM pages WHERE page_id % 50 <> 7),
folders AS (SELECT DISTINCT array_to_string(parts[1:n], '/') AS path, CAST(n - 1 AS INTEGER) AS depth
  FROM (SELECT string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')) + 1)) AS n
        FROM named WHERE path <> ''))
SELECT path, {corpus.sql_folder("path")} AS parent, {corpus.sql_base("path")} AS name, depth FROM folders"""


# ---- note changes ----


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with the path of the note they are about."""
    docs = table(spark, sf_dir, "documents").select("doc_id", corpus.doc_path().alias("path"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id")


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an update of a note, many per note; some bodies and notes are missing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", corpus.doc_path().alias("known"))
    events = table(spark, sf_dir, "events").withColumn("doc_id", F.col("user_id"))
    located = events.join(docs, "doc_id", "left")
    missing = F.concat(F.lit("lost/"), F.col("user_id").cast("string"), F.lit(".md"))
    body = F.concat("event_type", F.lit(" "), "props")
    return change_log(
        located,
        seq=F.col("event_id"),
        kind="update",
        path=F.when(F.col("event_id") % 10 == 3, missing).otherwise(F.coalesce("known", missing)),
        content=F.when(F.col("event_id") % 3 != 0, body),
        tags=F.array("event_type"),
        ts=corpus.epoch_ms(F.col("ts")),
    )


_SQL_UPDATES = f"""WITH {corpus.DOCS}, hits AS (
  SELECT e.event_id, d.path, epoch_us(e.ts) // 1000 AS ts, e.event_type,
         CASE WHEN event_id % 3 <> 0 THEN event_type || ' ' || props END AS body
  FROM events e JOIN docs d ON d.doc_id = e.user_id WHERE event_id % 10 <> 3),
last AS (SELECT path, arg_max(ts, event_id) AS ts, arg_max(event_type, event_id) AS event_type,
         arg_max(body, event_id) FILTER (body IS NOT NULL) AS body FROM hits GROUP BY path),
result AS (SELECT d.path, coalesce(l.body, d.content) AS content,
         CASE WHEN l.path IS NULL THEN d.tags ELSE [l.event_type] END AS tags,
         coalesce(l.ts, d.mod_time) AS mod_time
  FROM docs d LEFT JOIN last l ON l.path = d.path) """

_SQL_UPDATE_REJECTS = f"""WITH {corpus.DOCS}
SELECT event_id AS seq, 'update' AS kind, 'lost/' || user_id || '.md' AS path, 'not_found' AS reason
FROM events e LEFT JOIN docs d ON d.doc_id = e.user_id
WHERE event_id % 10 = 3 OR d.doc_id IS NULL"""


def renaming_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of all labelled notes; good ones get a new name, which is another note's for some."""
    doc, good = F.col("doc_id"), F.col("quality") == 1
    name = F.concat(F.when(doc % 6 == 0, "taken_").otherwise("new_"), doc.cast("string"))
    return change_log(
        labelled(spark, sf_dir),
        seq=doc,
        kind="update",
        path=F.col("path"),
        name=F.when(good, name),
        content=F.when(doc % 2 == 0, F.concat(F.lit("updated "), doc.cast("string"))),
        tags=F.array(F.lit("updated")),
        ts=F.lit(START_MS) + doc,
    )


def with_taken_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus, with the names that a sixth of the updates ask for already there."""
    docs = table(spark, sf_dir, "documents").filter("doc_id % 6 = 0")
    path = corpus.doc_path()
    name = F.concat(F.lit("taken_"), F.col("doc_id").cast("string"), F.lit(".md"))
    taken = docs.select(
        F.concat(F.left(path, F.length(path) - F.length(F.substring_index(path, "/", -1))), name).alias("path"),
        F.lit("taken").alias("content"),
        F.array().cast("array<string>").alias("tags"),
        F.lit(START_MS).alias("mod_time"),
    )
    return notes_of(spark, sf_dir).unionByName(notes_from_parts(taken))


_SQL_INTO = f"CASE WHEN contains(path, '/') THEN {corpus.sql_folder('path')} || '/' ELSE '' END"
_SQL_RENAMING = f"""WITH {corpus.DOCS}, asked AS (
  SELECT d.*, l.quality, l.doc_id IS NOT NULL AND NOT (quality = 1 AND d.doc_id % 6 = 0) AS done
  FROM docs d LEFT JOIN labels l ON l.doc_id = d.doc_id),
result AS (SELECT CASE WHEN done AND quality = 1 THEN {_SQL_INTO} || 'new_' || doc_id || '.md' ELSE path END AS path,
    CASE WHEN done AND doc_id % 2 = 0 THEN 'updated ' || doc_id ELSE content END AS content,
    CASE WHEN done THEN ['updated'] ELSE tags END AS tags,
    CASE WHEN done THEN {START_MS} + doc_id ELSE mod_time END AS mod_time FROM asked
  UNION ALL SELECT {_SQL_INTO} || 'taken_' || doc_id || '.md', 'taken', CAST([] AS VARCHAR[]), {START_MS}
    FROM docs WHERE doc_id % 6 = 0) """


def creates(spark: SparkSession, sf_dir: str, kind: str = "create") -> DataFrame:
    """A note per conversation turn, named by role, so most names are taken; some have none."""
    turn = F.col("turn")
    return change_log(
        table(spark, sf_dir, "conversations"),
        seq=F.col("conv_id") * 1_000_000 + turn,
        kind=kind,
        name=F.when(turn % 5 != 4, F.concat(F.lit("by: "), F.col("role"))),
        folder=F.concat(F.lit("chat/"), F.col("conv_id").cast("string")),
        content=F.col("text"),
        tags=F.array("role"),
        ts=F.lit(START_MS) + F.col("conv_id") * 1000,
    )


def pathless_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same notes by saves that name no path yet."""
    return creates(spark, sf_dir, "save")


_SQL_STAMP = f"strftime(make_timestamp(({START_MS} + conv_id * 1000) * 1000), '%Y-%m-%d_%H%M%S')"
_SQL_CREATES = f"""WITH {corpus.DOCS}, asked AS (
  SELECT *, {_SQL_STAMP} AS stamp,
    CASE WHEN turn % 5 = 4 THEN {_SQL_STAMP} ELSE 'by_ ' || role END AS base FROM conversations),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id, base ORDER BY turn) AS r FROM asked),
made AS (SELECT 'chat/' || conv_id || '/' || CASE WHEN r = 1 THEN '' WHEN r = 2 THEN stamp || '_'
    ELSE stamp || '-' || (r - 1) || '_' END || base || '.md' AS path,
  text AS content, [role] AS tags, {START_MS} + conv_id * 1000 AS mod_time FROM ranked),
result AS (SELECT path, content, tags, mod_time FROM docs UNION ALL SELECT * FROM made) """


def deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic notes deleted, and the others asked for under a path that does not exist."""
    gone = F.col("toxic") == 1
    return change_log(
        labelled(spark, sf_dir),
        seq=F.col("doc_id"),
        kind="delete",
        path=F.when(gone, F.col("path")).otherwise(F.concat(F.lit("gone/"), F.col("path"))),
        ts=F.lit(START_MS),
    )


_SQL_DELETES = f"""WITH {corpus.DOCS}, result AS (
  SELECT * FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) """
_SQL_DELETE_REJECTS = f"""WITH {corpus.DOCS} SELECT d.doc_id AS seq, 'delete' AS kind,
  'gone/' || path AS path, 'not_found' AS reason FROM docs d JOIN labels l ON l.doc_id = d.doc_id
WHERE toxic <> 1"""


def with_occupied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus, with some names already taken in the folder ``good``."""
    docs = table(spark, sf_dir, "documents").filter("doc_id % 6 = 0")
    taken = docs.select(
        F.concat(F.lit("good/"), F.substring_index(corpus.doc_path(), "/", -1)).alias("path"),
        F.lit("taken").alias("content"),
        F.array().cast("array<string>").alias("tags"),
        F.lit(START_MS).alias("mod_time"),
    )
    return notes_of(spark, sf_dir).unionByName(notes_from_parts(taken))


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good notes moved to one folder, where some names are taken; the others stay where they are."""
    good = F.col("quality") == 1
    return change_log(
        labelled(spark, sf_dir),
        seq=F.col("doc_id"),
        kind="move",
        path=F.col("path"),
        folder=F.when(good, "good").otherwise(
            F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
        ),
        ts=F.lit(START_MS),
    )


_SQL_OCCUPIED = f"""{corpus.DOCS}, before AS (
  SELECT path, content, tags, mod_time, doc_id FROM docs UNION ALL
  SELECT 'good/' || {corpus.sql_base("path")}, 'taken', CAST([] AS VARCHAR[]), {START_MS}, NULL
  FROM docs WHERE doc_id % 6 = 0)"""
_SQL_MOVES = f"""WITH {_SQL_OCCUPIED}, result AS (
  SELECT CASE WHEN doc_id % 6 <> 0 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
    THEN 'good/' || {corpus.sql_base("path")} ELSE path END AS path, content, tags, mod_time
  FROM before) """
_SQL_MOVE_REJECTS = f"""WITH {corpus.DOCS} SELECT d.doc_id AS seq, 'move' AS kind, path, 'exists' AS reason
FROM docs d JOIN labels l ON l.doc_id = d.doc_id WHERE quality = 1 AND d.doc_id % 6 = 0"""


def with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus, with the second copy of every third note already there."""
    docs = table(spark, sf_dir, "documents").filter("doc_id % 3 = 0")
    copies = docs.select(
        F.regexp_replace(corpus.doc_path(), "[.]md$", " (copy 2).md").alias("path"),
        F.lit("copy").alias("content"),
        F.array().cast("array<string>").alias("tags"),
        F.lit(START_MS).alias("mod_time"),
    )
    return notes_of(spark, sf_dir).unionByName(notes_from_parts(copies))


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled notes duplicated once to three times."""
    times = F.col("quality") + F.col("toxic") + 1
    asked = labelled(spark, sf_dir).withColumn(
        "turn", F.explode(F.sequence(F.lit(1), times.cast("int")))
    )
    return change_log(
        asked,
        seq=F.col("doc_id") * 3 + F.col("turn"),
        kind="duplicate",
        path=F.col("path"),
        ts=F.lit(START_MS) + F.col("turn"),
    )


_SQL_DUPLICATES = f"""WITH {corpus.DOCS}, asked AS (
  SELECT l.doc_id, unnest(range(1, CAST(quality + toxic + 2 AS BIGINT))) AS turn FROM labels l),
numbered AS (SELECT *, CASE WHEN doc_id % 3 = 0 AND turn >= 2 THEN turn + 1 ELSE turn END AS n FROM asked),
result AS (SELECT path, content, tags, mod_time FROM docs
  UNION ALL SELECT regexp_replace(path, '[.]md$', ' (copy 2).md'), 'copy', CAST([] AS VARCHAR[]), {START_MS}
    FROM docs WHERE doc_id % 3 = 0
  UNION ALL SELECT regexp_replace(path, '[.]md$', '') || CASE WHEN n = 1 THEN ' (copy).md' ELSE ' (copy ' || n || ').md' END,
    content, tags, {START_MS} + turn FROM numbered JOIN docs USING (doc_id)) """


def saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queued saves: renamed when good, always moved, bodies replaced; the last entry per note counts."""
    rows = labelled(spark, sf_dir).withColumn("turn", F.explode(F.array(F.lit(2), F.lit(1))))
    doc = F.col("doc_id").cast("string")
    log = change_log(
        rows,
        seq=F.col("doc_id") * 2 + F.col("turn"),
        key=F.col("path"),
        kind="save",
        path=F.col("path"),
        name=F.when(F.col("quality") == 1, F.concat(F.lit("kept_"), doc)).otherwise(""),
        folder=F.concat(F.lit("kept/"), F.col("toxic").cast("string")),
        content=F.concat(F.lit("saved "), F.col("turn").cast("string"), F.lit(" for "), doc),
        tags=F.array(F.lit("kept")),
        ts=F.lit(START_MS) + F.col("turn"),
    )
    return coalesce_changes(log)


_SQL_SAVES = f"""WITH {corpus.DOCS}, result AS (
  SELECT CASE WHEN l.doc_id IS NULL THEN path ELSE 'kept/' || toxic || '/' ||
      CASE WHEN quality = 1 THEN 'kept_' || d.doc_id || '.md' ELSE {corpus.sql_base("path")} END END AS path,
    CASE WHEN l.doc_id IS NULL THEN content ELSE 'saved 2 for ' || d.doc_id END AS content,
    CASE WHEN l.doc_id IS NULL THEN tags ELSE ['kept'] END AS tags,
    CASE WHEN l.doc_id IS NULL THEN mod_time ELSE {START_MS} + 2 END AS mod_time
  FROM docs d LEFT JOIN labels l ON l.doc_id = d.doc_id) """

QUERIES = {
    "rename_folder": applied(folder_log("rename_folder", "src1", name="renamed")),
    "move_folder": applied(folder_log("move_folder", "src2", folder="src3/inner")),
    "delete_folder": applied(folder_log("delete_folder", "src4")),
    "folder_changes": applied(folder_changes),
    "folder_change_rejects": rejects_of(folder_changes),
    "create_folders": folders_after(folders_from_pages),
    "apply_updates": applied(updates),
    "update_rejects": rejects_of(updates),
    "update_renames": applied(renaming_updates, with_taken_names),
    "update_rename_rejects": rejects_of(renaming_updates, with_taken_names),
    "create_notes": applied(creates),
    "save_new_notes": applied(pathless_saves),
    "delete_notes": applied(deletes),
    "delete_rejects": rejects_of(deletes),
    "move_notes": applied(moves, with_occupied),
    "move_rejects": rejects_of(moves, with_occupied),
    "duplicate_notes": applied(duplicates, with_copies),
    "save_notes": applied(saves),
}

ORACLES = {
    "rename_folder": _sql_moved([("src1", "renamed")]),
    "move_folder": _sql_moved([("src2", "src3/inner/src2")]),
    "delete_folder": _sql_moved([("src4", None)]),
    "folder_changes": _sql_moved(
        [
            ("src1", "renamed"),
            ("src3", "renamed/en/src3"),
            ("renamed", "archive/renamed"),
            ("src5", None),
            ("src6", "src5"),
            ("archive/renamed/en/src3", "archive/renamed/en/third"),
        ]
    ),
    "folder_change_rejects": """SELECT * FROM (VALUES
  (CAST(2 AS BIGINT), 'rename_folder', 'src2', 'exists'),
  (4, 'move_folder', 'renamed', 'into_itself'),
  (7, 'rename_folder', 'src5', 'not_found')) AS t(seq, kind, path, reason)
WHERE EXISTS (SELECT 1 FROM documents)""",
    "create_folders": SQL_FOLDERS_CREATED,
    "apply_updates": _SQL_UPDATES + sql_shown("result"),
    "update_rejects": _SQL_UPDATE_REJECTS,
    "update_renames": _SQL_RENAMING + sql_shown("result"),
    "update_rename_rejects": f"""WITH {corpus.DOCS} SELECT d.doc_id AS seq, 'update' AS kind, path, 'exists' AS reason
FROM docs d JOIN labels l ON l.doc_id = d.doc_id WHERE quality = 1 AND d.doc_id % 6 = 0""",
    "create_notes": _SQL_CREATES + sql_shown("result"),
    "save_new_notes": _SQL_CREATES + sql_shown("result"),
    "delete_notes": _SQL_DELETES + sql_shown("result"),
    "delete_rejects": _SQL_DELETE_REJECTS,
    "move_notes": _SQL_MOVES + sql_shown("result"),
    "move_rejects": _SQL_MOVE_REJECTS,
    "duplicate_notes": _SQL_DUPLICATES + sql_shown("result"),
    "save_notes": _SQL_SAVES + sql_shown("result"),
}
