"""Registered queries that write files and stores and read them back, and that show the order of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.operators import listing, tree
from marginalia.operators import live_sessions as _live_sessions
from marginalia.plans import corpus
from marginalia.plans.corpus import START_MS, event_queue, flat_tags, notes_of, table
from marginalia.plans.flowing import NOW_MS, SQL_EXPIRY, session_expiry
from marginalia.plans.reading import SQL_FOLDERS
from marginalia.plans.changing import change_log
from marginalia.schema import CHANGES, notes_from_parts
from marginalia.scratch import Scratch
from marginalia.sources import (
    commit_changes,
    read_rejects,
    read_store,
    read_tagged,
    refresh_notes,
    scan_changed,
    scan_files,
    scan_folders,
    scan_notes,
    write_files,
    write_notes,
    write_snapshot,
)
from marginalia.streaming import apply_batch, ingest_batch, stream_apply, stream_ingest

FOLDER = "src1/en"


def short_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note per document, in folders by source; every ninth has no text."""
    doc = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    return notes_from_parts(
        docs.select(
            F.concat("source", F.lit("/"), "lang", F.lit("/n "), doc.cast("string"), F.lit(".md")).alias("path"),
            F.when(doc % 9 == 0, "").otherwise(F.col("text")).alias("content"),
            F.when(doc % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", F.lit('q"uote'))).alias("tags"),
            F.lit(START_MS).alias("mod_time"),
        )
    )


# A quote is escaped in the header, and a parsed tag keeps the escape.
_SQL_SHORT = """short AS (SELECT d.doc_id, source || '/' || lang || '/n ' || d.doc_id || '.md' AS path,
  CASE WHEN d.doc_id % 9 = 0 THEN '' ELSE text END AS content,
  CASE WHEN d.doc_id % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE [lang, 'q\\"uote'] END AS tags, source, lang
  FROM documents d)"""


def _digests(notes: DataFrame) -> DataFrame:
    return flat_tags(notes).select("path", "tags", "folder", F.md5("content").alias("digest"))


_SQL_DIGESTS = "path, array_to_string(tags, '|') AS tags, source || '/' || lang AS folder, md5(content) AS digest"


def _written(spark: SparkSession, sf_dir: str) -> str:
    root = f"{Scratch(spark, 'files').root}/notes"
    write_notes(short_notes(spark, sf_dir), root)
    return root


def files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes written as files and scanned again."""
    return _digests(scan_notes(spark, _written(spark, sf_dir)))


def files_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folders that writing the files has made."""
    return scan_folders(spark, _written(spark, sf_dir))


def _changed(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A folder of which some notes have grown since it was scanned."""
    root = _written(spark, sf_dir)
    before = Scratch(spark, "known").save(scan_notes(spark, root))
    number = F.regexp_extract("path", r"(\d+)\.md$", 1).cast("bigint")
    more = short_notes(spark, sf_dir).filter(number % 7 == 1).withColumn("content", F.concat("content", F.lit("\nmore")))
    write_notes(more, root)
    return root, before


def files_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, before = _changed(spark, sf_dir)
    return _digests(scan_changed(spark, root, before))


def files_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, before = _changed(spark, sf_dir)
    return _digests(refresh_notes(spark, root, before))


_SQL_GROWN = f"""{_SQL_SHORT}, grown AS (
  SELECT * REPLACE (CASE WHEN doc_id % 7 = 1 THEN content || chr(10) || 'more' ELSE content END AS content) FROM short)"""


def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot on top of another, as the store gives it back."""
    store = f"{Scratch(spark, 'store').root}/store"
    notes, folders = notes_of(spark, sf_dir), corpus.explicit_folders(spark, sf_dir)
    known = tree.all_folders(notes, folders)
    write_snapshot(notes.filter("size % 2 = 0"), known, store, cluster=True)
    write_snapshot(notes, known, store, cluster=True, expected=1)
    read, _ = read_store(spark, store)
    return flat_tags(read).select("path", "name", "tags", "mod_time", "size", F.md5("content").alias("digest"))


def store_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two logs committed one after the other to a store of all documents: updates and deletes, then new notes."""
    store = f"{Scratch(spark, 'store').root}/store"
    notes, doc = notes_of(spark, sf_dir), F.col("doc_id")
    write_snapshot(notes, corpus.explicit_folders(spark, sf_dir), store)
    docs = table(spark, sf_dir, "documents")
    edits = change_log(
        docs.filter(doc % 50 < 2),
        seq=doc,
        kind=F.when(doc % 50 == 0, "update").otherwise("delete"),
        path=corpus.doc_path(),
        content=F.concat(F.lit("edited "), doc.cast("string")),
        tags=F.array(F.lit("edited")),
        ts=F.lit(START_MS),
    )
    commit_changes(spark, store, edits, source="edits#1")
    made = change_log(
        table(spark, sf_dir, "conversations"),
        seq=F.col("conv_id") * 1_000_000 + F.col("turn"),
        kind="create",
        name=F.concat(F.lit("turn "), F.col("turn").cast("string")),
        folder=F.concat(F.lit("talk/"), F.col("conv_id").cast("string")),
        content=F.col("text"),
        tags=F.array("role"),
        ts=F.lit(START_MS) + F.col("conv_id"),
    )
    commit_changes(spark, store, made, source="made#1")
    read, _ = read_store(spark, store)
    return flat_tags(read).select("path", "name", "tags", "mod_time", "size", F.md5("content").alias("digest"))


def store_search_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag search through a store's tag index, after a commit that has given some notes other tags."""
    store = f"{Scratch(spark, 'store').root}/store"
    write_snapshot(notes_of(spark, sf_dir), corpus.explicit_folders(spark, sf_dir), store)
    doc = F.col("doc_id")
    edits = change_log(
        table(spark, sf_dir, "documents").filter(doc % 50 < 2),
        seq=doc,
        kind=F.when(doc % 50 == 0, "update").otherwise("delete"),
        path=corpus.doc_path(),
        content=F.concat(F.lit("edited "), doc.cast("string")),
        tags=F.array(F.when(doc % 100 == 0, "Fr").otherwise("edited")),
        ts=F.lit(START_MS),
    )
    commit_changes(spark, store, edits, source="edits#1")
    return flat_tags(read_tagged(spark, store, "FR")).select("path", "tags", "mod_time", F.md5("content").alias("digest"))


def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue streamed into a store; a batch that comes again changes nothing."""
    scratch = Scratch(spark, "replay")
    store, source, checkpoint = (f"{scratch.root}/{name}" for name in ("store", "in", "checkpoint"))
    log = event_queue(spark, sf_dir)
    log.write.parquet(source)
    stream = spark.readStream.schema(log.schema).parquet(source).select(*CHANGES.fieldNames())
    stream_apply(stream, store, checkpoint).awaitTermination()
    apply_batch(log.filter("seq % 2 = 0"), store, f"{checkpoint}#0")
    notes, _ = read_store(spark, store)
    return flat_tags(notes).select("path", "content", "tags", "mod_time")


DROPS = 3
INBOX = "in/box"


def dropped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages as files, in drops: some named as earlier ones, some that the gate refuses."""
    doc, page = F.col("doc_id"), F.col("page_id")
    docs = table(spark, sf_dir, "documents")
    header = F.when(doc % 4 == 0, "").otherwise(F.concat(F.lit("---\ntags: ["), "lang", F.lit("]\n---\n")))
    files = docs.select(
        (doc % DROPS).cast("int").alias("drop"),
        F.concat("source", F.lit("/d"), doc.cast("string"), F.when(doc % 2 == 0, ".txt").otherwise(".md")).alias("path"),
        F.concat(header, "text", F.lit("\n"), doc.cast("string")).cast("binary").alias("content"),
    )
    again = files.filter((F.col("drop") == 0) & F.endswith("path", F.lit("5.md"))).select(
        F.lit(DROPS - 1).alias("drop"), F.concat(F.lit("again/"), "path").alias("path"), "content"
    )
    ending = F.when(page % 3 == 1, F.unhex(F.lit("00"))).when(page % 3 == 2, F.unhex(F.lit("FF41"))).otherwise(F.unhex(F.lit("")))
    pages = table(spark, sf_dir, "pages").select(
        (page % DROPS).cast("int").alias("drop"),
        F.concat(F.lit("web/p"), page.cast("string"), F.when(page % 3 == 0, ".html").otherwise(".md")).alias("path"),
        F.concat(F.col("html").cast("binary"), ending).alias("content"),
    )
    return files.unionByName(again).unionByName(pages)


def streamed_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes and refusals after several drops of files, the first of which is delivered again.

    A name that was taken shows as ``T_`` and the name, as its time stamp is that of the file.
    """
    scratch = Scratch(spark, "drops")
    store, inbox, checkpoint = (f"{scratch.root}/{name}" for name in ("store", "in", "checkpoint"))
    files = dropped_files(spark, sf_dir)
    for drop in range(DROPS):
        write_files(files.filter(F.col("drop") == drop), f"{inbox}/{drop}")
        stream_ingest(spark, inbox, store, checkpoint, INBOX).awaitTermination()
    ingest_batch(scan_files(spark, f"{inbox}/0"), store, f"{checkpoint}#0", INBOX)
    notes, _ = read_store(spark, store)
    path = F.regexp_replace("path", r"\d{4}-\d\d-\d\d_\d{6}(-\d+)?_", "T_")
    kept = flat_tags(notes).select(path.alias("path"), "tags", F.md5("content").alias("digest"), F.lit("").alias("reason"))
    refused = read_rejects(spark, store).select(
        F.regexp_extract("path", r"/in/\d+/(.*)$", 1).alias("path"), F.lit("").alias("tags"), F.lit("").alias("digest"), "reason"
    )
    return kept.unionByName(refused)


def stream_replay_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of one note a user, streamed in three batches by time; a client's first failed one holds back the rest."""
    scratch = Scratch(spark, "holds")
    store, source, checkpoint = (f"{scratch.root}/{name}" for name in ("store", "in", "checkpoint"))
    path = F.concat(F.lit("events/"), "key", F.lit(".md"))
    queue = event_queue(spark, sf_dir)
    users = queue.select(path.alias("path")).distinct()
    blank = users.select("path", F.lit("").alias("content"), F.array().cast("array<string>").alias("tags"), F.lit(0).alias("mod_time"))
    write_snapshot(notes_from_parts(blank), spark.createDataFrame([], "path string"), store)
    lost = F.col("content").startswith("error") & (F.col("seq") % 97 == 0)
    log = queue.withColumns({"kind": F.lit("update"), "path": F.when(lost, "events/lost.md").otherwise(path), "name": F.lit(None).cast("string")})
    log = Scratch(spark, "log").save(log.repartition("seq"))
    first, last = log.agg(F.min("ts"), F.max("ts")).first()
    part = F.least(F.lit(2), F.floor((F.col("ts") - first) * 3 / F.greatest(F.lit(1), F.lit(last - first)))).cast("int")
    for i in range(3):  # what has come since the last start is one batch, in as many files as tasks wrote
        log.filter(part == i).write.mode("append").parquet(source)
        stream = spark.readStream.schema(log.schema).parquet(source).select(*CHANGES.fieldNames())
        stream_apply(stream, store, checkpoint, coalesce=False, hold=True).awaitTermination()
    notes, _ = read_store(spark, store)
    return flat_tags(notes).select("path", "content", "tags", "mod_time")


def sessions_at_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live_sessions(session_expiry(spark, sf_dir), NOW_MS, at_load=True)


# ---- the order in which rows come ----


def _placed(rows: DataFrame, *group: str) -> DataFrame:
    """``pos``: the place of each row among those of its group, as they come."""
    return rows.withColumn("_came", F.monotonically_increasing_id()).withColumn(
        "pos", F.row_number().over(Window.partitionBy(*group).orderBy("_came"))
    )


def _folder_order(order: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = listing.list_notes(notes_of(spark, sf_dir), FOLDER, order)
        return _placed(rows.withColumn("folder", F.lit(FOLDER)), "folder").select("path", "pos")

    return run


def children_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tree.folder_children(notes_of(spark, sf_dir), corpus.explicit_folders(spark, sf_dir))
    return _placed(rows, "parent").select("path", "pos")


def preorder_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each folder among those below the same top folder."""
    folders = tree.all_folders(notes_of(spark, sf_dir), corpus.explicit_folders(spark, sf_dir))
    rows = tree.folder_preorder(folders).withColumn("top", F.split("path", "/")[0])
    return _placed(rows, "top").select("path", "pos")


def _sql_order(direction: str) -> str:
    return f"""WITH {corpus.NOTES} SELECT path, CAST(row_number() OVER (ORDER BY mod_time {direction}, path) AS INT) AS pos
FROM notes WHERE folder = '{FOLDER}'"""


def _sql_folders(select: str) -> str:
    return f"WITH {SQL_FOLDERS} {select}"


QUERIES = {
    "files_round_trip": files_round_trip,
    "files_folders": files_folders,
    "files_changed": files_changed,
    "files_refreshed": files_refreshed,
    "store_round_trip": store_round_trip,
    "store_commits": store_commits,
    "store_search_tag": store_search_tag,
    "stream_replay": stream_replay,
    "stream_replay_holds": stream_replay_holds,
    "streamed_ingest": streamed_ingest,
    "sessions_at_load": sessions_at_load,
    "newest_first_order": _folder_order("modified-desc"),
    "oldest_first_order": _folder_order("modified-asc"),
    "children_order": children_order,
    "preorder_order": preorder_order,
}

ORACLES = {
    "files_round_trip": f"WITH {_SQL_SHORT} SELECT {_SQL_DIGESTS} FROM short",
    "files_folders": f"""WITH {_SQL_SHORT} SELECT DISTINCT source AS path, '' AS parent, source AS name, 0::INT AS depth FROM short
UNION SELECT DISTINCT source || '/' || lang, source, lang, 1::INT FROM short""",
    "files_changed": f"WITH {_SQL_GROWN} SELECT {_SQL_DIGESTS} FROM grown WHERE doc_id % 7 = 1",
    "files_refreshed": f"WITH {_SQL_GROWN} SELECT {_SQL_DIGESTS} FROM grown",
    "store_round_trip": f"""WITH {corpus.NOTES} SELECT path, name, array_to_string(tags, '|') AS tags, mod_time, size,
  md5(content) AS digest FROM notes""",
    "store_commits": f"""WITH {corpus.DOCS}, result AS (
  SELECT path, CASE WHEN doc_id % 50 = 0 THEN 'edited ' || doc_id ELSE content END AS content,
    CASE WHEN doc_id % 50 = 0 THEN ['edited'] ELSE tags END AS tags,
    CASE WHEN doc_id % 50 = 0 THEN {START_MS} ELSE mod_time END AS mod_time FROM docs WHERE doc_id % 50 <> 1
  UNION ALL SELECT 'talk/' || conv_id || '/turn ' || turn || '.md', text, [role], {START_MS} + conv_id FROM conversations)
SELECT path, {corpus.sql_name("path")} AS name, array_to_string(tags, '|') AS tags, mod_time,
  {corpus.sql_size("tags", "content")} AS size, md5(content) AS digest FROM result""",
    "store_search_tag": f"""WITH {corpus.DOCS}, result AS (
  SELECT path, CASE WHEN doc_id % 50 = 0 THEN 'edited ' || doc_id ELSE content END AS content,
    CASE WHEN doc_id % 100 = 0 THEN ['Fr'] WHEN doc_id % 50 = 0 THEN ['edited'] ELSE tags END AS tags,
    CASE WHEN doc_id % 50 = 0 THEN {START_MS} ELSE mod_time END AS mod_time FROM docs WHERE doc_id % 50 <> 1)
SELECT path, array_to_string(tags, '|') AS tags, mod_time, md5(content) AS digest FROM result
WHERE list_contains(list_transform(tags, lambda t: lower(t)), 'fr')""",
    "stream_replay": """SELECT 'events/note_' || user_id || '.md' AS path, event_type || ' ' || props AS content,
  event_type AS tags, epoch_us(ts) // 1000 AS mod_time FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC) = 1""",
    "stream_replay_holds": """WITH queue AS (
  SELECT event_id AS seq, user_id, user_id % 10 AS client, 'note_' || user_id AS key, event_type || ' ' || props AS content,
    event_type AS tags, epoch_us(ts) // 1000 AS ts FROM events),
cut AS (SELECT *, least(2, floor((ts - min(ts) OVER ()) * 3 / greatest(1, max(ts) OVER () - min(ts) OVER ()))) AS part,
    count(*) FILTER (starts_with(content, 'error') AND seq % 97 = 0) OVER (PARTITION BY client ORDER BY ts, key, seq) AS failed FROM queue),
last AS (SELECT user_id, arg_max({'content': content, 'tags': tags, 'ts': ts}, (part, seq)) AS l FROM cut WHERE failed = 0 GROUP BY user_id)
SELECT 'events/note_' || u.user_id || '.md' AS path, coalesce(l.content, '') AS content, coalesce(l.tags, '') AS tags,
  coalesce(l.ts, 0) AS mod_time FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN last ON last.user_id = u.user_id""",
    "streamed_ingest": f"""WITH files AS (SELECT doc_id, 'd' || doc_id AS name, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS tags,
    md5(text || chr(10) || doc_id) AS digest FROM documents)
SELECT '{INBOX}/' || name || '.md' AS path, tags, digest, '' AS reason FROM files
UNION ALL SELECT '{INBOX}/T_' || name || '.md', tags, digest, '' FROM files WHERE doc_id % {DROPS} = 0 AND doc_id % 10 = 5
UNION ALL SELECT 'web/p' || page_id || CASE WHEN page_id % 3 = 0 THEN '.html' ELSE '.md' END, '', '',
  CASE page_id % 3 WHEN 0 THEN 'extension' WHEN 1 THEN 'nul_byte' ELSE 'not_utf8' END FROM pages""",
    "sessions_at_load": f"SELECT * FROM ({SQL_EXPIRY}) WHERE expires > {NOW_MS}",
    "newest_first_order": _sql_order("DESC"),
    "oldest_first_order": _sql_order("ASC"),
    "children_order": _sql_folders(
        f"SELECT path, CAST(row_number() OVER (PARTITION BY {corpus.sql_folder('path')} ORDER BY {corpus.sql_base('path')}) AS INT) AS pos FROM folders"
    ),
    "preorder_order": _sql_folders(
        "SELECT path, CAST(row_number() OVER (PARTITION BY string_split(path, '/')[1] ORDER BY string_split(path, '/')) AS INT) AS pos FROM folders"
    ),
}
