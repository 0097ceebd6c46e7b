"""Registered queries over queues, sessions, snapshots and incoming files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.operators import diff, queue
from marginalia.operators import live_sessions as _live_sessions
from marginalia.operators import session_expiry as _session_expiry
from marginalia.operators import sessions
from marginalia.plans import corpus
from marginalia.plans.corpus import DAY_MS, START_MS, event_queue, flat_tags, table

from marginalia.scratch import Scratch
from marginalia.operators.changes import apply_changes
from marginalia.schema import FOLDERS, notes_from_parts
from marginalia.sources.ingest import MAX_BYTES, as_creates, ingest_gate
from marginalia.streaming import stream_coalesce, stream_pending, stream_sessions, stream_sessions_logout

BATCHES = 4
TIE_MS = 6 * 60 * 60 * 1000
TTL_MS = 12 * 60 * 60 * 1000
NOW_MS = START_MS + 29 * DAY_MS

# ---- the change queue ----

QUEUE_COLUMNS = ["seq", "key", "client_id", "content", "ts"]


def read_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_tags(queue.read_changes(event_queue(spark, sf_dir))).select(*QUEUE_COLUMNS, "tags")


def replay_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each entry in its client's queue, as the sorted rows come, with many ties in time."""
    tied = event_queue(spark, sf_dir).withColumn("ts", F.floor(F.col("ts") / TIE_MS))
    rows = queue.read_changes(tied).withColumn("place", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy("client_id").orderBy("place"))
    return rows.select("seq", "client_id", place.alias("pos"))


def coalesce_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.coalesce_changes(event_queue(spark, sf_dir)).select(*QUEUE_COLUMNS)


def replay_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay in which some entries fail, with one queue per client and many ties in time."""
    fails = (F.col("content").startswith("error")) & (F.col("seq") % 401 == 0)
    results = event_queue(spark, sf_dir).withColumn("ok", ~fails)
    results = results.withColumn("ts", F.floor(F.col("ts") / TIE_MS))
    return queue.replay_prefix(results).select("seq", "client_id", "status")


_SQL_QUEUE = """queue AS (
  SELECT event_id AS seq, 'note_' || user_id AS key, 'client_' || user_id % 10 AS client_id,
    event_type || ' ' || props AS content, event_type AS tags, epoch_us(ts) // 1000 AS ts FROM events)"""
_SQL_COALESCED = f"""WITH {_SQL_QUEUE} SELECT seq, key, client_id, content, ts FROM queue
QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) = 1"""

# ---- snapshots ----


def two_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as seen before and after some were added, removed, touched or resized."""
    doc = F.col("doc_id")
    files = table(spark, sf_dir, "documents").select(
        "doc_id",
        corpus.doc_path().alias("path"),
        corpus.doc_mod_time().alias("mod_time"),
        F.octet_length("text").cast("bigint").alias("size"),
    )
    old = files.filter(doc % 17 != 0).drop("doc_id")
    new = files.filter(doc % 13 != 0).select(
        "path",
        (F.col("mod_time") + F.when(doc % 5 == 0, 1).otherwise(0)).alias("mod_time"),
        (F.col("size") + F.when(doc % 19 == 0, 1).otherwise(0)).alias("size"),
    )
    return old, new


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.snapshot_diff(*two_snapshots(spark, sf_dir))


def incremental_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = two_snapshots(spark, sf_dir)
    return diff.to_parse(new, old).select("path", "mod_time", "size")


_SQL_SNAPSHOTS = f"""{corpus.DOCS}, old AS (
  SELECT path, mod_time, CAST(strlen(text) AS BIGINT) AS size FROM docs WHERE doc_id % 17 <> 0),
new AS (SELECT path, mod_time + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS mod_time,
    CAST(strlen(text) AS BIGINT) + CASE WHEN doc_id % 19 = 0 THEN 1 ELSE 0 END AS size
  FROM docs WHERE doc_id % 13 <> 0)"""

# ---- sessions ----


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("token_"), F.col("user_id").cast("string")).alias("token"),
        corpus.epoch_ms(F.col("ts")).cast("bigint").alias("ts"),
        (F.col("event_id") % 53 == 0).alias("leaves"),
    )


def sessions_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(activity(spark, sf_dir), ttl_ms=TTL_MS)


def sessions_logout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(activity(spark, sf_dir), ttl_ms=TTL_MS, logout=F.col("leaves"))


def session_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session_expiry(activity(spark, sf_dir), ttl_ms=TTL_MS)


def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live_sessions(session_expiry(spark, sf_dir), NOW_MS)


_SQL_ACTIVITY = """activity AS (SELECT 'token_' || user_id AS token, epoch_us(ts) // 1000 AS ts,
  event_id % 53 = 0 AS leaves FROM events)"""


def _sql_sessions(source: str) -> str:
    return f"""gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY token ORDER BY ts) <= {TTL_MS}
    THEN 0 ELSE 1 END AS fresh FROM {source}),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY token ORDER BY ts
    RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM gaps),
spans AS (SELECT token, min(ts) AS start, max(ts) AS last, count(*) AS n_events, bool_or(leaves) AS out
    FROM numbered GROUP BY token, session)"""


_SQL_SPANS = f"token, start, last, last + {TTL_MS} AS expires, n_events"
SQL_LOGOUT = f"""WITH {_SQL_ACTIVITY}, ends AS (
  SELECT token, min(ts) AS ended FROM activity WHERE leaves GROUP BY token),
valid AS (SELECT a.* FROM activity a LEFT JOIN ends e ON a.token = e.token WHERE e.ended IS NULL OR a.ts <= e.ended),
{_sql_sessions("valid")}
SELECT token, start, last, CASE WHEN out THEN last ELSE last + {TTL_MS} END AS expires, n_events FROM spans"""
SQL_EXPIRY = (
    f"WITH {_SQL_ACTIVITY} SELECT token, max(ts) + {TTL_MS} AS expires FROM activity GROUP BY token"
)

# ---- streams over the same tables ----


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
    return reader.parquet(sf_dir)


def streamed_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue as a stream of several batches, out of order; of each key what its last batch said counts."""
    return _streamed(spark, sf_dir, _parts(event_queue(spark, sf_dir)), pending_only=False)


def streamed_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with reports of applied entries mixed in: entries that were applied leave the queue."""
    log = event_queue(spark, sf_dir)
    reports = log.filter(F.col("seq") % 3 == 0)
    parts = _parts(log).unionByName(_parts(reports).withColumn("applied", F.lit(True)))
    return _streamed(spark, sf_dir, parts, pending_only=True)


def streamed_pending_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the queue whose state forgets applied entries after a while."""
    log = event_queue(spark, sf_dir)
    reports = log.filter(F.col("seq") % 3 == 0)
    parts = _parts(log).unionByName(_parts(reports).withColumn("applied", F.lit(True)))
    return _streamed(spark, sf_dir, parts, pending_only=True, follow=stream_pending)


def _parts(log: DataFrame) -> DataFrame:
    """The log with ``part``: a file of its own for each, so that later entries may well come first."""
    part = F.pmod(F.xxhash64("seq"), F.lit(BATCHES))
    columns = ["seq", "key", "ts"]
    return log.select(*columns, F.lit(False).alias("applied"), part.alias("part"))


def _streamed(spark: SparkSession, sf_dir: str, parts: DataFrame, pending_only: bool, follow=stream_coalesce) -> DataFrame:
    scratch = Scratch(spark, "stream")
    source = f"{scratch.root}/in"
    parts.repartition(BATCHES, "part").drop("part").write.parquet(source)
    changes = spark.readStream.schema(parts.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(source)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{scratch.root}/out/batch={batch_id}")

    follow(changes).writeStream.outputMode("update").foreachBatch(keep).option(
        "checkpointLocation", f"{scratch.root}/checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    written = spark.read.parquet(f"{scratch.root}/out")
    last = written.groupBy("key").agg(F.max_by(F.struct("seq", "pending"), "batch").alias("last"))
    kept = last.select("last.*").filter("pending" if pending_only else "true").select("seq")
    return event_queue(spark, sf_dir).join(kept, "seq", "left_semi").select(*QUEUE_COLUMNS)


def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that the watermark has closed by the end of the stream."""
    scratch = Scratch(spark, "stream")
    events = stream_of(spark, sf_dir, "events").select(
        F.concat(F.lit("token_"), F.col("user_id").cast("string")).alias("token"),
        corpus.epoch_ms(F.col("ts")).cast("bigint").alias("ts"),
    )
    closed = stream_sessions(events, ttl_ms=TTL_MS)
    closed.writeStream.outputMode("append").format("parquet").option(
        "checkpointLocation", f"{scratch.root}/checkpoint"
    ).option("path", f"{scratch.root}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(closed.schema).parquet(f"{scratch.root}/out")


def streamed_sessions_logout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with logouts, as the events drop in by time: a run of the stream for each drop, from where the last one ended."""
    scratch = Scratch(spark, "stream")
    source, out = f"{scratch.root}/in", f"{scratch.root}/out"
    events = activity(spark, sf_dir)
    first, last = events.agg(F.coalesce(F.min("ts"), F.lit(0)), F.coalesce(F.max("ts"), F.lit(0))).first()
    drop = F.floor((F.col("ts") - first) * BATCHES / (last - first + 1))
    events = scratch.save(events.withColumn("drop", drop))
    for drop in range(BATCHES):
        events.filter(F.col("drop") == drop).drop("drop").write.mode("append").parquet(source)
        arriving = spark.readStream.schema(events.drop("drop").schema).parquet(source)
        closed = stream_sessions_logout(arriving, F.col("leaves"), ttl_ms=TTL_MS)
        closed.writeStream.outputMode("append").format("parquet").option(
            "checkpointLocation", f"{scratch.root}/checkpoint"
        ).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(closed.schema).parquet(out)


# ---- incoming files ----

TARGET = "in/box"


def incoming_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and documents as files of good and bad kinds, some too large, some not text."""
    page = F.col("page_id")
    suffix = (
        F.when(page % 6 == 0, ".md")
        .when(page % 6 == 1, ".Txt")
        .when(page % 6 == 2, ".html")
        .when(page % 6 == 3, ".MD")
        .otherwise(".md")
    )
    ending = (
        F.when(page % 6 == 4, F.unhex(F.lit("00")))
        .when(page % 6 == 5, F.unhex(F.lit("FF41")))
        .otherwise(F.unhex(F.lit("")))
    )
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("drop\\Page: "), page.cast("string"), suffix).alias("path"),
        (F.lit(START_MS) + page).alias("ms"),
        F.concat(F.col("html").cast("binary"), ending).alias("content"),
    )
    doc = F.col("doc_id")
    times = F.when(doc % 97 == 3, F.ceil(F.lit(MAX_BYTES + 1) / F.octet_length("text"))).otherwise(1)
    header = F.when(doc % 2 == 0, F.concat(F.lit("---\ntags: ["), "lang", F.lit("]\n---\n"))).otherwise("")
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("docs/"), F.when(doc % 11 == 0, F.lit(" . ")).otherwise(doc.cast("string")), F.lit(".txt")).alias("path"),
        (F.lit(START_MS) + doc).alias("ms"),
        F.concat(header, F.repeat("text", times.cast("int"))).cast("binary").alias("content"),
    )
    return pages.unionByName(docs).select(
        "path",
        F.timestamp_millis("ms").alias("modificationTime"),
        F.octet_length("content").cast("bigint").alias("length"),
        "content",
    )


def ingest_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, _ = ingest_gate(incoming_files(spark, sf_dir), TARGET)
    digest = F.md5("content").alias("digest")
    return flat_tags(accepted).select("source_path", "path", "name", "tags", "mod_time", "size", digest)


def ingest_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = ingest_gate(incoming_files(spark, sf_dir), TARGET)
    return rejected


def ingest_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted files as new notes of the folder; a fifth of the names that documents want are taken."""
    accepted, _ = ingest_gate(incoming_files(spark, sf_dir), TARGET)
    doc = F.col("doc_id")
    taken = table(spark, sf_dir, "documents").filter(doc % 5 == 0).select(
        F.concat(F.lit(f"{TARGET}/"), doc.cast("string"), F.lit(".md")).alias("path"),
        F.lit("taken").alias("content"),
        F.array().cast("array<string>").alias("tags"),
        F.lit(START_MS).alias("mod_time"),
    )
    seq = F.col("mod_time") - START_MS + F.when(F.col("source_path").startswith("drop"), F.lit(1 << 40)).otherwise(0)
    notes, _, _ = apply_changes(notes_from_parts(taken), spark.createDataFrame([], FOLDERS), as_creates(accepted, seq))
    return flat_tags(notes).select("path", "tags", "mod_time", F.md5("content").alias("digest"))


_SQL_INCOMING = f"""incoming AS (
  SELECT 'drop\\Page: ' || page_id || CASE page_id % 6 WHEN 1 THEN '.Txt' WHEN 2 THEN '.html' WHEN 3 THEN '.MD' ELSE '.md' END AS path,
    'Page_ ' || page_id AS name, page_id % 6 AS kind, {START_MS} + page_id AS ms,
    strlen(html) + CASE page_id % 6 WHEN 4 THEN 1 WHEN 5 THEN 2 ELSE 0 END AS length,
    CAST([] AS VARCHAR[]) AS tags, html AS body FROM pages
  UNION ALL SELECT 'docs/' || CASE WHEN doc_id % 11 = 0 THEN ' . ' ELSE CAST(doc_id AS VARCHAR) END || '.txt',
    CASE WHEN doc_id % 11 = 0 THEN strftime(make_timestamp(({START_MS} + doc_id) * 1000), '%Y-%m-%d_%H%M%S')
         ELSE CAST(doc_id AS VARCHAR) END,
    0, {START_MS} + doc_id,
    CASE WHEN doc_id % 2 = 0 THEN strlen(lang) + 17 ELSE 0 END + strlen(text) *
      CASE WHEN doc_id % 97 = 3 THEN CAST(ceil({MAX_BYTES + 1} / strlen(text)) AS BIGINT) ELSE 1 END,
    CASE WHEN doc_id % 2 = 0 THEN [lang] ELSE CAST([] AS VARCHAR[]) END, text FROM documents),
checked AS (SELECT *, CASE WHEN kind = 2 THEN 'extension' WHEN length > {MAX_BYTES} THEN 'too_large'
    WHEN kind = 5 THEN 'not_utf8' WHEN kind = 4 THEN 'nul_byte' END AS reason FROM incoming)"""

QUERIES = {
    "read_changes": read_changes,
    "replay_order": replay_order,
    "pending_count": lambda spark, sf: queue.pending_count(event_queue(spark, sf)),
    "coalesce_changes": coalesce_changes,
    "replay_prefix": replay_prefix,
    "snapshot_diff": snapshot_diff,
    "incremental_files": incremental_files,
    "sessions_ttl": sessions_ttl,
    "sessions_logout": sessions_logout,
    "session_expiry": session_expiry,
    "live_sessions": live_sessions,
    "ingest_accepted": ingest_accepted,
    "ingest_rejected": ingest_rejected,
    "ingest_committed": ingest_committed,
    "streamed_coalesce": streamed_coalesce,
    "streamed_pending": streamed_pending,
    "streamed_pending_ends": streamed_pending_ends,
    "streamed_sessions": streamed_sessions,
    "streamed_sessions_logout": streamed_sessions_logout,
}

ORACLES = {
    "read_changes": f"WITH {_SQL_QUEUE} SELECT * FROM queue",
    "replay_order": f"""WITH {_SQL_QUEUE} SELECT seq, client_id,
  CAST(row_number() OVER (PARTITION BY client_id ORDER BY ts // {TIE_MS}, key, seq) AS INT) AS pos FROM queue""",
    "pending_count": "SELECT count(*) AS pending FROM events",
    "coalesce_changes": _SQL_COALESCED,
    "replay_prefix": f"""WITH {_SQL_QUEUE}, results AS (
  SELECT * REPLACE (ts // {TIE_MS} AS ts), NOT (starts_with(content, 'error') AND seq % 401 = 0) AS ok FROM queue),
counted AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY client_id ORDER BY ts, key, seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS failed_before FROM results)
SELECT seq, client_id, CASE WHEN failed_before > 0 THEN 'queued' WHEN ok THEN 'applied' ELSE 'failed' END AS status
FROM counted""",
    "snapshot_diff": f"""WITH {_SQL_SNAPSHOTS}
SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.path IS NULL THEN 'added'
  WHEN new.path IS NULL THEN 'removed'
  WHEN old.mod_time = new.mod_time AND old.size = new.size THEN 'unchanged' ELSE 'changed' END AS status
FROM old FULL JOIN new ON old.path = new.path""",
    "incremental_files": f"""WITH {_SQL_SNAPSHOTS} SELECT path, mod_time, size FROM new
WHERE (path, mod_time, size) NOT IN (SELECT (path, mod_time, size) FROM old)""",
    "sessions_ttl": f"WITH {_SQL_ACTIVITY}, {_sql_sessions('activity')} SELECT {_SQL_SPANS} FROM spans",
    "sessions_logout": SQL_LOGOUT,
    "session_expiry": SQL_EXPIRY,
    "live_sessions": f"SELECT * FROM ({SQL_EXPIRY}) WHERE expires >= {NOW_MS}",
    "ingest_accepted": f"""WITH {_SQL_INCOMING}
SELECT path AS source_path, '{TARGET}/' || name || '.md' AS path, name, array_to_string(tags, '|') AS tags,
  ms AS mod_time, length AS size, md5(body) AS digest FROM checked WHERE reason IS NULL""",
    "ingest_committed": f"""WITH {_SQL_INCOMING}, taken AS (
  SELECT '{TARGET}/' || doc_id || '.md' AS path FROM documents WHERE doc_id % 5 = 0),
asked AS (SELECT *, strftime(make_timestamp(ms * 1000), '%Y-%m-%d_%H%M%S') AS stamp,
    row_number() OVER (PARTITION BY name ORDER BY starts_with(path, 'drop'), ms) = 1
      AND '{TARGET}/' || name || '.md' NOT IN (SELECT path FROM taken) AS direct FROM checked WHERE reason IS NULL),
named AS (SELECT *, row_number() OVER (PARTITION BY direct, name, stamp ORDER BY starts_with(path, 'drop'), ms) AS r FROM asked)
SELECT path, '' AS tags, {START_MS} AS mod_time, md5('taken') AS digest FROM taken
UNION ALL SELECT '{TARGET}/' || CASE WHEN direct THEN '' WHEN r = 1 THEN stamp || '_' ELSE stamp || '-' || r || '_' END || name || '.md',
  array_to_string(tags, '|'), ms, md5(body) FROM named""",
    "ingest_rejected": f"WITH {_SQL_INCOMING} SELECT path, length, reason FROM checked WHERE reason IS NOT NULL",
    "streamed_coalesce": _SQL_COALESCED,
    "streamed_pending": f"SELECT * FROM ({_SQL_COALESCED}) WHERE seq % 3 <> 0",
    "streamed_pending_ends": f"SELECT * FROM ({_SQL_COALESCED}) WHERE seq % 3 <> 0",
    "streamed_sessions": f"""WITH {_SQL_ACTIVITY}, {_sql_sessions("activity")}
SELECT {_SQL_SPANS} FROM spans WHERE last + {TTL_MS} <= (SELECT max(ts) - 3600000 FROM activity)""",
    "streamed_sessions_logout": f"""SELECT * FROM ({SQL_LOGOUT})
WHERE expires <= (SELECT max(epoch_us(ts) // 1000) - 3600000 FROM events)""",
}
