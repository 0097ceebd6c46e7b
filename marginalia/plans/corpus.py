"""A notes corpus, a change log and activity derived from the supplied tables.

Every derivation exists twice: as a DataFrame, and as the SQL that says the same
to DuckDB. Nothing is joined or sampled to make the notes: one document is one
note, and the whole text is its body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import RENDERED_BLANKS, UNICODE_BLANKS
from marginalia.schema import notes_from_parts

START_MS = 1704067200000  # 2024-01-01 00:00:00 UTC
DAY_MS = 24 * 60 * 60 * 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str) -> Column:
    return F.col(column).cast("string")


def doc_path() -> Column:
    """The path of a document's note; a seventh are in the root, a fifth carry a timestamp."""
    doc = F.col("doc_id")
    stamp = F.concat(
        F.lit("2024-01-"),
        F.lpad((doc % 28 + 1).cast("string"), 2, "0"),
        F.lit("_"),
        F.lpad((doc % 240000).cast("string"), 6, "0"),
        F.lit("_"),
        text_of("doc_id"),
    )
    name = F.when(doc % 5 == 0, stamp).otherwise(F.concat(F.lit("doc_"), text_of("doc_id")))
    folder = F.when(doc % 7 == 0, "").otherwise(F.concat("source", F.lit("/"), "lang", F.lit("/")))
    return F.concat(folder, name, F.lit(".md"))


def doc_tags() -> Column:
    plain = F.array("lang", "source")
    return F.when(F.col("n_chars") > 1000, F.array_append(plain, F.lit("Long"))).otherwise(plain)


def doc_mod_time() -> Column:
    return F.lit(START_MS) + F.col("doc_id") % 97 * 60000


def doc_body() -> Column:
    """The text under a little Markdown of every kind."""
    return F.concat(
        F.lit("# Note "), text_of("doc_id"), F.lit("\n\n> from <https://"), F.col("source"),
        F.lit(".example.org/a_b>\n\n- [x] *done*\n+ __bold words__ and _soft_ _ones_\n1. ["),
        F.col("lang"),
        F.lit("](http://a.example/c_d) ![pic](x.png) snake_case_name\n\n```\ncode\n```\n\n---\n\n<b>tag</b>\n\n"),
        F.col("text"),
    )


def notes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes table: one note per document."""
    parts = table(spark, sf_dir, "documents").select(
        doc_path().alias("path"),
        doc_body().alias("content"),
        doc_tags().alias("tags"),
        doc_mod_time().alias("mod_time"),
    )
    return notes_from_parts(parts)


def explicit_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders that were made on purpose and hold no notes, one per kind of label."""
    labels = table(spark, sf_dir, "labels")
    return labels.select(
        F.concat(
            F.lit("archive/quality_"), text_of("quality"), F.lit("/toxic_"), text_of("toxic")
        ).alias("path")
    ).distinct()


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of a zone-less timestamp, read as UTC in any session zone."""
    since = ts - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.round(since.cast("interval second").cast("decimal(20,6)") * 1000000).cast("bigint")
    return (micros - F.pmod(micros, F.lit(1000))) / 1000


def event_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as queued changes: a user is one note, kept in that user's queue."""
    events = table(spark, sf_dir, "events")
    user = text_of("user_id")
    return events.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("note_"), user).alias("key"),
        F.concat(F.lit("client_"), (F.col("user_id") % 10).cast("string")).alias("client_id"),
        F.lit("save").alias("kind"),
        F.lit(None).cast("string").alias("path"),
        F.concat(F.lit("note_"), user).alias("name"),
        F.lit("events").alias("folder"),
        F.concat("event_type", F.lit(" "), "props").alias("content"),
        F.array("event_type").alias("tags"),
        epoch_ms(F.col("ts")).cast("bigint").alias("ts"),
    )


def flat_tags(df: DataFrame) -> DataFrame:
    """Tags as one text, for comparing with an oracle."""
    return df.withColumn("tags", F.array_join("tags", "|"))


# ---- the same, said in SQL ----


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


SQL_BLANKS = sql_text(UNICODE_BLANKS)
SQL_RENDERED_BLANKS = sql_text(RENDERED_BLANKS)

SQL_PATH = """CASE WHEN doc_id % 7 = 0 THEN '' ELSE source || '/' || lang || '/' END ||
  CASE WHEN doc_id % 5 = 0
       THEN '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || '_'
            || lpad(CAST(doc_id % 240000 AS VARCHAR), 6, '0') || '_' || doc_id
       ELSE 'doc_' || doc_id END || '.md'"""

SQL_BODY = """'# Note ' || doc_id || e'\\n\\n> from <https://' || source
  || e'.example.org/a_b>\\n\\n- [x] *done*\\n+ __bold words__ and _soft_ _ones_\\n1. ['
  || lang || e'](http://a.example/c_d) ![pic](x.png) snake_case_name\\n\\n```\\ncode\\n```\\n\\n---\\n\\n<b>tag</b>\\n\\n'
  || text"""

SQL_TAGS = (
    "CASE WHEN n_chars > 1000 THEN [lang, source, 'Long'] ELSE [lang, source] END"
)

SQL_MOD_TIME = f"{START_MS} + doc_id % 97 * 60000"


def sql_folder(path: str) -> str:
    return f"CASE WHEN contains({path}, '/') THEN regexp_replace({path}, '/[^/]*$', '') ELSE '' END"


def sql_base(path: str) -> str:
    return f"regexp_extract({path}, '[^/]*$')"


def sql_name(path: str) -> str:
    return f"regexp_replace({sql_base(path)}, '[.]md$', '')"


def sql_preview(body: str) -> str:
    trimmed = f"trim({body}, {SQL_BLANKS})"
    return f"left({trimmed}, 1000) || CASE WHEN length({trimmed}) > 1000 THEN '...' ELSE '' END"


def sql_header(tags: str) -> str:
    quoted = f"list_transform({tags}, lambda t: '\"' || t || '\"')"
    return (
        f"CASE WHEN len({tags}) = 0 THEN '' ELSE e'---\\ntags: [' || "
        f"array_to_string({quoted}, ', ') || e']\\n---\\n' END"
    )


def sql_size(tags: str, body: str) -> str:
    return f"CAST(strlen({sql_header(tags)}) + strlen({body}) AS BIGINT)"


DOCS = f"""docs AS (
  SELECT *, {SQL_PATH} AS path, {SQL_BODY} AS content, {SQL_TAGS} AS tags,
         {SQL_MOD_TIME} AS mod_time
  FROM documents)"""

NOTES = f"""{DOCS}, notes AS (
  SELECT doc_id, path, {sql_folder("path")} AS folder, {sql_name("path")} AS name,
         content, tags, mod_time, {sql_size("tags", "content")} AS size,
         {sql_preview("content")} AS preview
  FROM docs)"""

META = "path, name, array_to_string(tags, '|') AS tags, mod_time, preview"
