"""Registered queries that read the corpus, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import (
    add_tag,
    ancestors,
    basename,
    dirname,
    is_timestamp_name,
    normalize_path,
    note_name,
    parse_front_matter,
    rewrite_prefix,
    sanitize_name,
    timestamp_name,
)
from marginalia.operators import apply_changes, listing, search, tree
from marginalia.plans import corpus
from marginalia.plans.corpus import flat_tags, notes_of, table
from marginalia.schema import FOLDERS, notes_from_raw
from marginalia.sources.files import render_notes

FOLDER = "src1/en"


def _search(q: str = "", tag: str = ""):
    return lambda spark, sf: flat_tags(search.search_notes(notes_of(spark, sf), q, tag))


def _sql_notes(where: str, columns: str = corpus.META) -> str:
    return f"WITH {corpus.NOTES} SELECT {columns} FROM notes WHERE {where}"


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage as a body search, some with a tag, and a tag search beside it."""
    items = table(spark, sf_dir, "benchmark")
    item = F.col("item_id")
    tag = F.when(item % 3 == 0, "").when(item % 3 == 1, "EN").otherwise("long")
    bodies = items.select((item * 2).alias("query_id"), F.col("text").alias("q"), tag.alias("tag"))
    tags = items.select(
        (item * 2 + 1).alias("query_id"),
        F.lit("").alias("q"),
        F.concat(F.lit("SRC"), item.cast("string")).alias("tag"),
    )
    return bodies.unionByName(tags)


def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.batch_search(notes_of(spark, sf_dir), benchmark_queries(spark, sf_dir))
    return found.select("query_id", "path", "name", "mod_time")


def batch_search_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches as people type them: one word or part of one, two words, a tag."""
    item, words = F.col("item_id"), F.split("text", " ")
    one = F.when(item % 2 == 0, words[1]).otherwise(F.substring(words[1], 2, 3))
    two = F.concat_ws(" ", words[2], words[3])
    tag = F.concat(F.lit("Src"), corpus.text_of("item_id"))
    each = F.array(
        F.struct((item * 3).alias("query_id"), one.alias("q"), F.lit("").alias("tag")),
        F.struct((item * 3 + 1).alias("query_id"), two.alias("q"), F.lit("").alias("tag")),
        F.struct((item * 3 + 2).alias("query_id"), F.lit("").alias("q"), tag.alias("tag")),
    )
    queries = table(spark, sf_dir, "benchmark").select(F.explode(each).alias("q")).select("q.*")
    return search.batch_search(notes_of(spark, sf_dir), queries).select("query_id", "path", "name", "mod_time")


def batch_search_unspaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of passages in texts that have lost their spaces, as in scripts without them or in encoded data."""
    notes = notes_of(spark, sf_dir).withColumn("content", F.replace("content", F.lit(" "), F.lit("")))
    passage = F.replace("text", F.lit(" "), F.lit(""))
    length = F.when(F.col("item_id") % 5 == 0, 2).otherwise(F.col("item_id") % 7 + 6).cast("int")
    queries = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.substr(passage, F.lit(3), length).alias("q"), F.lit("").alias("tag")
    )
    return search.batch_search(notes, queries).select("query_id", "path", "name", "mod_time")


SQL_BATCH_SEARCH_UNSPACED = f"""WITH {corpus.NOTES}, wanted AS (
  SELECT item_id AS query_id,
    substr(replace(text, ' ', ''), 3, CASE WHEN item_id % 5 = 0 THEN 2 ELSE item_id % 7 + 6 END) AS q FROM benchmark)
SELECT query_id, path, name, mod_time FROM wanted JOIN notes ON contains(replace(lower(content), ' ', ''), lower(q))"""

SQL_BATCH_SEARCH_SHORT = f"""WITH {corpus.NOTES}, wanted AS (
  SELECT item_id * 3 AS query_id, CASE WHEN item_id % 2 = 0 THEN split_part(text, ' ', 2)
         ELSE substr(split_part(text, ' ', 2), 2, 3) END AS q, '' AS tag FROM benchmark
  UNION ALL SELECT item_id * 3 + 1, split_part(text, ' ', 3) || ' ' || split_part(text, ' ', 4), '' FROM benchmark
  UNION ALL SELECT item_id * 3 + 2, '', 'Src' || item_id FROM benchmark)
SELECT query_id, path, name, mod_time FROM wanted JOIN notes
  ON (tag = '' OR list_contains(list_transform(tags, lambda t: lower(t)), lower(tag)))
 AND (q = '' OR contains(lower(content), lower(q)))"""

SQL_BATCH_SEARCH = f"""WITH {corpus.NOTES}, wanted AS (
  SELECT item_id * 2 AS query_id, text AS q,
         CASE item_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'EN' ELSE 'long' END AS tag FROM benchmark
  UNION ALL SELECT item_id * 2 + 1, '', 'SRC' || item_id FROM benchmark)
SELECT query_id, path, name, mod_time FROM wanted JOIN notes
  ON (tag = '' OR list_contains(list_transform(tags, lambda t: lower(t)), lower(tag)))
 AND (q = '' OR contains(lower(content), lower(q)))"""


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files with headers of many shapes, closed and unclosed."""
    doc = F.col("doc_id") % 8
    lang, source = F.col("lang"), F.col("source")
    header = (
        F.when(doc == 0, "")
        .when(doc == 1, F.concat(F.lit('---\ntags: ["'), lang, F.lit('", "'), source, F.lit('"]\n---\n')))
        .when(doc == 2, F.concat(F.lit("---\r\ntitle: t\r\ntags: ["), lang, F.lit(" , '"), source, F.lit("']\r\n---\r\n")))
        .when(doc == 3, F.concat(F.lit("---\ntags: "), lang, F.lit(",,"), source, F.lit("\ntags: [no]\n---\n")))
        .when(doc == 4, F.concat(F.lit("---\ntags: ["), lang, F.lit("]\n")))
        .when(doc == 5, "---\n---\n")
        .when(doc == 6, F.concat(F.lit("---\n tags: [no]\n----\n---\n"), lang, F.lit("\n---\n")))
        .otherwise("--- \ntags: [no]\n---\n")
    )
    return table(spark, sf_dir, "documents").select(
        corpus.doc_path().alias("path"),
        F.concat(header, "text").alias("raw"),
        corpus.doc_mod_time().alias("mod_time"),
        F.col("n_chars").alias("size"),
    )


def front_matter_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = raw_files(spark, sf_dir).withColumn("parsed", parse_front_matter(F.col("raw")))
    return parsed.select(
        "path",
        F.array_join("parsed.tags", "|").alias("tags"),
        F.col("parsed.body").alias("body"),
    )


_SQL_RAW = """CASE doc_id % 8 WHEN 0 THEN ''
  WHEN 1 THEN e'---\\ntags: ["' || lang || '", "' || source || e'"]\\n---\\n'
  WHEN 2 THEN e'---\\r\\ntitle: t\\r\\ntags: [' || lang || e' , \\'' || source || e'\\']\\r\\n---\\r\\n'
  WHEN 3 THEN e'---\\ntags: ' || lang || ',,' || source || e'\\ntags: [no]\\n---\\n'
  WHEN 4 THEN e'---\\ntags: [' || lang || e']\\n'
  WHEN 5 THEN e'---\\n---\\n'
  WHEN 6 THEN e'---\\n tags: [no]\\n----\\n---\\n' || lang || e'\\n---\\n'
  ELSE e'--- \\ntags: [no]\\n---\\n' END || text"""

SQL_PARSED = f"""raws AS (SELECT *, {corpus.SQL_PATH} AS path, {_SQL_RAW} AS raw FROM documents),
headers AS (SELECT *, regexp_extract(raw, '(?s)\\A---\\r?\\n(|.*?\\n)---\\r*(\\n|\\z)', 0) AS head FROM raws),
lines AS (SELECT *, list_filter(string_split(head, e'\\n'), lambda l: starts_with(l, 'tags:'))[1] AS line FROM headers),
vals AS (SELECT *, regexp_replace(regexp_replace(trim(substr(coalesce(line, 'tags:'), 6), {corpus.SQL_BLANKS}), '^\\[', ''), '\\]$', '') AS val FROM lines),
parsed AS (SELECT *, substr(raw, length(head) + 1) AS body,
  list_filter(list_transform(string_split(val, ','), lambda t: trim(trim(t, {corpus.SQL_BLANKS}), '"''')), lambda t: t <> '') AS ptags FROM vals)"""


def notes_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files through the parser into note rows, as a folder scan does."""
    return flat_tags(listing.note_meta(notes_from_raw(raw_files(spark, sf_dir))))


def front_matter_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_notes(notes_of(spark, sf_dir))


def verbatim_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files scanned, moved, duplicated and written again: only an update changes a header."""
    doc = table(spark, sf_dir, "documents").select("doc_id", corpus.doc_path().alias("old"))
    files = raw_files(spark, sf_dir).withColumnRenamed("path", "old").join(doc, "old")
    files = files.withColumn("path", F.concat(F.lit("in/f"), F.col("doc_id").cast("string"), F.lit(".md")))
    kind = F.when(F.col("doc_id") % 3 == 0, "move").when(F.col("doc_id") % 3 == 1, "duplicate").otherwise("update")
    log = files.select(
        F.col("doc_id").alias("seq"),
        F.col("path").alias("key"),
        F.lit(None).cast("string").alias("client_id"),
        kind.alias("kind"),
        "path",
        F.lit(None).cast("string").alias("name"),
        F.lit("out").alias("folder"),
        F.when(kind == "update", "new").alias("content"),
        F.when(kind == "update", F.array(F.lit("t"))).alias("tags"),
        F.lit(corpus.START_MS).alias("ts"),
    )
    folders = spark.createDataFrame([], FOLDERS)
    notes, _, _ = apply_changes(notes_from_raw(files.select("path", "raw", "mod_time", "size")), folders, log)
    return render_notes(notes).select("path", F.md5("text").alias("digest"))


_SQL_VERBATIM = f"""WITH raws AS (SELECT doc_id, doc_id % 3 AS kind, {_SQL_RAW} AS raw FROM documents)
SELECT CASE kind WHEN 0 THEN 'out' ELSE 'in' END || '/f' || doc_id || '.md' AS path,
  md5(CASE kind WHEN 2 THEN e'---\ntags: ["t"]\n---\nnew' ELSE raw END) AS digest FROM raws
UNION ALL SELECT 'in/f' || doc_id || ' (copy).md', md5(raw) FROM raws WHERE kind = 1"""


def export_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_notes(notes_of(spark, sf_dir), front_matter=False)


# The rewrites of the plain-text chain in the dialect of the oracle. It has no
# look-ahead, so an emphasis rule takes the character after it along and runs twice.
# These patterns say the same as those of functions/markdown.py.
_SQL_REWRITES = (
    (r"(?m)^#{1,6}\s+", ""),
    (r"<(https?://[^>\s]+)>", r"\1"),
    (r"<[^>]*>", ""),
    (r"(?s)```.*?```", ""),
    (r"!\[.*?\]\(.*?\)", ""),
    (r"\[([^\]]+)\]\(.*?\)", r"\1"),
    (r"(?m)^\s*[-*+]\s+\[[ xX]\]\s*", ""),
    (r"(\A|[^\w])__(\S(?:[^_\n]*?\S)?)__([^\w]|\z)", r"\1\2\3"),
    (r"(\A|[^\w])__(\S(?:[^_\n]*?\S)?)__([^\w]|\z)", r"\1\2\3"),
    (r"(\A|[^\w])_(\S(?:[^_\n]*?\S)?)_([^\w]|\z)", r"\1\2\3"),
    (r"(\A|[^\w])_(\S(?:[^_\n]*?\S)?)_([^\w]|\z)", r"\1\2\3"),
    (r"[*~`]", ""),
    (r"(?m)^\s*>\s*", ""),
    (r"(?m)^\s*[-+*]\s+", ""),
    (r"(?m)^\s*\d+\.\s+", ""),
    (r"(?m)^---+$", ""),
    (r"[ \t\r]+", " "),
)


def _sql_plain(text: str) -> str:
    for pattern, replacement in _SQL_REWRITES:
        text = f"regexp_replace({text}, {corpus.sql_text(pattern)}, {corpus.sql_text(replacement)}, 'g')"
    return f"trim(regexp_replace({text}, '\\n+', chr(10), 'g'), {corpus.SQL_RENDERED_BLANKS})"


def note_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_tags(listing.enrich(listing.note_meta(notes_of(spark, sf_dir))))


def page_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain previews of web pages, which are full of tags, entities and symbols."""
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"),
        F.col("html").alias("raw"),
        F.lit(corpus.START_MS).alias("mod_time"),
        F.octet_length("html").alias("size"),
    )
    enriched = listing.enrich(listing.note_meta(notes_from_raw(pages)))
    return enriched.select("path", "has_custom_name", "plain_preview")


def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, page = F.col("url"), F.col("page_id")
    climb = F.when(page % 4 == 0, "/../../../../..").when(page % 4 == 1, "/..").otherwise("/./")
    path = F.concat(url, climb, F.lit("/..foo//"), page.cast("string"), F.lit(".md"))
    normal = normalize_path(path)
    return table(spark, sf_dir, "pages").select(
        "page_id",
        normal.alias("normal"),
        dirname(normal).alias("folder"),
        basename(normal).alias("base"),
        note_name(normal).alias("name"),
        F.array_join(ancestors(dirname(normal)), "|").alias("ancestors"),
    )


SQL_PATH_FUNCTIONS = f"""WITH paths AS (SELECT page_id, url ||
    CASE page_id % 4 WHEN 0 THEN '/../../../../..' WHEN 1 THEN '/..' ELSE '/./' END
    || '/..foo//' || page_id || '.md' AS p FROM pages),
normals AS (SELECT page_id, nullif(list_reduce(list_prepend('', string_split(p, '/')), lambda acc, x:
    CASE WHEN acc = '!' OR x IN ('', '.') THEN acc
         WHEN x = '..' AND acc = '' THEN '!'
         WHEN x = '..' AND contains(acc, '/') THEN regexp_replace(acc, '/[^/]*$', '')
         WHEN x = '..' THEN ''
         WHEN acc = '' THEN x ELSE acc || '/' || x END), '!') AS normal FROM paths)
SELECT page_id, normal,
  CASE WHEN normal IS NULL THEN NULL ELSE {corpus.sql_folder("normal")} END AS folder,
  {corpus.sql_base("normal")} AS base, {corpus.sql_name("normal")} AS name,
  CASE WHEN normal IS NULL THEN NULL WHEN NOT contains(normal, '/') THEN '' ELSE
    array_to_string(list_transform(range(1, len(string_split(normal, '/'))),
      lambda n: array_to_string(string_split(normal, '/')[1:n], '/')), '|') END AS ancestors
FROM normals"""


def sanitize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe names from page addresses and from whole texts."""
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("origin"),
        F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("dir\\lpt"), F.col("page_id") % 10, F.lit(".x")))
        .otherwise(F.col("url"))
        .alias("raw_name"),
    )
    texts = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("origin"),
        F.col("text").alias("raw_name"),
    )
    return pages.unionByName(texts).select(
        "origin", sanitize_name(F.col("raw_name")).alias("name")
    )


_SQL_SAFE = (
    "trim(left(regexp_replace(CASE WHEN bare = '' AND raw_name <> '' THEN '/' "
    "ELSE regexp_extract(bare, '[^/]*$') END, "
    "'[\\x00-\\x1F\\x7F/\\\\:*?\"<>|]', '_', 'g'), 200), ' .')"
)
# The reserved names at its end.
SQL_SANITIZE = f"""WITH named AS (
  SELECT 'page ' || page_id AS origin, CASE WHEN page_id % 5 = 0
    THEN 'dir\\lpt' || page_id % 10 || '.x' ELSE url END AS raw_name FROM pages
  UNION ALL SELECT 'doc ' || doc_id, text FROM documents),
bared AS (SELECT *, rtrim(replace(raw_name, '\\', '/'), '/') AS bare FROM named),
safe AS (SELECT origin, {_SQL_SAFE} AS cut FROM bared)
SELECT origin, CASE WHEN regexp_matches(upper(regexp_replace(cut, '[.][^.]*$', '')),
  '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') THEN '_' || cut ELSE cut END AS name FROM safe"""


def timestamp_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = timestamp_name(corpus.epoch_ms(F.col("ts")).cast("bigint"))
    suffix = F.when(F.col("event_id") % 2 == 0, name).otherwise(F.concat(F.lit("at "), name))
    return (
        table(spark, sf_dir, "events")
        .select("event_id", suffix.alias("name"))
        .withColumn("stamped", is_timestamp_name(F.col("name")))
    )


def rewrite_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = [("src1", "alpha"), ("alpha/en", "src2/moved"), ("src3", None), ("src2", "beta")]
    return table(spark, sf_dir, "documents").select(
        "doc_id", rewrite_prefix(corpus.doc_path(), moves).alias("path")
    )


_SQL_STEP1 = "CASE WHEN starts_with(p, 'src1/') THEN 'alpha' || substr(p, 5) ELSE p END"
_SQL_STEP2 = "CASE WHEN starts_with(p, 'alpha/en/') THEN 'src2/moved' || substr(p, 9) ELSE p END"
_SQL_STEP3 = "CASE WHEN starts_with(p, 'src3/') THEN NULL ELSE p END"
_SQL_STEP4 = "CASE WHEN starts_with(p, 'src2/') THEN 'beta' || substr(p, 5) ELSE p END"
SQL_REWRITE = f"""WITH {corpus.DOCS}, s1 AS (SELECT doc_id, path AS p FROM docs),
s2 AS (SELECT doc_id, {_SQL_STEP1} AS p FROM s1), s3 AS (SELECT doc_id, {_SQL_STEP2} AS p FROM s2),
s4 AS (SELECT doc_id, {_SQL_STEP3} AS p FROM s3), s5 AS (SELECT doc_id, {_SQL_STEP4} AS p FROM s4)
SELECT doc_id, p AS path FROM s5"""


def add_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label values added as tags; only ids and tags meet the labels, no text does."""
    notes = table(spark, sf_dir, "documents").select("doc_id", corpus.doc_tags().alias("tags"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    good = F.when(F.col("quality") == 1, " good ").otherwise("  ")
    toxic = F.when(F.col("toxic") == 1, "toxic").otherwise("Long")
    tagged = notes.join(labels, "doc_id", "left").withColumn(
        "tags", add_tag(add_tag(F.col("tags"), good), toxic)
    )
    return flat_tags(tagged.select("doc_id", "tags"))


SQL_ADD_TAGS = f"""WITH {corpus.DOCS}, labelled AS (
  SELECT d.doc_id, tags, quality, toxic FROM docs d LEFT JOIN labels l ON d.doc_id = l.doc_id),
good AS (SELECT doc_id, toxic, CASE WHEN quality = 1 THEN list_append(tags, 'good') ELSE tags END AS tags FROM labelled)
SELECT doc_id, array_to_string(CASE WHEN toxic = 1 THEN list_append(tags, 'toxic')
  WHEN list_contains(tags, 'Long') THEN tags ELSE list_append(tags, 'Long') END, '|') AS tags FROM good"""


def _tree(named_only: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = tree.folder_tree(
            notes_of(spark, sf_dir), corpus.explicit_folders(spark, sf_dir), named_only
        )
        return flat_tags(found)

    return run


SQL_FOLDERS = f"""{corpus.NOTES}, named AS (
  SELECT folder AS path FROM notes
  UNION SELECT 'archive/quality_' || quality || '/toxic_' || toxic FROM labels),
folders AS (SELECT DISTINCT array_to_string(parts[1:n], '/') AS path, CAST(n - 1 AS INTEGER) AS depth
  FROM (SELECT string_split(path, '/') AS parts, unnest(range(1, len(string_split(path, '/')) + 1)) AS n
        FROM named WHERE path <> ''))"""

_SQL_FOLDER_COLUMNS = f"{corpus.sql_folder('path')} AS parent, {corpus.sql_base('path')} AS name"


def _sql_tree(where: str) -> str:
    return f"""WITH {SQL_FOLDERS}, shown AS (SELECT * FROM notes WHERE {where})
SELECT f.path AS folder, {corpus.sql_folder("f.path")} AS parent, {corpus.sql_base("f.path")} AS folder_name,
  f.depth, s.path AS note_path, s.name AS note_name, array_to_string(s.tags, '|') AS tags,
  s.mod_time, s.preview
FROM folders f LEFT JOIN shown s ON s.folder = f.path"""


def _folders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return notes_of(spark, sf_dir), corpus.explicit_folders(spark, sf_dir)


QUERIES = {
    "search_body": _search(q="ING The"),
    "search_tag": _search(tag="FR"),
    "search_and": _search(q="DES", tag="fr"),
    "search_all": _search(),
    "batch_search": batch_search,
    "batch_search_short": batch_search_short,
    "batch_search_unspaced": batch_search_unspaced,
    "list_folder": lambda spark, sf: flat_tags(listing.list_notes(notes_of(spark, sf), FOLDER)),
    "list_root_oldest_first": lambda spark, sf: flat_tags(
        listing.list_notes(notes_of(spark, sf), "", "modified-asc")
    ),
    "note_meta": lambda spark, sf: flat_tags(listing.note_meta(notes_of(spark, sf))),
    "note_full": lambda spark, sf: flat_tags(listing.note_full(notes_of(spark, sf))),
    "note_enriched": note_enriched,
    "page_previews": page_previews,
    "get_note": lambda spark, sf: flat_tags(
        listing.get_note(notes_of(spark, sf), FOLDER + "/doc_1.md")
    ),
    "subtree": lambda spark, sf: flat_tags(listing.subtree(notes_of(spark, sf), "src1")),
    "named_notes": lambda spark, sf: flat_tags(
        listing.note_meta(listing.named_notes(notes_of(spark, sf)))
    ),
    "front_matter_parse": front_matter_parse,
    "notes_parsed": notes_parsed,
    "front_matter_render": front_matter_render,
    "export_bodies": export_bodies,
    "verbatim_files": verbatim_files,
    "path_functions": path_functions,
    "sanitize_names": sanitize_names,
    "timestamp_names": timestamp_names,
    "rewrite_prefixes": rewrite_prefixes,
    "add_tags": add_tags,
    "folder_tree": _tree(False),
    "folder_tree_named": _tree(True),
    "folder_nodes": lambda spark, sf: tree.folder_nodes(*_folders(spark, sf)),
    "folder_children": lambda spark, sf: tree.folder_children(*_folders(spark, sf)),
    "folder_preorder": lambda spark, sf: tree.folder_preorder(
        tree.all_folders(*_folders(spark, sf))
    ),
    "all_folders": lambda spark, sf: tree.all_folders(*_folders(spark, sf)),
}

_STAMPED = r"regexp_matches(name, '^\d{4}-\d{2}-\d{2}_\d{6}')"
_FULL = corpus.META + ", content"

ORACLES = {
    "search_body": _sql_notes("contains(lower(content), lower('ING The'))"),
    "search_tag": _sql_notes("list_contains(list_transform(tags, lambda t: lower(t)), 'fr')"),
    "search_and": _sql_notes(
        "contains(lower(content), 'des') AND list_contains(list_transform(tags, lambda t: lower(t)), 'fr')"
    ),
    "search_all": _sql_notes("true"),
    "batch_search": SQL_BATCH_SEARCH,
    "batch_search_short": SQL_BATCH_SEARCH_SHORT,
    "batch_search_unspaced": SQL_BATCH_SEARCH_UNSPACED,
    "list_folder": _sql_notes(f"folder = '{FOLDER}'"),
    "list_root_oldest_first": _sql_notes("folder = ''"),
    "note_meta": _sql_notes("true"),
    "note_full": _sql_notes("true", _FULL),
    "note_enriched": _sql_notes(
        "true",
        f"{corpus.META}, NOT {_STAMPED} AS has_custom_name, {_sql_plain('preview')} AS plain_preview",
    ),
    "page_previews": (
        f"WITH p AS (SELECT 'pages/' || page_id || '.md' AS path, {corpus.sql_preview('html')} AS preview FROM pages) "
        f"SELECT path, true AS has_custom_name, {_sql_plain('preview')} AS plain_preview FROM p"
    ),
    "get_note": _sql_notes(f"path = '{FOLDER}/doc_1.md'", _FULL),
    "subtree": _sql_notes("path = 'src1' OR starts_with(path, 'src1/')"),
    "named_notes": _sql_notes(f"NOT {_STAMPED}"),
    "front_matter_parse": (
        f"WITH {SQL_PARSED} SELECT path, array_to_string(ptags, '|') AS tags, body FROM parsed"
    ),
    "notes_parsed": (
        f"WITH {SQL_PARSED} SELECT path, {corpus.sql_name('path')} AS name, "
        f"array_to_string(ptags, '|') AS tags, {corpus.SQL_MOD_TIME} AS mod_time, "
        f"{corpus.sql_preview('body')} AS preview FROM parsed"
    ),
    "front_matter_render": (
        f"WITH {corpus.DOCS} SELECT path, {corpus.sql_header('tags')} || content AS text FROM docs"
    ),
    "verbatim_files": _SQL_VERBATIM,
    "export_bodies": f"WITH {corpus.DOCS} SELECT path, content AS text FROM docs",
    "path_functions": SQL_PATH_FUNCTIONS,
    "sanitize_names": SQL_SANITIZE,
    "timestamp_names": (
        "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'at ' END || "
        "strftime(ts, '%Y-%m-%d_%H%M%S') AS name, event_id % 2 = 0 AS stamped FROM events"
    ),
    "rewrite_prefixes": SQL_REWRITE,
    "add_tags": SQL_ADD_TAGS,
    "folder_tree": _sql_tree("true"),
    "folder_tree_named": _sql_tree(f"NOT {_STAMPED}"),
    "folder_nodes": f"""WITH {SQL_FOLDERS}, rows AS (SELECT path, {_SQL_FOLDER_COLUMNS}, depth FROM folders)
SELECT r.*, (SELECT count(*) FROM rows c WHERE c.parent = r.path) AS n_children,
  (SELECT count(*) FROM notes n WHERE n.folder = r.path) AS n_notes,
  (SELECT max(mod_time) FROM notes n WHERE n.folder = r.path) AS last_mod_time FROM rows r""",
    "folder_children": f"WITH {SQL_FOLDERS} SELECT path, {_SQL_FOLDER_COLUMNS} FROM folders",
    "folder_preorder": (
        f"WITH {SQL_FOLDERS} SELECT path, {corpus.sql_base('path')} AS name, depth FROM folders"
    ),
    "all_folders": f"WITH {SQL_FOLDERS} SELECT path, {_SQL_FOLDER_COLUMNS}, depth FROM folders",
}
