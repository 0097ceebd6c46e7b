"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.archives import archive_pages
from marginalia.llm.common import table, text_of
from marginalia.llm.conversation_trie import conversation_trie
from marginalia.llm.fingerprints import fingerprint_documents
from marginalia.llm.importance import draw, fit_importance, weigh_documents
from marginalia.llm.jaccard_join import near_duplicates
from marginalia.llm.language_id import fit_languages, identify_languages, remainder
from marginalia.llm.line_dedup import dedup_lines
from marginalia.llm.mixing import mix_sources
from marginalia.llm.packing import pack_documents
from marginalia.llm.sharding import shard_by_bytes
from marginalia.llm.simhash import simhash_duplicates
from marginalia.llm.toxicity import fit_toxicity, score_toxicity, to_learn_from
from marginalia.llm.vector_search import scaled, top_inner_products

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


@query(
    "op1_line_dedup",
    r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
), windows AS (
  SELECT doc_id, pos, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), placed AS (
  SELECT doc_id, pos, first_value(doc_id) OVER w AS first_doc, first_value(pos) OVER w AS first_pos
  FROM windows WHERE c IS NOT NULL
  WINDOW w AS (PARTITION BY a, b, c ORDER BY doc_id, pos)
), cut AS (
  SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM placed
  WHERE doc_id <> first_doc OR pos >= first_pos + 3
), marked AS (
  SELECT l.doc_id, l.pos, line, c.pos IS NOT NULL AS gone,
         c.pos IS NOT NULL AND lag(c.pos) OVER (PARTITION BY l.doc_id ORDER BY l.pos) IS NULL AS opens
  FROM lines l LEFT JOIN cut c ON c.doc_id = l.doc_id AND c.pos = l.pos
), spanned AS (
  SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM marked
), spans AS (
  SELECT doc_id, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS removed
  FROM (SELECT doc_id, span, min(pos) AS lo, max(pos) + 1 AS hi FROM spanned WHERE gone GROUP BY ALL)
  GROUP BY doc_id
)
SELECT m.doc_id, coalesce(string_agg(line, chr(10) ORDER BY m.pos) FILTER (NOT gone), '') AS text,
       count(*)::INT AS n_lines, count(*) FILTER (gone)::INT AS n_removed, coalesce(max(removed), '') AS removed
FROM marked m LEFT JOIN spans s ON s.doc_id = m.doc_id GROUP BY m.doc_id
""",
)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text without repeated three-line windows, and the line spans that went."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform("removed_spans", lambda s: F.concat_ws("-", s["start"], s["end"]))
    return out.select("doc_id", "text", "n_lines", "n_removed", F.array_join(spans, ",").alias("removed"))


@query("op2_shard_by_bytes")
def op2_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards of near equal bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(text_of(F.col("text"))))
    return shard_by_bytes(docs, 8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op3_fingerprints")
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-permutation MinHash fingerprints of every document and of its edited text."""
    return fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query("op4_language")
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from two thirds of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", remainder(F.col("doc_id"), 3) == 1)
    identifier = fit_languages(docs.where("not held_out"))
    return identify_languages(docs.drop("lang"), identifier).drop("text")


@query(
    "op5_top_inner_products",
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS vector
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.vector, c.vector)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.vector) = len(q.vector)
  WHERE q.vec_id % 20 = 0
)
SELECT * FROM (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
  FROM scored
) WHERE rank <= 20
""",
)
def op5_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every 20th vector with all others."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", scaled(F.col("embedding")).alias("vector"))
    return top_inner_products(vectors, vectors.where("vec_id % 20 = 0"), 20)


@query(
    "op6_near_duplicates",
    r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT r.doc_id, coalesce(max(n), 0)::INT AS n_shingles, min(other) AS component_id
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
""",
)
def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("key", "root")


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from four fifths of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = fit_toxicity(docs, to_learn_from(table(spark, sf_dir, "labels")))
    docs = docs.withColumn("held_out", remainder(F.col("doc_id"), 5) == 0)
    return score_toxicity(docs, scorer).drop("text")


@query(
    "op8_mix_sources",
    r"""
WITH rows AS (
  SELECT doc_id, source,
         ('0x' || md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, ''))[:15])::BIGINT AS hash,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source
), weighed AS (
  SELECT *, list_extract([3.0, 1.0, 2.0]::DOUBLE[], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1) AS weight
  FROM sources
), reached AS (
  SELECT *, 2.0::DOUBLE * source_size AS stop, 2.0::DOUBLE * source_size / weight AS reach FROM weighed
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(stop) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER w AS nth
  FROM reached WINDOW w AS (ORDER BY reach, source NULLS LAST)
), targets AS (
  SELECT source, source_size,
         least(stop, coalesce(weight * (min(CASE WHEN level <= reach THEN {'nth': nth, 'level': level} END) OVER ()).level, stop)) AS target
  FROM levels
), plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets
), summed AS (
  SELECT r.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS budget,
         sum(size) OVER (PARTITION BY r.source ORDER BY hash) AS upto,
         sum(size) OVER (PARTITION BY r.source, hash) AS tied
  FROM rows r JOIN plans p ON p.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN budget > 0 AND 2 * upto - tied <= 2 * budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed
""",
)
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with how many words of each the mix takes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op9_archive_pages",
    """
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), best AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM best
""",
)
def op9_archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page through ARC archives, their conversion to WARC, and back."""
    out = archive_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def word_tokenizer() -> str:
    """Where the vocabulary file of the public word tokenizer is."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op10_pack_documents")
def op10_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), word_tokenizer(), 4096)


@query("op11_simhash")
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash fingerprint and its component of near duplicates."""
    return simhash_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


#: Of a list of bytes, the unsigned CRC-32, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {}),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""


@query(
    "op12_conversation_trie",
    f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS nth,
         {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS turn
  FROM conversations WHERE conv_id IS NOT NULL
), sizes AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base,
         {CRC32.format("list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)")} % 9 AS h
  FROM turns GROUP BY conv_id
), plan AS (
  SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS taken FROM sizes c LEFT JOIN sizes b ON b.conv_id = c.base
), rebuilt AS (
  SELECT p.conv_id, nth, turn FROM plan p JOIN turns t ON t.conv_id = p.base AND nth < taken
  UNION ALL SELECT p.conv_id, nth - h + taken, turn FROM plan p JOIN turns t ON t.conv_id = p.conv_id AND nth >= h
), paths AS (
  SELECT s.conv_id, coalesce(list(turn ORDER BY nth) FILTER (nth IS NOT NULL), []) AS path
  FROM sizes s LEFT JOIN rebuilt r ON r.conv_id = s.conv_id GROUP BY s.conv_id
), members AS (
  SELECT conv_id, path, unnest(range(len(path) + 1)) AS depth FROM paths
), nodes AS (
  SELECT depth, path[1:depth] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * coalesce(octet_length(encode(path[1:depth][depth].text)), 0) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = depth), '')) AS ends_sha256
  FROM members GROUP BY depth, prefix
), families AS (
  SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n
  LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
), counted AS (
  SELECT n.*, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.prefix[1:n.depth] = n.prefix) AS n_children
  FROM families n
)
SELECT n.conv_id, n.depth, n.parent_conv_id, n.n_convs, n.n_children, count(*) FILTER (d.n_children = 0) AS n_leaves,
       sum(d.saved)::BIGINT AS saved_tokens, n.ends_sha256
FROM counted n JOIN counted d ON d.depth >= n.depth AND d.prefix[1:n.depth] = n.prefix GROUP BY ALL
""",
)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all conversations, each rebuilt on the start of its group."""
    return conversation_trie(table(spark, sf_dir, "conversations"), group=5).drop("n_bytes")


@query(
    "op13_importance",
    rf"""
WITH texts AS (
  SELECT row_number() OVER () AS place, doc_id, text FROM (SELECT doc_id, text FROM documents)
), cut AS (
  SELECT 0 AS side, place, text FROM texts UNION ALL SELECT 1, NULL, text FROM benchmark
), words AS (
  SELECT side, place, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM cut
), counted AS (
  SELECT side, place, word, count(*) AS n FROM words GROUP BY ALL
), hashed AS (
  SELECT word, {CRC32.format("list_transform(range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::BIGINT)")} % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM counted)
), runs AS (
  SELECT side, place, bucket, n FROM counted JOIN hashed USING (word)
), totals AS (
  SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM runs GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (coalesce(sum(s) OVER (), 0) + 10000)::DOUBLE)
                                 / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce(sum(t) OVER (), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM totals
), weighed AS (
  SELECT place, sum(n) AS n_features, sum(n * gain) AS weight FROM runs JOIN gains USING (bucket) WHERE side = 0 GROUP BY place
), scored AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln(((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[:8])::BIGINT) + 0.5::DOUBLE)
                                                    / 4294967296::DOUBLE))))::BIGINT AS score
  FROM texts LEFT JOIN weighed USING (place)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place,
         count(*) FILTER (n_features >= 20) OVER () AS enough
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= enough * 10 // 100 THEN place END AS rank FROM ranked
""",
)
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed towards the benchmark, and the tenth that is drawn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weigher = fit_importance(docs, table(spark, sf_dir, "benchmark").select("text"))
    return draw(weigh_documents(docs, weigher).drop("text"))
