"""Case-insensitive search over bodies and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators.listing import META, ordered
from marginalia.operators.sorting import sort_once
from marginalia.scratch import Scratch

# Greatest length of the grams by which words that contain a piece of a query are found.
PIECE = 3
# Letters of a word that are cut into grams at a time.
STRETCH = 1 << 14
# The columns by which a word is known.
IDS = ["w1", "w2"]
# So many queries without a tag, of so many letters in all, are tested on every body, as to part the bodies into
# words and to cut the words into grams costs about as much.
SCANNED = 1000
SCANNED_LETTERS = 1 << 18
# Copies of these queries, so that bodies meet them by as many keys and not by one.
LANES = 16


def body_contains(q: str) -> Column:
    """The body contains ``q`` literally, ignoring case. The query is not trimmed."""
    return F.contains(F.lower("content"), F.lower(F.lit(q)))


def has_tag(tag: str) -> Column:
    wanted = F.lower(F.lit(tag))
    return F.exists("tags", lambda t: F.lower(t) == wanted)


def search_notes(
    notes: DataFrame, q: str = "", tag: str = "", limit: int | None = None
) -> DataFrame:
    """Notes matching both operands, newest first; an empty operand matches all.

    Tags are tested before bodies, so a tag search reads no body text it can skip.
    """
    if tag:
        notes = notes.filter(has_tag(tag))
    if q:
        notes = notes.filter(body_contains(q))
    found = notes.select(*META)
    if limit is not None:
        return found.orderBy(F.desc("mod_time"), "path").limit(limit)
    return ordered(found)


def batch_search(notes: DataFrame, queries: DataFrame) -> DataFrame:
    """Every ``(query_id, q, tag)`` against every note, by joins on anchors.

    An anchor is something a matching note must have: the query's tag; else its rarest
    whole word, a word being what stands between two spaces; else each word of the
    corpus that contains the query's longest piece. Those words are found through the
    piece's rarest gram of up to three letters. Words are known by their 128-bit hashes, so joins carry no text, and a text without spaces, which is one
    long word, costs its length. Only candidates are tested with the body. Any number of
    queries takes the same few joins. A query of blanks only, or an empty one, has no anchor
    and is tested on every note, which it mostly matches.

    Queries that have a tag, and up to ``SCANNED`` that have none, are tested as the bodies are read, once for all of them
    (``_scanned``), which costs the same whether few notes match or most do, and writes no candidates.
    """
    scratch = Scratch(notes.sparkSession, "search")
    wanted = scratch.save(
        queries.select(
            "query_id",
            F.lower(F.coalesce("q", F.lit(""))).alias("q"),
            F.lower(F.coalesce("tag", F.lit(""))).alias("tag"),
        )
    )
    # ``sure``: the anchor is all that the query asks for, so that no body is needed.
    tagged = wanted.filter("tag <> ''").select(F.col("tag").alias("anchor"), "query_id", (F.col("q") == "").alias("sure"))
    blank = F.replace("q", F.lit(" "), F.lit("")) == ""
    free = wanted.filter("tag = ''").filter(blank)
    free = free.select(F.lit("").alias("anchor"), "query_id", (F.col("q") == "").alias("sure"))
    worded = wanted.filter("tag = ''").filter(~blank)
    few = _few(worded)
    known = tagged.unionByName(free)
    tested = known.filter("NOT sure").join(wanted.select("query_id", "q"), "query_id")
    tested = tested.select("anchor", F.lit(False).alias("once"), "query_id", "q")
    if few:
        tested = tested.unionByName(worded.select(F.lit("").alias("anchor"), F.lit(True).alias("once"), "query_id", "q"))
    hits = scratch.save(_known_hits(notes, known.filter("sure")))
    out = hits.join(notes.select(*META), "path").select("query_id", *META)
    if not tested.isEmpty():
        out = out.unionByName(_scanned(scratch, notes, tested).select("query_id", *META))
    if not few:
        out = out.unionByName(_by_words(scratch, notes, wanted, worded).select("query_id", *META))
    return sort_once(out, "query_id", F.desc("mod_time"), "path")


def _few(queries: DataFrame) -> bool:
    """Whether every body can be tested with these queries. Those that share a ``query_id`` are found together, by anchors."""
    size = queries.agg(
        F.count("*").alias("n"), F.count_distinct("query_id").alias("ids"), F.sum(F.length("q")).alias("letters")
    ).first()
    return size.n == size.ids and size.n <= SCANNED and (size.letters or 0) <= SCANNED_LETTERS


def _lowered_tags() -> Column:
    return F.array_distinct(F.transform("tags", lambda t: F.lower(t)))


def _known_hits(notes: DataFrame, queries: DataFrame) -> DataFrame:
    """``(path, query_id)`` of queries that ask for no more than their anchor: a tag, or nothing."""
    tags = notes.select("path", F.explode(_lowered_tags()).alias("anchor")).join(queries.filter("anchor <> ''"), "anchor")
    every = notes.select("path", F.lit("").alias("anchor")).join(queries.filter("anchor = ''"), "anchor")
    return tags.select("path", "query_id").unionByName(every.select("path", "query_id"))


def _scanned(scratch: Scratch, notes: DataFrame, queries: DataFrame) -> DataFrame:
    """Notes whose bodies hold what ``queries``, ``(anchor, once, query_id, q)``, ask for; ``anchor`` is a tag or empty.

    Which anchors a path has is found on narrow rows and does not grow with the queries. Bodies meet them by path, in the
    one exchange that also deals them out, as a table of few row groups is read by few tasks, and there they are tested:
    neither a candidate nor its query is ever written. Without ``once`` a note is found for each note of its path that has the anchor.

    Bodies are put into lower case once and compared as bytes, which takes 0.6 times as long as to compare letters.
    """
    key, lanes = ["anchor", "once"], F.explode(F.sequence(F.lit(0), F.lit(LANES - 1)))
    asked = scratch.save(queries.select(*key, "query_id", F.col("q").cast("binary").alias("sought"), lanes.alias("lane")))
    named = notes.filter("path IS NOT NULL")
    blank = F.array(F.lit(""))
    anchors = F.array_union(blank, F.coalesce(_lowered_tags(), blank))
    each = F.transform(anchors, lambda a: F.struct(a.alias("anchor"), F.lit(False).alias("once")))
    each = F.array_append(each, F.struct(F.lit("").alias("anchor"), F.lit(True).alias("once")))
    held = named.select("path", F.explode(each).alias("at")).select("path", "at.*")
    held = held.join(asked.select(*key).distinct(), key, "left_semi").groupBy("path", *key).agg(F.count("*").alias("times"))
    lane = F.pmod(F.xxhash64("path", "content"), F.lit(LANES)).cast("int")
    bodies = named.select(*META, F.lower("content").cast("binary").alias("body"), lane.alias("lane"))
    # Merged even if ``held`` is small, so that the bodies are dealt out.
    found = bodies.join(held.hint("merge"), "path").join(asked, [*key, "lane"]).filter(F.contains("body", F.col("sought")))
    times = F.when(F.col("once"), F.lit(1).cast("bigint")).otherwise(F.col("times"))
    return found.select("query_id", *META, F.explode(F.sequence(F.lit(1).cast("bigint"), times)).alias("_time"))


def _by_words(scratch: Scratch, notes: DataFrame, wanted: DataFrame, worded: DataFrame) -> DataFrame:
    """Notes found by the words of ``worded``, which have no tag, if their bodies hold what is asked for."""
    hits = scratch.save(_word_hits(scratch, notes, worded))
    certain = hits.filter("sure").join(notes.select(*META), "path")
    # Each body is put into lower case once, before it meets its candidates.
    bodies = notes.select(*META, F.lower("content").alias("body"))
    tested = (
        hits.filter("NOT sure").join(wanted, "query_id").join(bodies, "path")
        .filter(F.contains("body", F.col("q")))
    )
    return certain.select("query_id", *META).unionByName(tested.select("query_id", *META))


def _word_hits(scratch: Scratch, notes: DataFrame, worded: DataFrame) -> DataFrame:
    """``(path, query_id, sure)``: the candidates of queries of more than blanks and without a tag."""
    worded = worded.withColumn("pieces", F.split("q", " "))
    last = F.size("pieces") - 1
    inner = F.array_remove(F.slice("pieces", 2, F.greatest(last - 1, F.lit(0))), "")
    longest = F.array_max(
        F.transform("pieces", lambda p, i: F.struct(F.length(p).alias("n"), p.alias("piece"), i.alias("place")))
    )
    worded = worded.select("query_id", F.array_distinct(inner).alias("inner"), longest.alias("at"), last.alias("last"))
    whole = worded.filter(F.size("inner") > 0).select("query_id", F.explode("inner").alias("word"))
    part = worded.filter((F.size("inner") == 0) & (F.col("at.n") > 0)).select(
        "query_id",
        F.col("at.piece").alias("piece"),
        # A piece before a space ends a word, one after a space begins it.
        (F.col("at.place") < F.col("last")).alias("ends"),
        (F.col("at.place") > 0).alias("begins"),
    )

    words = _words(notes)  # parted twice, which costs less than to write all words and read them
    vocabulary = words.groupBy("word").agg(F.count("*").alias("notes")).select(*_ids("word"), "word", "notes")
    vocabulary = scratch.save(vocabulary)
    counted = whole.select("query_id", *_ids("word")).join(vocabulary.select(*IDS, "notes"), IDS, "left")
    rarest = counted.groupBy("query_id").agg(F.min(F.struct(F.coalesce("notes", F.lit(0)).alias("notes"), *IDS)).alias("at"))
    by_word = rarest.select("at.w1", "at.w2", "query_id", F.lit(False).alias("sure"))
    by_piece = _holding(scratch, part, vocabulary)
    anchors = scratch.save(by_word.unionByName(by_piece))
    return words.select("path", *_ids("word")).join(anchors, IDS).select("path", "query_id", "sure").distinct()


def _holding(scratch: Scratch, part: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(w1, w2, query_id, sure)``: the words that hold each query's piece where it asks for it."""
    asked = scratch.save(part)
    lengths = [row.n for row in asked.select(F.least(F.length("piece"), F.lit(PIECE)).alias("n")).distinct().collect()]
    piece = F.col("piece")
    sought = asked.select(
        "query_id", F.explode(F.when(F.length(piece) > PIECE, _grams(piece, PIECE)).otherwise(F.array(piece))).alias("gram")
    )
    sought = scratch.save(sought)
    # Long words are cut into stretches that overlap by less than a gram, to bound what is held at once.
    starts = F.sequence(F.lit(1), F.greatest(F.length("word"), F.lit(1)), F.lit(STRETCH))
    stretches = vocabulary.select(*IDS, "word", F.explode(starts).alias("start"))
    stretch = F.substr("word", F.col("start"), F.lit(STRETCH + PIECE - 1))
    cuts = F.concat(F.array().cast("array<string>"), *[_grams(stretch, n) for n in sorted(lengths)])
    grams = stretches.select(*IDS, F.explode(cuts).alias("gram"))
    held = scratch.save(grams.join(sought.select("gram").distinct(), "gram", "left_semi"))
    counts = held.groupBy("gram").agg(F.count("*").alias("words"))
    fewest = F.min(F.struct(F.coalesce("words", F.lit(0)).alias("words"), "gram"))
    rarest = sought.join(counts, "gram", "left").groupBy("query_id").agg(fewest["gram"].alias("gram"))
    candidates = held.join(rarest, "gram").select("query_id", *IDS).distinct()
    fits = (
        F.contains("word", F.col("piece"))
        & (~F.col("ends") | F.endswith("word", F.col("piece")))
        & (~F.col("begins") | F.startswith("word", F.col("piece")))
    )
    tested = candidates.join(asked, "query_id").join(vocabulary.select(*IDS, "word"), IDS).filter(fits)
    return tested.select(*IDS, "query_id", (~F.col("ends") & ~F.col("begins")).alias("sure"))


def _ids(word: str) -> list[Column]:
    """The 128 bits by which a word is known."""
    return [F.xxhash64(word).alias("w1"), F.xxhash64(F.lit(1), word).alias("w2")]


def _words(notes: DataFrame) -> DataFrame:
    """``(path, word)``: the distinct lower-case words of each note, as spaces part them."""
    words = F.array_distinct(F.split(F.lower("content"), " "))
    return notes.select("path", F.explode(words).alias("word"))


def _grams(text: Column, n: int) -> Column:
    """All distinct pieces of ``n`` letters of ``text``; null stands for none."""

    def cut(letters: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(letters) - n, F.lit(0)))
        return F.transform(starts, lambda i: F.concat(*[F.get(letters, i + k) for k in range(n)]))

    # An array of one binds the letters, which are then parted once and not for every piece.
    return F.array_distinct(F.transform(F.array(F.split(text, "")), cut)[0])
