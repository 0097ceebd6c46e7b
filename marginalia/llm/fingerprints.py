"""Document fingerprints by one-permutation MinHash.

Every five-word shingle is hashed once; the top bits of the hash choose a bin and each bin
keeps its least hash. An empty bin borrows the value of another, found by hashing the bin's
number until a filled one is hit (optimal densification), so that two documents with the same
filled bins borrow alike. The four low bits of each bin's value, hashed with the bin, are
stored as one hexadecimal digit, and what digits agree in by chance is taken off the likeness.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import SPACE, freed, partitions, splitters, text_of

BIN_BITS = 7
BINS = 1 << BIN_BITS
DIGITS = "0123456789abcdef"
SHINGLE = 5
#: Borrowed bins are hashed one after another this often, then found in one step.
PROBES = 12
#: Ranges that the rows of one id may be cut into.
PIECES = 1 << 20
OUTPUT = (
    "n_chars",
    "edited_sha256",
    "fingerprint",
    "edited_fingerprint",
    "near_edited",
    "near_next",
)


def _given(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _bin(x: Column) -> Column:
    return F.shiftright(x, 64 - BIN_BITS) + BINS // 2


def shingles(text: Column, width: int = SHINGLE) -> Column:
    """Hashes of all runs of ``width`` lower-cased words; one of all words if there are fewer, none without any."""
    words = F.array_remove(F.split(F.lower(text_of(text)), f"[{SPACE}]+"), "")

    def runs(h: Column) -> Column:
        each = F.transform(
            F.sequence(F.lit(1), F.size(h) - width + 1),
            lambda i: F.xxhash64(*[F.element_at(h, (i + j).cast("int")) for j in range(width)]),
        )
        short = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(h) >= width, each).otherwise(short)

    return _given(F.transform(words, lambda w: F.xxhash64(w)), runs)


def fingerprint(text: Column) -> Column:
    """One hexadecimal digit for each of 128 bins; an empty string for a text without words."""

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.element_at(s, F.greatest(i, F.lit(1))))))

    def digits(f: Column) -> Column:
        gap = lambda n: F.array_repeat(F.lit(None).cast("long"), n.cast("int"))
        before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(_bin(F.element_at(f, F.greatest(i, F.lit(1)))))
        spread = F.transform(f, lambda x, i: F.concat(gap(_bin(x) - before(i) - 1), F.array(x)))
        bins = F.concat(F.flatten(spread), gap(BINS - 1 - _bin(F.element_at(f, -1))))

        def fill(d: Column) -> Column:
            def value(own: Column, j: Column) -> Column:
                tries = [F.get(d, F.pmod(F.xxhash64(j, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(PROBES)]
                order = F.transform(f, lambda x: F.struct(F.xxhash64(j, _bin(x)).alias("o"), x.alias("x")))
                # Hashed with the bin's number, so that bins that hold one value don't agree by chance together.
                return F.xxhash64(F.coalesce(own, *tries, F.array_min(order)["x"]), j)

            digit = lambda v: F.substr(F.lit(DIGITS), (v.bitwiseAND(F.lit(15)) + 1).cast("int"), F.lit(1))
            return F.array_join(F.transform(F.transform(d, value), digit), "")

        return F.when(F.size(f) == 0, F.lit("")).otherwise(_given(bins, fill))

    return _given(_given(F.sort_array(shingles(text)), firsts), digits)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, 0 to 1, corrected for digits that agree by chance.

    Two texts without words are alike (1); one with and one without words are not (0).
    """
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda e: e)) / BINS
    chance = 1 / len(DIGITS)
    return (
        F.when((a == "") & (b == ""), 1.0)
        .when((a == "") | (b == ""), 0.0)
        .otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))
    )


def _bucket(doc_id: Column, cuts: list[int], stride: int = 128) -> Column:
    """How many of the sorted ``cuts`` are at most ``doc_id`` (null: none)."""
    coarse = F.lit(0)
    for cut in cuts[stride - 1 :: stride]:
        coarse = coarse + (doc_id >= F.lit(cut)).cast("int")
    fine = F.slice(F.array(*[F.lit(c) for c in cuts]), coarse * stride + 1, F.lit(stride))
    return F.coalesce(coarse * stride + F.size(F.filter(fine, lambda c: c <= doc_id)), F.lit(0))


def _hot_ids(docs: DataFrame, cuts: list[int], share: float) -> dict[int | None, int]:
    """The ids, null among them, of more than twice ``share`` rows, with how many ranges their rows are worth.

    Only ids of ranges that are too full are counted one by one; no more than rows over ``share`` can be hot.
    """
    place, most = _bucket(F.col("doc_id"), cuts), 2 * share
    full = docs.groupBy(place.alias("place")).count().where(F.col("count") > most).collect()  # a row a range
    if not full:
        return {}
    ids = docs.where(place.isin([r.place for r in full])).groupBy(F.col("doc_id").cast("long").alias("key")).count()
    return {r.key: min(PIECES, math.ceil(r["count"] / share)) for r in ids.where(F.col("count") > most).collect()}


def _range(doc_id: Column, hash_: Column, cuts: list[int], hot: dict[int | None, int]) -> Column:
    """The range of a row, in the order of (doc_id, hash), null first; rows of a hot id are cut by their hash."""
    own = {key + step for key in hot if key is not None for step in (0, 1) if key + step < 1 << 63}
    cuts = sorted({*cuts, *own})
    place = F.when(doc_id.isNull(), -1).otherwise(_bucket(doc_id, cuts)) if None in hot else _bucket(doc_id, cuts)
    pieces = F.lit(1)
    for key, n in hot.items():
        pieces = F.when(doc_id.eqNullSafe(F.lit(key)), n).otherwise(pieces)
    piece = F.least(F.floor((hash_.cast("double") / 2.0**64 + 0.5) * pieces), pieces - 1)
    return place.cast("long") * PIECES + (piece if hot else 0)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` with their fingerprint, that of their edited text, and the likeness to it and to the next text.

    The next document is the one that follows by doc_id (null first, then equal ids by text
    hash; after the last comes the first). The edited text is the document with its last
    floor(n_chars / 2) code points replaced by the first as many (or all) of the next. Null
    texts count as empty. A single document is its own next. Rows that agree in id and text
    follow one another. Columns of the output's names are replaced, others pass through.

    Texts cross the network once, dealt by ranges of doc_id with equal row counts; each
    range also gets a copy of the first document of the next, so no range waits for another.
    An id, or null, that more rows have than two ranges hold is cut into ranges by text hash.
    """
    spark = docs.sparkSession
    base = freed(docs, *OUTPUT)
    wanted = partitions(spark)
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("key"), F.lit(1).alias("weight"))
    n = ids.count()
    bits = max(2, 17 - wanted.bit_length())
    cuts = splitters(ids, [n * i / wanted for i in range(1, wanted)], max(1.0, n / wanted / 8), bits) if n else []
    cuts = sorted(set(cuts)) or [0]
    rows = base.withColumn("__mg_hash", F.xxhash64(text_of(F.col("text"))))
    total = docs.count()
    hot = _hot_ids(docs, cuts, max(1.0, total / wanted))
    rows = rows.withColumn("__mg_range", _range(F.col("doc_id"), F.col("__mg_hash"), cuts, hot))

    # One row for each range: its first document is copied to the end of the range before.
    firsts = rows.groupBy("__mg_range").agg(F.min(F.struct("doc_id", "__mg_hash")))
    ahead = sorted(((r[0], *r[1]) for r in firsts.collect()), key=lambda r: r[0])
    copies = [(doc, hash_, ahead[i - 1][0]) for i, (_, doc, hash_) in enumerate(ahead)]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    copies = spark.createDataFrame(copies, f"__mg_first {id_type}, __mg_first_hash long, __mg_to long")
    is_first = F.col("doc_id").eqNullSafe(F.col("__mg_first")) & (F.col("__mg_hash") == F.col("__mg_first_hash"))
    # At most one row for each range of doc_ids.
    rows = rows.withColumn("fingerprint", fingerprint(F.col("text"))).join(F.broadcast(copies), is_first, "left")
    own = F.struct(F.lit(False).alias("copy"), F.col("__mg_range").alias("range"))
    copied = F.struct(F.lit(True).alias("copy"), F.col("__mg_to").alias("range"))
    places = F.when(F.col("__mg_to").isNull(), F.array(own)).otherwise(F.array(own, copied))
    rows = rows.withColumn("__mg_place", F.explode(places)).drop("__mg_range", "__mg_first", "__mg_first_hash", "__mg_to")
    following = W.partitionBy("__mg_place.range").orderBy("__mg_place.copy", "doc_id", "__mg_hash")
    after = F.lead(F.struct(text_of(F.col("text")).alias("text"), "fingerprint")).over(following)
    rows = rows.withColumn("__mg_next", after).where("not __mg_place.copy")

    text = text_of(F.col("text"))
    half = F.floor(F.length(text) / 2).cast("int")
    edited = F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(F.col("__mg_next.text"), F.lit(1), half))
    rows = rows.withColumn("n_chars", F.length(text).cast("long")).withColumn("__mg_edited", edited)
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("__mg_edited"), 256))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("__mg_edited")))
    rows = rows.withColumn("near_edited", likeness(F.col("fingerprint"), F.col("edited_fingerprint")))
    rows = rows.withColumn("near_next", likeness(F.col("fingerprint"), F.col("__mg_next.fingerprint")))
    return rows.select(*base.columns, *OUTPUT)
