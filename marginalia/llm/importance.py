"""Importance resampling towards a target: hashed word runs, weighed by how much likelier the target has them.

1. A first pass finds the frequent words of the corpus (and, for runs of two words and more, its
   frequent pairs). A task keeps bounded counts, which fall by the least of those it has to give up,
   so every word above total / ``HEAD`` is found. The head is broadcast: at most ``HEAD`` words and as
   many pairs of at most ``HEAD_BYTES`` each, with the exact CRC states of their bytes.
2. A run's CRC goes on from the state of its first word or pair. Words and pairs that are not in
   the head, the tail, take the CRC of their own bytes, so the totals of the buckets are exact
   whatever the head holds: the head saves hashing and decides nothing.
3. Every document is weighed by its buckets' gains, gets Gumbel noise from its doc_id, and the
   highest scores are drawn.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.byte_words import bytes_of, numbered, word_lists, word_table
from marginalia.llm.common import freed, scratch, tidy

#: Frequent words, and frequent pairs, that are broadcast.
HEAD = 1 << 14
HEAD_BYTES = 64
#: Words are runs of letters, digits and all that is not ASCII.
WORDS = word_table("".join(chr(i) for i in range(128) if not chr(i).isalnum()))
OUTPUT = ("n_features", "weight", "score", "rank")


class Words(dict):
    """CRC states of the head's words; of any other word, its own CRC."""

    def __missing__(self, word: bytes) -> int:
        return zlib.crc32(word)


class Pairs(dict):
    """CRC states of the head's pairs; of any other pair, its own CRC."""

    def __missing__(self, pair: tuple[bytes, bytes]) -> int:
        return zlib.crc32(b" " + pair[1], zlib.crc32(pair[0]))


def frequent(counts: Counter, head: int) -> Counter:
    """At most ``head`` of ``counts``, less the greatest count that is given up."""
    kept = counts.most_common(head + 1)
    less = kept[head][1] if len(kept) > head else 0
    return Counter({x: n - less for x, n in kept if n > less})


def features(text: bytes | None, width: int, words: Words, pairs: Pairs) -> Iterator[np.ndarray]:
    """CRCs of all runs of 1 to ``width`` words of a text, piece by piece."""
    before: list[bytes] = []
    for piece in word_lists(text, WORDS):
        run = before + piece
        states = list(map(words.__getitem__, run))
        yield np.array(states[len(before) :], dtype=np.int64)
        for n in range(2, width + 1):
            if n == 2:
                states = list(map(pairs.__getitem__, zip(run, run[1:], strict=False)))
            else:
                states = [zlib.crc32(b" " + word, state) for state, word in zip(states, run[n - 1 :], strict=False)]
            # Runs that end in the words before have been seen.
            yield np.array(states[max(0, len(before) - n + 1) :], dtype=np.int64)
        before = run[len(run) - width + 1 :] if width > 1 else []


def find_head(texts: DataFrame, width: int, head: int = HEAD) -> tuple[Words, Pairs]:
    """The most frequent words and pairs of ``texts`` (text), with their CRC states."""

    def count(batches):
        import pyarrow as pa

        found = [Counter() for _ in range(min(width, 2))]
        for batch in batches:
            for text in bytes_of(batch.column(0)):
                for words in word_lists(text, WORDS):
                    if max(map(len, words), default=0) > HEAD_BYTES:
                        words = [word for word in words if len(word) <= HEAD_BYTES]
                    found[0].update(words)
                    if width > 1:
                        found[1].update(zip(words, words[1:], strict=False))
                    for i, counts in enumerate(found):
                        if len(counts) > 4 * head:
                            found[i] = frequent(counts, head)
        rows = [
            (x if i else (x,), n)
            for i, counts in enumerate(found)
            for x, n in frequent(counts, head).items()
            if (len(x) if not i else len(x[0]) + len(x[1])) <= HEAD_BYTES
        ]
        tidy()
        yield pa.RecordBatch.from_arrays(
            [pa.array([list(x) for x, _ in rows], pa.list_(pa.binary())), pa.array([n for _, n in rows], pa.int64())],
            names=["words", "n"],
        )

    counted = texts.select("text").mapInArrow(count, "words array<binary>, n long").groupBy("words").agg(F.sum("n").alias("n"))
    counted = scratch(texts.sparkSession, "head").save(counted.withColumn("level", F.floor(8 * F.log2("n")).cast("int")))
    top = []
    for size in range(1, min(width, 2) + 1):
        rows = counted.where(F.size("words") == size)
        # All of the highest levels of frequency that fit; a level is a few hundred at most.
        levels = sorted(((r.level, r.n) for r in rows.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True)
        fit = [level for i, (level, _) in enumerate(levels) if sum(n for _, n in levels[: i + 1]) <= head]
        top.append([tuple(map(bytes, r.words)) for r in rows.where(F.col("level") >= fit[-1]).collect()] if fit else [])
    words = Words({x[0]: zlib.crc32(x[0]) for x in top[0]})
    pairs = Pairs({x: zlib.crc32(b" ".join(x)) for x in top[1]} if width > 1 else {})
    return words, pairs


def bucket_totals(texts: DataFrame, head: Broadcast, width: int, buckets: int) -> list[int]:
    """How many runs of ``texts`` (text) fall in each bucket."""

    def count(batches):
        import pyarrow as pa

        words, pairs = head.value
        totals = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text in bytes_of(batch.column(0)):
                for crcs in features(text, width, words, pairs):
                    totals += np.bincount(crcs % buckets, minlength=buckets)
        tidy()
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(totals[some])], names=["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = [0] * buckets
    for r in rows:  # one for each bucket
        out[r.bucket] = r.n
    return out


@dataclass
class Weigher:
    """What weighs a text: the head, and the gain of each bucket."""

    head: Broadcast
    gains: list[int]
    width: int


def fit_importance(docs: DataFrame, target: DataFrame, width: int = 1, buckets: int = 10_000, head: int = HEAD) -> Weigher:
    """Weigh buckets by all of ``docs`` (text) and all of ``target`` (text).

    With S runs in ``docs``, s of them in a bucket, and T and t in ``target``, a bucket's gain is
    floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))).
    """
    known = docs.sparkSession.sparkContext.broadcast(find_head(docs, width, head))
    own, theirs = (bucket_totals(texts, known, width, buckets) for texts in (docs, target))
    all_own, all_theirs = float(sum(own) + buckets), float(sum(theirs) + buckets)
    gains = [math.floor(1000 * math.log((t + 1.0) * all_own / ((s + 1.0) * all_theirs))) for s, t in zip(own, theirs, strict=True)]
    return Weigher(known, gains, width)


def noise(doc_id: Column, seed: int) -> Column:
    """1000 times Gumbel noise that depends on the seed and the id; a null id counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weigh_documents(docs: DataFrame, weigher: Weigher, seed: int = 2024) -> DataFrame:
    """``docs`` (doc_id, text) with n_features, weight and score. A null text has no features and weight 0."""
    head, width = weigher.head, weigher.width
    gains = docs.sparkSession.sparkContext.broadcast(np.array(weigher.gains, dtype=np.int64))

    @F.arrow_udf("n_features long, weight long")
    def weigh(column):
        import pyarrow as pa

        words, pairs = head.value
        counts, weights = [], []
        for text in bytes_of(column):
            n = weight = 0
            for crcs in features(text, width, words, pairs):
                n += len(crcs)
                weight += int(gains.value[crcs % len(gains.value)].sum())
            counts.append(n)
            weights.append(weight)
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(weights, pa.int64())], names=["n_features", "weight"])

    out = freed(docs, *OUTPUT).withColumn("__mg_weight", weigh("text"))
    out = out.withColumns({"n_features": F.col("__mg_weight.n_features"), "weight": F.col("__mg_weight.weight")})
    return out.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).drop("__mg_weight")


def draw(weighed: DataFrame, percent: int = 10, least_words: int = 20, width: int = 1) -> DataFrame:
    """``weighed`` with rank: 1, 2, 3.. for the rows drawn, null for the others.

    Of the N rows with at least ``least_words`` words, floor(percent N / 100) are drawn by highest
    score, then least doc_id (null first). Rows that agree in both are ranked one after the other.
    """
    tables = scratch(weighed.sparkSession, "draw")
    saved = tables.save(weighed)
    # The runs of a text of at least `least_words` words.
    enough = F.col("n_features") >= sum(max(0, least_words - n) for n in range(width))
    placed = numbered(saved.where(enough), [F.desc("score"), F.col("doc_id").asc_nulls_first()], "__mg_place", tables)
    drawn = saved.where(enough).count() * percent // 100
    placed = placed.withColumn("rank", F.when(F.col("__mg_place") < drawn, F.col("__mg_place") + 1))
    return placed.drop("__mg_place").unionByName(saved.where(~enough).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, width: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) that are drawn towards ``target`` (text), whole, with their figures.

    Words are runs of letters, digits and non-ASCII, A-Z lower-cased; features are runs of 1 to
    ``width`` of them. Null and empty texts have no features. Repeated rows are weighed and
    drawn as rows of their own. Columns of the output's names are replaced, others pass through.
    An empty corpus gives an empty draw; with an empty target all buckets weigh by the corpus alone.
    """
    weigher = fit_importance(docs, target, width, buckets)
    return draw(weigh_documents(docs, weigher, seed), percent, least_words, width).where("rank is not null")
