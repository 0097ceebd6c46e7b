"""Remove repeated runs of lines: every window of three consecutive lines stays once in the corpus.

Lines are hashed within their row, windows of three hashes are counted over the whole
corpus, and only windows that occur twice are looked up again. The covered lines of a
document's later occurrences are merged into spans and cut out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import freed, scratch, text_of

WINDOW = 3
OUTPUT = ("removed_spans", "n_lines", "n_removed")


def _lines(text: Column) -> Column:
    return F.split(text_of(text), "\n", -1)


def _windows(docs: DataFrame) -> DataFrame:
    """(doc_id, version, at, w1, w2): one row for each window of each document."""
    hashed = docs.select(
        "doc_id",
        F.xxhash64("text").alias("version"),
        F.transform(_lines(F.col("text")), lambda line: F.xxhash64(line)).alias("h"),
    ).where(F.size("h") >= WINDOW)
    parts = hashed.select("doc_id", "version", F.posexplode("h").alias("at", "h0"), "h").where(
        F.col("at") <= F.size("h") - WINDOW
    )
    h = [F.col("h0"), *[F.col("h")[F.col("at") + i] for i in range(1, WINDOW)]]
    # 128 bits, as a corpus can hold more windows than 64 bits tell apart.
    return parts.select(
        "doc_id", "version", "at", F.xxhash64(*h).alias("w1"), F.xxhash64(F.lit(WINDOW), *reversed(h)).alias("w2")
    )


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, version, covered): the sorted numbers of the lines to cut, of each document that has some."""
    tables = scratch(docs.sparkSession, "lines")
    windows = _windows(docs)
    place = F.struct("doc_id", "version", "at")
    first = (
        windows.groupBy("w1", "w2")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first <> last")
        .select("w1", "w2", F.col("first").alias("first"))
    )
    first = tables.save(first)
    later = windows.join(first, ["w1", "w2"]).where(
        ~F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
        | (F.col("version") != F.col("first.version"))
        | (F.col("at") >= F.col("first.at") + WINDOW)
    )
    covered = F.array_distinct(
        F.flatten(F.transform(F.collect_set("at"), lambda a: F.sequence(a, a + (WINDOW - 1))))
    )
    return later.groupBy("doc_id", "version").agg(F.sort_array(covered).alias("covered"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All rows of ``docs``, their text without repeated windows, with removed_spans, n_lines and n_removed.

    The first occurrence of a window, by doc_id (null first), text hash and line, stays. A
    window that begins within the three lines of its own first occurrence is part of that
    occurrence and no repeat, so of a run of equal lines three stay. The lines covered by all
    other occurrences go. ``removed_spans`` lists them as [start, end) of line numbers from 0,
    merged, ascending; ``n_lines`` counts the lines before.

    Rows that agree in doc_id and text are one document and keep the same lines. A null text
    has no lines (n_lines 0) and stays null; an empty one has one line. Texts of fewer than three
    lines, and any others without repeats, come back unchanged. ``n_chars``, if there, is
    brought up to date. Columns of the output's names are replaced, others pass through.
    """
    base = freed(docs, *OUTPUT)
    cuts = repeated_lines(base).select(
        F.col("doc_id").alias("__mg_id"), F.col("version").alias("__mg_version"), F.col("covered").alias("__mg_cut")
    )
    joined = base.withColumn("__mg_hash", F.xxhash64("text")).join(
        cuts, F.col("doc_id").eqNullSafe(F.col("__mg_id")) & (F.col("__mg_hash") == F.col("__mg_version")), "left"
    )
    lines, cut = F.col("__mg_lines"), F.col("__mg_cut")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), cut)
    text = F.when(cut.isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n")
    )
    starts = F.filter(cut, lambda x, i: (i == 0) | (F.element_at(cut, F.greatest(i, F.lit(1))) < x - 1))
    ends = F.transform(
        F.filter(cut, lambda x, i: (i == F.size(cut) - 1) | (F.try_element_at(cut, i + 2) > x + 1)), lambda x: x + 1
    )
    spans = F.when(cut.isNull(), F.array().cast("array<struct<start:int,end:int>>")).otherwise(
        F.arrays_zip(starts.alias("start"), ends.alias("end")).cast("array<struct<start:int,end:int>>")
    )
    out = (
        joined.withColumn("__mg_lines", _lines(F.col("text")))
        .withColumn("__mg_text", text)
        .withColumn("removed_spans", spans)
        .withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)))
        .withColumn("n_removed", F.when(cut.isNull(), 0).otherwise(F.size(cut)))
    )
    result = []
    for name in base.columns:
        if name.lower() == "text":
            result.append(F.col("__mg_text").alias(name))
        elif name.lower() == "n_chars":
            length = F.when(cut.isNull(), F.col(name)).otherwise(F.length("__mg_text"))
            result.append(length.cast(base.schema[name].dataType).alias(name))
        else:
            result.append(F.col(name))
    return out.select(*result, *OUTPUT)
