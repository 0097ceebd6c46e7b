"""Mix sources to target weights with hash thresholds, without sorting documents.

Each document has a hash. Of each source, the mix takes all documents a whole number of
times, and those below a threshold once more. The threshold is found by histograms: words
are summed by source and bucket of hashes, the bucket that crosses the budget is the only one
refined, and at last the few rows of that bucket are told apart one by one. Budgets are
nested: a larger one takes whatever a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import WORD, freed, scratch, text_of

WEIGHTS = (3, 1, 2)
TOTAL = 1.5
MOST = 2.0
HASH_BITS = 60
BUCKET_BITS = 10
#: Rows of a source's boundary bucket from which they are told apart one by one.
FEW = 4096
OUTPUT = ("size", "source_size", "target", "copies", "taken")


def row_hash() -> Column:
    """60 bits of a digest of doc_id and text, so that repeated ids don't hang together."""
    ident = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text_of(F.col("text")))
    return F.conv(F.substring(F.md5(ident), 1, HASH_BITS // 4), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """``target`` for each row of ``sizes`` (source, source_size): shares by weight, stopped at most * source_size.

    Sources take the weights in turn, by code point, null last. What a stopped source leaves is
    shared again by weight, until none is above; that level is found in one step: with sources in
    order of the level at which they stop, the first that doesn't reach its stop fixes it.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    stops = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int")))
    stops = stops.withColumn("stop", most * F.col("source_size")).withColumn("reach", F.col("stop") / F.col("weight"))
    order = W.orderBy("reach", F.col("source").asc_nulls_last())
    so_far = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(0))
    level = (total * F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(so_far), F.lit(0.0))) / F.sum(
        "weight"
    ).over(onward)
    leveled = stops.withColumn("level", level).withColumn("nth", F.row_number().over(order))
    first = F.min(F.when(F.col("level") <= F.col("reach"), F.struct("nth", "level"))).over(everything)
    leveled = leveled.withColumn("level", first["level"])
    target = F.least(F.col("stop"), F.coalesce(F.col("weight") * F.col("level"), F.col("stop")))
    return leveled.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame, tables) -> DataFrame:
    """For each source of ``budgets`` (source, budget) the hash below which rows (source, hash, size) come nearest to it.

    ``rows`` should be a saved table: the first round sums all of it by 2**BUCKET_BITS buckets a
    source, each later round only the rows of each source's boundary bucket.
    """
    same = F.col("r.source").eqNullSafe(F.col("b.source"))
    shift = HASH_BITS
    brackets = tables.save(
        budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    )
    inside = rows
    while True:
        step = min(BUCKET_BITS, shift)
        parent, shift = shift, shift - step
        joined = inside.alias("r").join(brackets.alias("b"), same & (F.shiftright("r.hash", parent) == F.col("b.prefix")))
        sums = (
            joined.groupBy("b.source", "b.budget", "b.before", F.shiftright("r.hash", shift).alias("prefix"))
            .agg(F.sum("r.size").alias("size"), F.count("*").alias("rows"))
        )
        upto = F.sum("size").over(W.partitionBy("source").orderBy("prefix")) + F.col("before")
        sums = sums.withColumn("upto", upto).withColumn("past", F.col("upto") > F.col("budget"))
        # The first bucket that goes past the budget; without one the source is taken whole.
        cross = (
            sums.where("past")
            .groupBy("source", "budget")
            .agg(F.min(F.struct("prefix", (F.col("upto") - F.col("size")).alias("before"), "rows")).alias("at"))
            .select("source", "budget", "at.prefix", "at.before", "at.rows")
        )
        brackets = tables.save(cross)
        most = brackets.agg(F.max("rows")).first()[0] or 0
        if most <= FEW or shift == 0:
            break
    joined = rows.alias("r").join(brackets.alias("b"), same & (F.shiftright("r.hash", shift) == F.col("b.prefix")))
    single = joined.groupBy("b.source", "b.budget", "b.before", "r.hash").agg(F.sum("r.size").alias("size"))
    upto = F.sum("size").over(W.partitionBy("source").orderBy("hash")) + F.col("before")
    taken = single.withColumn("upto", upto).where(2 * F.col("upto") - F.col("size") <= 2 * F.col("budget"))
    last = taken.groupBy("source").agg(F.max("hash").alias("last"))
    floor = F.shiftleft("b.prefix", shift)
    return budgets.alias("w").join(brackets.alias("b"), F.col("w.source").eqNullSafe(F.col("b.source")), "left").join(
        last.alias("l"), F.col("w.source").eqNullSafe(F.col("l.source")), "left"
    ).select(
        "w.source",
        F.when(F.col("w.budget") <= 0, F.lit(0).cast("long"))
        .when(F.col("b.prefix").isNull(), F.lit(1 << HASH_BITS))
        .otherwise(F.coalesce(F.col("l.last") + 1, floor))
        .alias("below"),
    )


def mix_sources(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """All rows of ``docs`` with size (words), source_size, target, copies (times the mix takes the row) and taken.

    ``taken`` = copies * size never exceeds ceil(most) sizes, and each source's sum of it is
    within half a document of its target. Hashes come from doc_id and text alone, so reruns
    agree. Null texts have size 0, a null source is a source of its own (the last), null ids hash
    as empty ones. Rows that agree in id and text have one hash, so a threshold takes all or
    none of them. Columns of the output's names are replaced; other columns pass through.
    Without words all targets are 0. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    tables = scratch(spark, "mix")
    base = freed(docs, *OUTPUT)
    rows = tables.save(base.select("source", row_hash().alias("hash"), word_count(F.col("text")).alias("size")))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, total, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = plan.withColumn("whole", whole)
    plan = tables.save(plan.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")))
    below = tables.save(thresholds(rows, plan.select("source", "budget"), tables))
    p, b = plan.alias("p"), below.alias("b")
    plan = p.join(b, F.col("p.source").eqNullSafe(F.col("b.source")), "left").select(
        F.col("p.source").alias("__mg_source"), "source_size", "target", "whole", "below"
    )
    plan = tables.save(plan)
    given = base.withColumn("size", word_count(F.col("text"))).withColumn("__mg_hash", row_hash())
    given = given.join(plan, F.col("source").eqNullSafe(F.col("__mg_source")), "left")
    extra = (F.col("__mg_hash") < F.col("below")).cast("int")
    return (
        given.withColumn("copies", F.col("whole") + extra)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(*base.columns, *OUTPUT)
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken."""
    return mixed.where("copies > 0").withColumn("__mg_copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("__mg_copy")
