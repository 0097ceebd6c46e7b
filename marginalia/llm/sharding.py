"""Shards of near equal bytes by histogram sort.

Texts are sorted by a 64-bit hash of themselves, so that equal texts are neighbours, and the
sorted order is cut into shards. Where to cut is found by counting: each round counts exact
bytes below candidate boundaries over all partitions and refines the probes around each cut,
until every cut is within tolerance. Then the rows move once, straight to their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import freed, partitions, scratch, splitters, text_of

#: How far from its target, in parts of a shard, a cut may be left.
TOLERANCE = 1 / 1024
OUTPUT = ("size", "shard", "slot")


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard_by_bytes(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """All rows of ``docs`` with ``size``, ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard).

    Law: the bytes before each cut between two shards are as near to their equal part as a tolerance of
    1/1024 of a shard allows, or else the group of equal texts that lies across it, as a cut goes to
    the nearer of its sides. Equal texts share a shard; only the rows of a group that is larger than a
    shard are sorted by text and doc_id instead, which keeps the law.

    Null texts count as empty ones. Rows that agree in text and doc_id can't be told apart and
    stay together. Columns named size, shard or slot are replaced, any others pass through.
    An empty table gives an empty result, and fewer rows than shards leave shards empty.
    """
    spark = docs.sparkSession
    tables = scratch(spark, "shards")
    n_slots = max(1, -(-4 * partitions(spark) // n_shards))
    whole = F.xxhash64(text_of(F.col("text")))
    single = F.xxhash64(text_of(F.col("text")), F.col("doc_id"))
    rows = freed(docs, *OUTPUT).withColumn("size", text_size(F.col("text")))

    # The whole job of the counting rounds: one row for each text, not for each copy.
    groups = tables.save(rows.groupBy(whole.alias("key")).agg(F.sum("size").alias("weight")))
    share = (groups.agg(F.sum("weight")).first()[0] or 0) / n_shards
    large = [r.key for r in groups.where(F.col("weight") > share).collect()]  # fewer than n_shards
    key = whole
    if large:
        key = F.when(whole.isin(large), single).otherwise(whole)
        loose = rows.where(whole.isin(large)).groupBy(single.alias("key")).agg(F.sum("size").alias("weight"))
        groups = tables.save(groups.where(~F.col("key").isin(large)).unionByName(loose))
    targets = [share * i for i in range(1, n_shards)]
    cuts = splitters(groups, targets, max(1.0, share * TOLERANCE))

    passed = F.lit(0)
    for cut in cuts:
        passed = passed + (F.col("__mg_key") >= F.lit(cut)).cast("int")
    keyed = rows.withColumn("__mg_key", key).withColumn("shard", passed)
    keyed = keyed.withColumn("__mg_bin", F.pmod(F.xxhash64("__mg_key", "doc_id"), F.lit(n_slots)).cast("int"))

    # A shard's rows are numbered in bins, each after those of the bins before it.
    bins = keyed.groupBy("shard", "__mg_bin").agg(F.count("*").alias("__mg_rows"))
    before = F.sum("__mg_rows").over(W.partitionBy("shard").orderBy("__mg_bin")) - F.col("__mg_rows")
    bins = tables.save(bins.select("shard", "__mg_bin", before.alias("__mg_before")))
    at = F.row_number().over(W.partitionBy("shard", "__mg_bin").orderBy("__mg_key", "doc_id"))
    return (
        keyed.withColumn("__mg_at", at)
        .join(bins, ["shard", "__mg_bin"])
        .withColumn("slot", F.col("__mg_before") + F.col("__mg_at") - 1)
        .select(*rows.columns, "shard", "slot")
    )
