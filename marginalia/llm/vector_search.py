"""Exact top-k inner products with a vector-approximation file.

Every distinct vector is filed as one byte a component: the number of its cell in a grid over
that component's range. Blocks of queries scan blocks of cells for bounds of each inner product;
a vector whose upper bound is below the k-th best lower bound is out. The rest are read
exactly in the order of their upper bounds, the k nearest first, and then only those whose
bound still reaches the k-th exact score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import scratch

CELLS = 64
ROWS_A_BLOCK = 2048
QUERIES_A_BLOCK = 512


def scaled(embedding: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component; null where a component is null or not finite."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(finite, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), -1)


def _bounded(q: pd.DataFrame, c: pd.DataFrame, low: np.ndarray, wide: np.ndarray, k: int) -> pd.DataFrame:
    """Of one block of queries and one of cells: the pairs that can still be among the k best, with their bounds."""
    cell = _matrix(c["cells"]).astype(np.float64)
    n = cell.shape[1]
    vectors = np.array(q["vector"].tolist(), dtype=np.float64).reshape(len(q), n)
    radius = (wide[:n] - 1) / 2
    middle = cell * wide[:n] + low[:n] + radius
    # The last term is more than what doubles can lose.
    slack = np.abs(vectors) @ radius + 1e-12 * (np.abs(vectors) @ np.abs(middle).max(axis=0))
    scores = vectors @ middle.T
    upper, lower = scores + slack[:, None], scores - slack[:, None]
    least = np.partition(lower, len(c) - k, axis=1)[:, len(c) - k] if len(c) > k else np.full(len(q), -np.inf)
    i, j = np.nonzero(upper >= least[:, None])
    return pd.DataFrame(
        {"query": q["class"].to_numpy()[i], "class": c["class"].to_numpy()[j], "upper": upper[i, j], "lower": lower[i, j]}
    )


def top_inner_products(
    vectors: DataFrame, queries: DataFrame, k: int = 20, cells: int = CELLS
) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` best of all rows but its own.

    ``vectors`` and ``queries`` hold vec_id and vector (array<long>); queries are among the
    vectors. Scores are integer inner products (exact within 64 bits); ties go to the smaller
    vec_id. Rows with a null vec_id, vector or component take no part. Only vectors of one length are
    compared. Equal vectors are one class, which lists no more than the k + 1 smallest ids,
    as no further one can be among any query's k best. Rows that repeat a vec_id with the same
    vector count once. A table without queries or vectors gives an empty result.
    """
    spark = vectors.sparkSession
    tables = scratch(spark, "vectors")
    key = [F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(1), "vector").alias("k2")]
    sound = F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda v: v.isNull())
    valid = vectors.where(sound).select("vec_id", "vector", *key)
    # A row number with a limit is cut before the exchange, so a hot vector moves few rows.
    nth = F.row_number().over(W.partitionBy("k1", "k2").orderBy("vec_id"))
    once = valid.groupBy("k1", "k2", "vec_id").agg(F.first("vector").alias("vector"))
    few = once.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    classes = tables.save(
        few.groupBy("k1", "k2").agg(
            F.min("vec_id").alias("first"),
            F.sort_array(F.collect_list("vec_id")).alias("members"),
            F.min_by("vector", "vec_id").alias("vector"),
        ).withColumn("class", F.monotonically_increasing_id())
    )
    # Classes are told apart by 128 bits and numbered once, in the written table.
    named = queries.where(sound).select(F.col("vec_id").alias("query_id"), *key).distinct()
    asked = tables.save(named.join(classes.select("k1", "k2", F.col("class").alias("query")), ["k1", "k2"]).select("query_id", "query"))
    sizes = classes.select("class", "vector", F.size("vector").alias("n"))

    # The grid: for each component its least value and the width of a cell.
    ranges = (
        sizes.select(F.posexplode("vector").alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    ).collect()  # one row for each component
    low, wide = np.zeros(len(ranges)), np.ones(len(ranges))
    for r in ranges:
        low[r.i], wide[r.i] = r.lo, max(1, -(-(r.hi - r.lo + 1) // cells))
    low_sql, wide_sql = F.array(*[F.lit(int(x)) for x in low]), F.array(*[F.lit(int(x)) for x in wide])
    cell = F.transform("vector", lambda x, i: F.floor((x - F.get(low_sql, i)) / F.get(wide_sql, i)))
    packed = F.unhex(F.array_join(F.transform(cell, lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    filed = tables.save(sizes.select("class", "n", packed.alias("cells")))
    asking = sizes.join(asked.select(F.col("query").alias("class")).distinct(), "class")
    asking = tables.save(asking)

    n_blocks = max(1, -(-filed.count() // ROWS_A_BLOCK))
    n_asking = max(1, -(-asking.count() // QUERIES_A_BLOCK))
    pick = lambda n: F.pmod(F.xxhash64("class"), F.lit(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asking.select("class", "vector", "n", pick(n_asking).alias("qb"), span(n_blocks).alias("cb"))
    right = filed.select("class", "cells", "n", pick(n_blocks).alias("cb"), span(n_asking).alias("qb"))
    names = ["n", "qb", "cb"]

    def scan(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return _bounded(q, c, low, wide, k + 2) if len(q) and len(c) else pd.DataFrame(columns=["query", "class", "upper", "lower"])

    paired = (
        left.groupBy(*names)
        .cogroup(right.groupBy(*names))
        .applyInPandas(scan, "query long, class long, upper double, lower double")
    )
    paired = tables.save(paired)
    by_lower = F.row_number().over(W.partitionBy("query").orderBy(F.desc("lower"), "class"))
    least = paired.withColumn("nth", by_lower).where(F.col("nth") <= k + 2)
    least = least.groupBy("query").agg(F.min("lower").alias("least"), F.count("*").alias("found"))
    least = least.select("query", F.when(F.col("found") == k + 2, F.col("least")).alias("least"))
    alive = paired.join(least, "query").where(F.col("least").isNull() | (F.col("upper") >= F.col("least")))
    by_upper = F.row_number().over(W.partitionBy("query").orderBy(F.desc("upper"), "class"))
    alive = tables.save(alive.select("query", "class", "upper", by_upper.alias("nth")))

    exact_side = classes.select("class", "first", "vector")
    query_side = sizes.select(F.col("class").alias("query"), F.col("vector").alias("asked"))
    dot = F.aggregate(F.zip_with("vector", "asked", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x)

    def exactly(pairs: DataFrame) -> DataFrame:
        return pairs.join(query_side, "query").join(exact_side, "class").select("query", "class", "first", dot.alias("score"))

    nearest = tables.save(exactly(alive.where(F.col("nth") <= k + 2).select("query", "class")))
    sure = nearest.groupBy("query").agg(F.min("score").alias("sure"))
    rest = alive.where(F.col("nth") > k + 2).join(sure, "query").where(F.col("upper") >= F.col("sure"))
    scored = nearest.unionByName(exactly(rest.select("query", "class")))
    best = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "first"))
    scored = scored.withColumn("nth", best).where(F.col("nth") <= k + 2).select("query", "class", "score")
    listed = scored.join(classes.select("class", "members"), "class").select("query", "score", F.explode("members").alias("vec_id"))
    # At most (k + 2) * (k + 1) rows for each distinct query vector, of which it keeps k + 1.
    short = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    short = listed.withColumn("nth", short).where(F.col("nth") <= k + 1).groupBy("query").agg(
        F.sort_array(F.collect_list(F.struct("nth", "score", "vec_id"))).alias("best")
    )
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    ranked = asked.join(short, "query").select("query_id", F.posexplode(others).alias("at", "b"))
    return ranked.select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score")
    )
