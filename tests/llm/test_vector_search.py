import random

import pytest
from pyspark.sql import functions as F

from marginalia.llm import vector_search
from marginalia.llm.vector_search import scaled, top_inner_products


def brute(rows, k):
    out = []
    for q, v in rows:
        if q % 20:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def found(spark, rows, k=20, **options):
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    return sorted(map(tuple, top_inner_products(df, df.where("vec_id % 20 = 0"), k, **options).collect()))


def test_exact_over_blocks_with_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "ROWS_A_BLOCK", 64)
    monkeypatch.setattr(vector_search, "QUERIES_A_BLOCK", 4)
    rng = random.Random(3)
    rows = [(i, [rng.randint(-9, 9) for _ in range(6)]) for i in range(400)]
    rows += [(400 + i, rows[40][1]) for i in range(70)] + [(500 + i, [1, 0, 0, 0, 0, 0]) for i in range(30)]
    for cells in (64, 3):
        assert found(spark, rows, cells=cells) == brute(rows, 20)


def test_odd_rows(spark):
    rows = [(0, [1, 2]), (20, [1, 2]), (1, [3, -4]), (2, [5]), (40, [7]), (60, []), (61, []), (80, [10**6, -(10**6)])]
    assert found(spark, rows) == brute(rows, 20)
    assert found(spark, rows, 1) == brute(rows, 1)
    odd = [*rows, (100, None), (120, [None, 1]), (None, [1, 2]), (0, [1, 2])]
    assert found(spark, odd) == brute(rows, 20)
    assert found(spark, rows[:1]) == [] and found(spark, []) == []


@pytest.mark.parametrize("value", [None, float("nan"), float("inf")])
def test_scaled(spark, value):
    df = spark.createDataFrame([([0.5, -0.01, 1.0],), ([0.5, value],), (None,), ([],)], "e array<float>")
    assert [r[0] for r in df.select(scaled(F.col("e"))).collect()] == [[32, -1, 64], None, None, []]


def test_clashing_columns_change_nothing(spark):
    rows = [(i, [i % 7, 3 - i % 5, i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    clashing = ["class", "k1", "k2", "n", "qb", "cb", "cells", "nth", "query", "query_id", "score", "first", "members", "lower", "upper"]
    more = df.select("*", *[F.lit("x").alias(name) for name in clashing])
    got = top_inner_products(more, more.where("vec_id % 20 = 0"), 5).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5)


def test_vectors_that_share_64_bits_are_told_apart(spark, monkeypatch):
    rows = [(i, [i % 11, i % 13]) for i in range(80)]
    plain = F.xxhash64

    def clashing(*columns):
        return F.lit(7).cast("long") if len(columns) == 1 and str(columns[0]) == "vector" else plain(*columns)

    monkeypatch.setattr(vector_search.F, "xxhash64", clashing)
    assert found(spark, rows, 5) == brute(rows, 5)
