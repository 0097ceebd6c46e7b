from collections import Counter, defaultdict

from cases import none, odd_docs, prose

from pyspark.sql import functions as F

from marginalia.llm.common import splitters
from marginalia.llm.sharding import shard_by_bytes


def check(rows, n):
    slots = defaultdict(list)
    for r in rows:
        assert r.size == (len(r.text.encode()) if r.text else 0) + 1
        assert 0 <= r.shard < n
        slots[r.shard].append(r.slot)
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))
    return [sum(r.size for r in rows if r.shard == s) for s in range(n)]


def test_near_equal_bytes_and_whole_groups(spark):
    texts = [prose(i, 20 + i % 60) for i in range(900)] + [prose(7, 30)] * 60
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = shard_by_bytes(docs, 4).collect()
    loads = check(rows, 4)
    assert len(rows) == 960
    assert max(loads) - min(loads) < 0.02 * sum(loads) / 4 + max(r.size for r in rows)
    shards = defaultdict(set)
    for r in rows:
        shards[r.text].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_a_group_above_a_share_is_dealt(spark):
    docs = spark.createDataFrame([(i, "hot text" if i % 3 else f"text {i}") for i in range(3000)], "doc_id long, text string")
    loads = check(shard_by_bytes(docs, 8).collect(), 8)
    assert max(loads) - min(loads) < 0.03 * sum(loads) / 8


def test_groups_that_fit_stay_whole(spark):
    """Many groups of middle size, each well below a shard: none is split, and each cut is the nearest there is."""
    texts = [prose(i, 30 + 3 * (i % 40)) for i in range(40) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = shard_by_bytes(docs, 8).collect()
    loads = check(rows, 8)
    shards = defaultdict(set)
    for r in rows:
        shards[r.text].add(r.shard)
    assert len(shards) == 40 and all(len(s) == 1 for s in shards.values())
    largest = max(10 * (len(t) + 1) for t in texts)
    for i in range(1, 8):
        assert abs(sum(loads[:i]) - i * sum(loads) / 8) <= largest / 2 + 1
    # A brute-force histogram sort over the same order.
    order = {r.text: r.key for r in docs.select("text", F.xxhash64("text").alias("key")).collect()}
    groups = sorted({(order[t], 10 * (len(t) + 1)) for t in texts})
    sums = [sum(w for _, w in groups[:i]) for i in range(len(groups) + 1)]
    for i in range(1, 8):
        target = i * sum(loads) / 8
        assert abs(sum(loads[:i]) - target) <= max(sum(loads) / 8 / 1024, min(abs(s - target) for s in sums)) + 1


def test_reruns_agree(spark):
    docs = odd_docs(spark, clashing=False).where("doc_id is not null and doc_id <> 2")
    first, second = (sorted(map(tuple, shard_by_bytes(docs.repartition(n), 3).collect()), key=repr) for n in (1, 5))
    assert first == second


def test_odd_rows(spark):
    rows = shard_by_bytes(odd_docs(spark), 3).collect()
    assert len(rows) == 18
    check(rows, 3)
    assert shard_by_bytes(none(spark), 3).collect() == []


def test_splitters(spark):
    weights = {k: 1 + (k * 7) % 5 for k in range(-400, 700, 3)}
    keyed = spark.createDataFrame(list(weights.items()), "key long, weight long")
    total = sum(weights.values())
    for bits in (2, 8):
        targets = [total * i / 7 for i in range(1, 7)]
        for cut, target in zip(splitters(keyed, targets, 3, bits), targets, strict=True):
            assert abs(sum(w for k, w in weights.items() if k < cut) - target) <= 3
    hot = spark.createDataFrame([(5, 100), (6, 1)], "key long, weight long")
    assert splitters(hot, [10.0, 95.0], 0.5) == [5, 6]
    ends = spark.createDataFrame([(-(1 << 63), 1), ((1 << 63) - 1, 1)], "key long, weight long")
    (cut,) = splitters(ends, [1.0], 0)
    assert -(1 << 63) < cut <= (1 << 63) - 1
    assert Counter(splitters(keyed.limit(0), [1.0], 1)) == {0: 1}
