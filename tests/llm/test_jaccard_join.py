import random
import re

import pytest
from cases import none, odd_docs, prose

from marginalia.llm import jaccard_join
from marginalia.llm.jaccard_join import near_duplicates, one_of_each


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows):
    """{row number: (n, component)} from all pairs."""
    sets = [shingles(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(root(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=repr)


def edited(words, rng, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


def corpus(seed):
    rng = random.Random(seed)
    rows, doc = [], 0
    for group in range(12):
        words = prose(100 * seed + group, rng.randint(8, 90)).split()
        for _ in range(rng.choice([1, 2, 3, 25])):
            rows.append((doc, edited(words, rng, rng.choice([0, 0, 1, 2, 3]))))
            doc += 1
    passage = prose(999, 60)
    rows += [(doc + i, prose(5000 + i, rng.randint(1, 30)) + " " + passage) for i in range(15)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [512, 4])
def test_matches_all_pairs(spark, tmp_path, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    rows = corpus(seed)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    found = near_duplicates(spark.read.parquet(str(tmp_path / "docs"))).drop("key", "root").collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows)


def test_few_tokens_a_part(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BATCH_TOKENS", 300)
    rows = corpus(3)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    found = near_duplicates(spark.read.parquet(str(tmp_path / "docs")), width=5).drop("key", "root").collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows)


def test_a_chain_has_one_component(spark):
    """Each text is near the next only."""
    words = prose(77, 400).split()
    rows = [(i, " ".join(words[12 * i : 12 * i + 120])) for i in range(20)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).drop("key", "root").collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = near_duplicates(docs.coalesce(1)).drop("key", "root").collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows)
    kept = one_of_each(docs.coalesce(1))
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert ids == [1, 12, 14, 14, 3, 4, 5, 6, 8, 9, None, None]
    assert near_duplicates(none(spark)).collect() == [] and one_of_each(none(spark)).collect() == []
