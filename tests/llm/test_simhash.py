import random
import re

import numpy as np
from cases import none, odd_docs, prose
from xxhash import xxh64_intdigest

from marginalia.llm import byte_words
from marginalia.llm.common import scratch
from marginalia.llm.simhash import Forest, fingerprint_components, simhash, simhash_duplicates, split


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(run.encode(), 42) for run in runs]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def near(a, b):
    return (a ^ b).bit_count() <= 2


def brute_components(prints):
    """The least position that each fingerprint reaches."""
    least, changed = list(range(len(prints))), True
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if near(prints[i], prints[j])]
    while changed:
        changed = False
        for i, j in pairs:
            low = min(least[i], least[j])
            changed |= least[i] != low or least[j] != low
            least[i] = least[j] = low
    return least


def clusters(seed, centres, members, flips):
    """Distinct fingerprints around centres, each some flips away from one before."""
    rng, out = random.Random(seed), []
    for _ in range(centres):
        group = [rng.getrandbits(64)]
        for _ in range(members - 1):
            value = rng.choice(group)
            for _ in range(rng.randint(1, flips)):
                value ^= 1 << rng.randrange(64)
            group.append(value)
        out.append(sorted(set(group)))
    return out


def test_fingerprints_in_pieces(monkeypatch):
    rng = random.Random(3)
    texts = [None, "", " \n", "One", "one TWO", "a b c", "É é Z z\x0b中 文"]
    texts += ["".join("".join(rng.choice("abÉ中") for _ in range(rng.choice([1, 4, 90]))) + rng.choice(" \t\n") for _ in range(300))]
    want = [brute_fingerprint(t) for t in texts]
    assert [simhash(t and t.encode()) for t in texts] == want
    monkeypatch.setattr(byte_words, "PIECE", 64)
    assert [simhash(t and t.encode()) for t in texts] == want


def test_trees_find_all_neighbours():
    for seed in range(5):
        groups = clusters(seed, 12, random.Random(seed).choice([1, 3, 40]), 4)
        values = [v for g in groups for v in g]
        tree = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        forest = Forest(np.array(values, dtype=np.uint64), tree)
        found = {pair for a, b in forest.neighbours() for pair in zip(a.tolist(), b.tolist(), strict=True)}
        want = {(i, j) for i in range(len(values)) for j in range(i) if tree[i] == tree[j] and near(values[i], values[j])}
        assert found == want
        assert forest.connected().tolist() == brute_components(values)


def test_split_shares_out_open_bits():
    for mask in ((1 << 64) - 1, 0xFF00FF0000FF00FF, 0b111, 0b1):
        parts = split(mask)
        assert len(parts) == 3 and sum(parts) == mask and parts[0] | parts[1] | parts[2] == mask


def test_no_link_is_lost_when_shards_are_cut(spark):
    values = sorted({v for g in clusters(7, 6, 60, 3) for v in g} | {0, (1 << 64) - 1, 1 << 63})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.node: r.root for r in fingerprint_components(rows, scratch(spark, "test"), size=16).collect()}
    least = brute_components(values)
    want = {}
    for i, root in enumerate(least):
        want.setdefault(root, set()).add(signed[i])
    groups = {}
    for v in signed:
        groups.setdefault(got.get(v, v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_odd_rows(spark):
    base = prose(5, 400)
    extra = [(20, base, "en", "a", 1), (21, base.replace(" ", "  ") + "\n", "en", "a", 1), (22, base + " x", "en", "a", 1)]
    docs = odd_docs(spark)
    more = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(more, allowMissingColumns=True).withColumn("Fingerprint", docs.lang)
    rows = simhash_duplicates(docs).collect()
    assert len(rows) == 21 and rows[0].__fields__[-2:] == ["fingerprint", "component_id"]
    prints = [brute_fingerprint(r.text) for r in rows]
    assert [r.fingerprint for r in rows] == [f"{p:016x}" for p in prints]
    least = brute_components(prints)
    for i, row in enumerate(rows):
        ids = [rows[j].doc_id for j in range(len(rows)) if least[j] == least[i] and rows[j].doc_id is not None]
        assert row.component_id == min(ids, default=None)
    assert {r.component_id for r in rows if r.doc_id in (3, 4, 5)} == {3}
    assert simhash_duplicates(none(spark)).collect() == []
