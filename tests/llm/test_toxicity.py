import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from cases import none, odd_docs, prose

from marginalia.llm.common import scratch
from marginalia.llm.toxicity import EXAMPLES, Index, fit_toxicity, score_toxicity, telling_terms, term_counts


def corpus(n):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words, toxic = prose(i, 30).split(), i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["Vile,", "nasty.", "horrid"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_nearest_is_exact():
    rng = np.random.default_rng(4)
    terms = np.sort(rng.integers(1, 1 << 60, 40).astype(np.uint64))
    idf = rng.uniform(0.1, 3, 40)

    def draw():
        t = np.sort(rng.choice(terms, rng.integers(0, 6), replace=False))
        return t, rng.integers(1, 4, len(t))

    examples = [(i, int(rng.integers(0, 2)), *draw()) for i in range(700)]
    index = Index(terms, idf, examples)
    dense = np.zeros((len(index.doc), 40))
    for i, doc in enumerate(index.doc):
        at, w = index.vector(*examples[doc][2:])
        dense[i, at] = w
    for _ in range(200):
        at, w = index.vector(*draw())
        near, cosine = index.nearest(at, w, 15)
        all_ = np.round(dense[:, at] @ w, 9) if len(at) else np.zeros(len(dense))
        want = [i for i in np.lexsort((np.arange(len(all_)), -all_))[:15] if all_[i] > 0]
        assert list(near) == want and np.allclose(cosine, all_[want], atol=1e-8)


def test_words_and_counts():
    (found,) = term_counts(pa.array(["Bad, bad! WORSE... é-x 12"]))
    want = Counter(re.findall(r"[^\W_]+", "bad bad worse é x 12"))
    assert sorted(found[1]) == sorted(want.values()) and math.prod(found[1]) == 2


def test_held_out_labels(spark):
    rows, labels = corpus(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scorer = fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int").where("doc_id % 4 <> 0"))
    found = {r.doc_id: r for r in score_toxicity(docs, scorer).collect()}
    assert len(found) == 600 and all(0 <= r.score <= 1 for r in found.values())
    assert [i for i, t in labels if found[i].predicted != t] == []
    assert all(r.predicted == (r.score >= 0.5) for r in found.values())
    assert found[0].evidence[0].toxic == 1 and found[0].evidence[0].cosine > 0.8


def test_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (2, 0), (6, 0), (9, None), (None, 1), (14, 0), (99, 1), (11, 0)], "doc_id long, toxic int"
    )
    for scorer in (fit_toxicity(docs, labels), fit_toxicity(docs, labels.limit(0)), fit_toxicity(docs, labels.where("toxic = 1"))):
        rows = score_toxicity(docs, scorer).collect()
        assert len(rows) == 18 and all(0 <= r.score <= 1 for r in rows)
        assert {r.predicted for r in rows if not r.text} == {0}
        assert score_toxicity(none(spark), scorer).collect() == []
    assert score_toxicity(docs, fit_toxicity(none(spark), labels)).count() == 18


def test_copies_of_a_text_are_one_example(spark):
    rows, labels = corpus(400)
    copied = rows[0][1]
    rows += [(1000 + i, copied) for i in range(600)]
    labels += [(1000 + i, int(i % 3 > 0)) for i in range(600)]  # most votes say toxic
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learn = spark.createDataFrame(labels, "doc_id long, toxic int").where("doc_id % 4 <> 1")
    scorer = fit_toxicity(docs, learn, examples=(50, 200))
    texts = dict(rows)
    assert len({texts[d] for d in scorer.index.doc.tolist()}) == len(scorer.index.doc) > 30
    assert sum(scorer.index.toxic) > 25
    found = {r.doc_id: r for r in score_toxicity(docs, scorer).collect()}
    held = [i for i in range(400) if i % 4 == 1 and i % 5 == 0]
    assert sum(found[i].predicted for i in held) >= 0.9 * len(held) and found[1000].predicted == 1


def test_no_telling_word_is_left_out(spark):
    """More words that tell than a table of fixed size would hold."""
    assert EXAMPLES == (8192, 16384)
    rows = [(i, i % 2, [j for j in range(3000) if (i // 2 + j) % 2] if i % 2 else [9000 + i % 7]) for i in range(160)]
    examples = spark.createDataFrame(rows, "doc_id long, toxic int, terms array<long>")
    assert set(range(3000)) <= set(telling_terms(examples, scratch(spark, "telling")))
