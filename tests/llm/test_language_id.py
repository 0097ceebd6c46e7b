import math
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from cases import none, odd_docs
from pyspark.sql import functions as F

from marginalia.llm.common import strings
from marginalia.llm.language_id import Model, fit_languages, identify_languages, run_counts


def sample(lang, n, seed):
    rng = random.Random(seed)
    parts = {"en": ["the", "ing", "er", "and", "th"], "de": ["sch", "ung", "ein", "ü", "der"], "fr": ["eau", "é", "tion", "que", "ou"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def brute_entropy(counts, lang, text):
    """Interpolated Kneser-Ney, straight from its definition."""
    runs = {r: n for (x, r), n in counts.items() if x == lang}
    levels = [runs]
    for _ in range(3):
        after = defaultdict(set)
        for r in levels[-1]:
            after[r[1:]].add(r[0])
        levels.append({r: len(s) for r, s in after.items()})
    levels.reverse()
    alphabet = len({r[-1] for _, r in counts}) + 1
    offs = []
    for level in levels:
        ones, twos = (sum(1 for n in level.values() if n == c) for c in (1, 2))
        offs.append(min(0.9, max(0.1, ones / max(1, ones + 2 * twos))))

    def p(run):
        if not run:
            return 1 / alphabet
        level, off = levels[len(run) - 1], offs[len(run) - 1]
        same = {r: n for r, n in level.items() if r[:-1] == run[:-1]}
        total = sum(same.values())
        if not total:
            return p(run[1:])
        return max(level.get(run, 0) - off, 0) / total + off * len(same) / total * p(run[1:])

    letters = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    padded = "   " + letters
    return -sum(math.log(p(padded[i : i + 4])) for i in range(len(letters))) / len(letters)


def test_matches_the_definition(spark):
    docs = [(i, sample(x, 30, i), x) for i, x in enumerate(["en", "de", "fr"] * 6)]
    counts = {(r.lang, r.run): r.n for r in run_counts(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    model = Model(pd.DataFrame([(x, r, n) for (x, r), n in counts.items()], columns=["lang", "run", "n"]))
    texts = [docs[0][1], "Über, the 3 zebras!", "x", "qqq ж"]
    found, _ = model.cross_entropies(*strings(pa.array(texts)))
    want = [[brute_entropy(counts, lang, t) for lang in model.langs] for t in texts]
    assert np.allclose(found, want, atol=1e-4)


def test_held_out_accuracy_and_calibration(spark):
    rows = [(i, sample(random.Random(i).choice(["en", "de", "fr"]), 3 + i % 20, i), random.Random(i).choice(["en", "de", "fr"])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = fit_languages(docs.where("doc_id % 3 <> 1"))
    found = identify_languages(docs.where("doc_id % 3 = 1"), model).collect()
    assert sum(r.lang_pred == r.lang for r in found) / len(found) > 0.97
    assert all(0 <= r.score <= 1 for r in found)
    assert sum(r.accepted for r in found) / len(found) > 0.9


def test_odd_rows(spark):
    docs = odd_docs(spark)
    model = fit_languages(docs)
    rows = identify_languages(docs, model).collect()
    assert len(rows) == 18
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 and not by_id[i].accepted for i in (3, 4, 5))
    assert len({r.lang_pred for r in rows if r.doc_id in (1, 2)}) == 1
    assert {r.lang_pred for r in rows} <= {"en", "de", "fr", "es", "und"}
    assert identify_languages(none(spark), model).collect() == []
    untaught = fit_languages(none(spark))
    assert {r.lang_pred for r in identify_languages(docs, untaught).collect()} == {"und"}
    single = fit_languages(spark.createDataFrame([(i, f"hello {i} there", "en") for i in range(40)], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in identify_languages(docs, single).collect()} == {"en", "und"}


def test_parts_of_the_model_add_up_to_the_whole(spark):
    """However few numbers a part may have: no run is left out, nor a language of few texts."""
    common = [(i, sample(x, 60, i), x) for i, x in enumerate(["en", "de"] * 40)]
    rare = [(1000 + i, sample("fr", 4, i), "fr") for i in range(12)]
    docs = spark.createDataFrame(common + rare, "doc_id long, text string, lang string")
    held = spark.createDataFrame([(i, sample(x, 6, 7000 + i)) for i, x in enumerate(["en", "de", "fr"] * 10)] + [(99, "qqq ж 中文"), (100, "")], "doc_id long, text string")
    whole, cut = (fit_languages(docs, **limit) for limit in ({}, {"cells": 120}))
    assert len(whole.parts) == 1 and len(cut.parts) > 5 and whole.langs == cut.langs == ["de", "en", "fr"]
    want, found = ({r.doc_id: r for r in identify_languages(held, m).collect()} for m in (whole, cut))
    for i, r in want.items():
        f = found[i]
        assert (f.lang_pred, f.accepted, f.runner_up) == (r.lang_pred, r.accepted, r.runner_up)
        assert f.cross_entropy == r.cross_entropy or math.isclose(f.cross_entropy, r.cross_entropy, rel_tol=1e-5)
        assert math.isclose(f.score, r.score, rel_tol=1e-4, abs_tol=1e-9)
    assert sum(found[i].lang_pred == "fr" for i in range(2, 30, 3)) >= 9


def test_texts_that_calibrate_are_learnt_too(spark):
    docs = spark.createDataFrame([(i, sample(x, 30, i), x) for i, x in enumerate(["en", "de"] * 60)], "doc_id long, text string, lang string")
    aside = F.pmod(F.xxhash64("doc_id", "text"), F.lit(16)) == 0
    rare = spark.createDataFrame([(1000 + i, sample("fr", 20, i), "fr") for i in range(200)], docs.schema).where(aside)
    model = fit_languages(docs.unionByName(rare))
    assert rare.count() > 3 and model.langs == ["de", "en", "fr"]
    assert {r.lang_pred for r in identify_languages(rare, model).collect()} == {"fr"}
