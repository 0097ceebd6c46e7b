"""Each stage of the pipeline on its own input against a plain model, and the query as a whole."""

import random
import re
from collections import Counter

import corpus_pipeline
import duckdb
import pytest
import test_jaccard_join
import test_line_dedup
import test_mixing
import test_packing
from cases import SCHEMA, odd_rows, prose
from pyspark.sql import functions as F

from marginalia.llm.queries import ORACLES, QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    """Clean, toxic, copied, nearly copied and line-sharing documents, with the odd rows."""
    rng, rows = random.Random(5), odd_rows()
    toxic = ["vile scum", "filthy rat", "worthless trash", "die fool"]
    for i in range(100, 260):
        text = prose(i, rng.randint(25, 80))
        if i % 4 == 0:
            text += " " + " ".join(rng.choice(toxic) for _ in range(12))
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    for i in range(300, 320):
        text = rows[20 + i - 300][1]
        text = text if i % 2 else text.replace("\n", " ", 1) + " end"
        rows.append((i, text, "en", "s1", len(text)))
    shared = "\n".join(prose(900 + j, 8).replace("\n", " ") for j in range(5))
    rows += [(400 + i, f"{prose(600 + i, 40)}\n{shared}\n{prose(700 + i, 40)}", "en", "s2", 1) for i in range(6)]
    rows.append((500, shared, "en", "s2", 1))  # nothing but lines of others
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("x")).repartition(3).write.parquet(f"{root}/documents.parquet")
    labels = [(r[0], 0, int("scum" in (r[1] or "") or "trash" in (r[1] or "") or "rat" in (r[1] or "").split())) for r in rows if r[0] and r[0] >= 100]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """The rows that go into each stage, and come out of it."""
    root, out = str(tmp_path_factory.mktemp("stages")), {}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, folder).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        out[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    return out


def texts(rows):
    return Counter((r.doc_id, r.text) for r in rows)


def test_stages_are_those_asked_for():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "mixing", "packing"]


def test_toxicity_rejects_toxic_documents(stages):
    before, after = stages["toxicity"]
    gone = texts(before) - texts(after)
    toxic = Counter(k for k in texts(before).elements() if k[1] and ("vile scum" in k[1] or "worthless trash" in k[1] or "filthy rat" in k[1]))
    assert not texts(after) - texts(before)
    assert (gone - toxic).total() <= 0.02 * len(before)
    assert len(toxic - gone) <= 0.1 * len(toxic)


def test_line_dedup_matches_the_model(stages):
    before, after = stages["line_dedup"]
    cut = test_line_dedup.brute(before)
    want = Counter()
    for r in before:
        text = None if r.text is None else cut[(r.doc_id, r.text)][0]
        if r.text is None or text == r.text or WORDS.search(text):
            want[(r.doc_id, text)] += 1
    assert texts(after) == want
    assert 500 not in {r.doc_id for r in after} and {3, 4, 5} <= {r.doc_id for r in after}


def test_near_duplicates_match_all_pairs(stages):
    before, after = stages["near_duplicates"]
    components = {}
    for doc, n, component in test_jaccard_join.brute([(r.doc_id, r.text) for r in before]):
        if n and doc is not None:
            components.setdefault(component, set()).add(doc)
    left = Counter(r.doc_id for r in after if r.text and WORDS.search(r.text) and r.doc_id is not None)
    for component, members in components.items():
        assert min(members) == component
        assert sum(left[m] for m in members if m not in (2, 14)) <= 1
    assert texts(after) <= texts(before) and set(components) <= {r.doc_id for r in after}
    silent = lambda rows: Counter(r.doc_id for r in rows if not (r.text and WORDS.search(r.text)))
    assert silent(before) == silent(after)


def test_mixing_meets_its_targets(stages):
    before, after = stages["mixing"]
    size = lambda r: len(WORDS.findall(r.text or ""))
    sizes = Counter()
    for r in before:
        sizes[r.source] += size(r)
    want = test_mixing.shares(dict(sizes))
    copies = texts(after)
    assert set(copies) <= set(texts(before)) and all(n <= 2 * texts(before)[k] for k, n in copies.items())
    for source in sizes:
        taken = sum(size(r) for r in after if r.source == source)
        largest = max((size(r) for r in before if r.source == source), default=0)
        assert abs(taken - want[source]) <= largest / 2 + 1e-6


def test_packing_keeps_every_token(stages):
    before, after = stages["packing"]
    pieces = test_packing.pieces_of([(r.doc_id, r.text) for r in before], corpus_pipeline.CAPACITY)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in after) == pieces
    test_packing.check(after, corpus_pipeline.CAPACITY)


def test_whole_run_and_empty_tables(spark, folder, stages, tmp_path):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = Counter(map(tuple, corpus_pipeline.run(spark, folder).select(*columns).collect()))
    assert whole == Counter(tuple(r[c] for c in columns) for r in stages["packing"][1])
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_sql(spark, name):
    """The registered queries and SQL themselves, on the smallest supplied tables."""
    root = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{root}/{table}.parquet'")
    result = con.execute(ORACLES[name])
    columns = sorted(d[0] for d in result.description)
    got = QUERIES[name](spark, root)
    assert sorted(got.columns) == columns
    order = [[d[0] for d in result.description].index(c) for c in columns]
    want = Counter(repr(tuple(row[i] for i in order)) for row in result.fetchall())
    assert Counter(repr(tuple(row)) for row in got.select(*columns).collect()) == want
