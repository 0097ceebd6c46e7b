"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The words that tell labels apart are chosen from the labelled examples; their document
frequencies come from all documents. Examples are filed word by word in blocks, with each
block's greatest weight. A text visits blocks in the order of the cosine they could reach, and
stops when no block can better its k-th neighbour. Neighbours vote with weights by distance,
and the vote is calibrated on examples that are not in the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import freed, scratch, strings, text_words, tidy
from marginalia.llm.language_id import logistic, remainder

#: Labelled examples to learn from, different texts with the least hashes: toxic ones, others.
EXAMPLES = (8192, 16384)
#: One example in this many calibrates the votes and is not in the index.
CALIBRATION_PART = 4
NEIGHBOURS = 15
BLOCK = 128
#: Blocks visited at first; each further visit takes twice as many of those that can still matter.
FIRST_BLOCKS = 8
#: Votes of equal texts are kept for this many different ones in a task.
MEMORY = 20_000
OUTPUT = ("score", "predicted", "vote", "evidence")
RESULT = "score double, predicted int, vote double, evidence array<struct<doc_id:long,cosine:double,toxic:int>>"


def term_counts(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its different words (runs of letters and digits, A-Z lower-cased), hashed, and how often each occurs."""
    with np.errstate(over="ignore"):
        for words in text_words(*strings(column), letters=True):
            yield np.unique(words, return_counts=True)


class Index:
    """Unit vectors of examples, inverted: for each term its postings, block after block."""

    def __init__(self, terms: np.ndarray, idf: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray]]):
        """``terms`` sorted hashes with their idf; ``examples`` (doc_id, toxic, hashes, counts).

        Examples with the same heaviest terms share blocks, so that few blocks can reach a high cosine. Their order is that of ties.
        """
        self.terms, self.idf = terms, idf
        self.tops = np.zeros(1 << 16, dtype=bool)
        self.tops[terms >> np.uint64(48)] = True
        vectors = [(doc, toxic, self.vector(t, n)) for doc, toxic, t, n in examples]
        vectors = sorted((v for v in vectors if len(v[2][0])), key=lambda v: v[2][0][np.argsort(-v[2][1], kind="stable")[:3]].tolist())
        self.doc = np.array([v[0] for v in vectors], dtype=np.int64)
        self.toxic = np.array([v[1] for v in vectors], dtype=np.int64)
        self.blocks = -(-len(vectors) // BLOCK)
        term = np.concatenate([v[2][0] for v in vectors]) if vectors else np.zeros(0, dtype=np.int64)
        weight = np.concatenate([v[2][1] for v in vectors]) if vectors else np.zeros(0)
        example = np.repeat(np.arange(len(vectors)), [len(v[2][0]) for v in vectors])
        order = np.lexsort((example, term))
        term, self.weight, self.example = term[order], weight[order], example[order]
        place = term * max(1, self.blocks) + self.example // BLOCK
        self.first = np.searchsorted(place, np.arange(len(terms) * max(1, self.blocks) + 1))
        self.most = np.zeros((len(terms), max(1, self.blocks)))
        np.maximum.at(self.most, (term, self.example // BLOCK), self.weight)

    def known(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words that are terms."""
        if not len(self.terms):
            return hashes[:0], counts[:0]
        # Looked up by the top bits first, as few words are terms.
        hashes, counts = hashes[some := self.tops[hashes >> np.uint64(48)]], counts[some]
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        same = self.terms[at] == hashes
        return hashes[same], counts[same]

    def vector(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and unit weights of a text; none if it has no term."""
        hashes, counts = self.known(hashes, counts)
        at = np.searchsorted(self.terms, hashes)
        weight = (1 + np.log(counts)) * self.idf[at]
        return at, weight / np.sqrt((weight**2).sum()) if len(at) else weight

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the greatest cosine above 0, ties to the first: (numbers, cosines)."""
        if not self.blocks or not len(terms):
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        bound = weights @ self.most[terms]
        order = np.argsort(-bound, kind="stable")
        found, cosine, least = np.zeros(0, dtype=np.int64), np.zeros(0), 0.0
        at, step = 0, FIRST_BLOCKS
        while at < len(order):
            visited = order[at : at + step]
            visited = visited[(bound[visited] > 0) & (bound[visited] >= least - 1e-9)]
            if not len(visited):
                break
            at, step = at + step, 2 * step
            place = terms[:, None] * self.blocks + visited
            start = self.first[place].ravel()
            n = self.first[place + 1].ravel() - start
            posting = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
            share = np.repeat(np.repeat(weights, len(visited)), n) * self.weight[posting]
            sums = np.bincount(self.example[posting], weights=share, minlength=1)
            some = np.flatnonzero(sums > 0)
            found = np.concatenate((found, some))
            cosine = np.round(np.concatenate((cosine, sums[some])), 9)
            best = np.lexsort((found, -cosine))[:k]
            found, cosine = found[best], cosine[best]
            if len(found) == k:
                least = cosine[-1]
        return found, cosine


class ToxicityScorer:
    """Index, vote weights and calibration; made by :func:`fit_toxicity`."""

    def __init__(self, index: Index, toxic_weight: float, k: int):
        self.index, self.toxic_weight, self.k = index, toxic_weight, k
        self.base, self.calibration = 0.0, None

    def vote(self, hashes: np.ndarray, counts: np.ndarray):
        """(vote, best cosine, neighbours, their cosines); the vote is null without neighbours."""
        near, cosine = self.index.nearest(*self.index.vector(hashes, counts), self.k)
        if not len(near):
            return None, 0.0, near, cosine
        weight = 1 / (1.05 - np.minimum(cosine, 1.0))
        weight = weight * np.where(self.index.toxic[near] == 1, self.toxic_weight, 1.0)
        return float(weight[self.index.toxic[near] == 1].sum() / weight.sum()), float(cosine[0]), near, cosine

    def features(self, vote: float, cosine: float) -> list[float]:
        return [vote, vote * cosine]

    def score(self, vote: float | None, cosine: float) -> float:
        if vote is None:
            return self.base
        if self.calibration is None:
            return vote
        z = self.calibration[0] + np.dot(self.calibration[1:], self.features(vote, cosine))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def calibrate(self, examples: list[tuple[int, int, np.ndarray, np.ndarray]], keep: float) -> None:
        """``examples`` as in the index; each that is not toxic stands for ``keep`` of them."""
        votes = [(toxic, *self.vote(t, n)[:2]) for _, toxic, t, n in examples]
        alone = [toxic for toxic, vote, _ in votes if vote is None]
        # Smoothed by one toxic example in a hundred; without a neighbour nothing speaks for toxicity.
        self.base = min(0.49, (sum(alone) + 0.01) / (sum(alone) + keep * (len(alone) - sum(alone)) + 1))
        voted = [(toxic, self.features(vote, cosine)) for toxic, vote, cosine in votes if vote is not None]
        if len({toxic for toxic, _ in voted}) == 2:
            x, y = np.array([f for _, f in voted]), np.array([toxic == 1 for toxic, _ in voted])
            self.calibration = logistic(x, y, ridge=1e-2)

    def results(self, column) -> Iterator[tuple[float, int, float | None, list[dict]]]:
        known: dict[bytes, tuple] = {}
        for hashes, counts in term_counts(column):
            hashes, counts = self.index.known(hashes, counts)
            same = hashes.tobytes() + counts.tobytes()
            if same not in known:
                if len(known) == MEMORY:
                    known.clear()
                vote, cosine, near, cosines = self.vote(hashes, counts)
                score = self.score(vote, cosine)
                evidence = [
                    {"doc_id": int(self.index.doc[i]), "cosine": float(c), "toxic": int(self.index.toxic[i])}
                    for i, c in zip(near[:3], cosines[:3], strict=True)
                ]
                known[same] = (score, int(score >= 0.5), vote, evidence)
            yield known[same]


def labelled_texts(docs: DataFrame, labels: DataFrame, tables) -> DataFrame:
    """(h, doc_id, toxic): one row for each different labelled text of ``docs``, with its hash and least id.

    ``labels`` (doc_id, toxic): an id that is labelled more than once is toxic if any label says so,
    a text if at least half of the rows that have it are.
    """
    single = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("h")).join(single, "doc_id")
    toxic = (2 * F.sum("toxic") >= F.count("*")).cast("int").alias("toxic")
    return tables.save(rows.groupBy("h").agg(F.min("doc_id").alias("doc_id"), toxic))


def labelled_examples(docs: DataFrame, texts: DataFrame, tables, most: tuple[int, int] = EXAMPLES) -> DataFrame:
    """(doc_id, toxic, h, terms, counts) of at most ``most`` toxic and other ``texts`` (h, doc_id, toxic), those with the least hashes."""
    spark = docs.sparkSession
    chosen = [
        tuple(r)
        for n, is_toxic in zip(most, (F.col("toxic") == 1, F.col("toxic") != 1), strict=True)
        for r in texts.where(is_toxic).select("doc_id", "toxic", "h").orderBy("h").limit(n).collect()
    ]
    chosen = spark.createDataFrame(chosen, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, toxic int, h long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts = zip(*term_counts(batch["text"]), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["toxic"], batch["h"],
                 pa.array([t.view(np.int64) for t in terms], pa.list_(pa.int64())),
                 pa.array([c.astype(np.int32) for c in counts], pa.list_(pa.int32()))],
                names=["doc_id", "toxic", "h", "terms", "counts"],
            )

    # The sample has at most sum(most) rows.
    found = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(chosen), ["doc_id", "h"])
    found = found.dropDuplicates(["h"]).select("doc_id", "toxic", "h", "text")
    return tables.save(found.mapInArrow(count, "doc_id long, toxic int, h long, terms array<long>, counts array<int>"))


def telling_terms(examples: DataFrame, tables) -> list[int]:
    """Hashes of all words that tell toxic examples from others, by chi-square, above what chance gives among all words."""
    n = examples.agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("toxic")).first()
    toxic, rest = n.toxic or 0, n.n - (n.toxic or 0)
    if not toxic or not rest:
        return []
    seen = examples.select(F.explode("terms").alias("term"), (F.col("toxic") == 1).cast("long").alias("toxic"))
    seen = tables.save(seen.groupBy("term").agg(F.sum("toxic").alias("a"), F.count("*").alias("n")))
    limit = 2 * float(np.log(max(2, seen.count()))) + 5
    a, b = F.col("a"), F.col("n") - F.col("a")
    c, d = F.lit(float(toxic)) - a, F.lit(float(rest)) - b
    square = (toxic + rest) * F.pow(a * d - b * c, 2) / (F.lit(float(toxic) * rest) * F.greatest((a + b) * (c + d), F.lit(1e-9)))
    best = seen.withColumn("square", square).where((F.col("square") > limit) & (F.col("n") > 1))
    return [r.term for r in best.select("term").collect()]  # no more than the sample's words


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many of all documents each of the sorted ``terms`` occurs, and how many documents there are."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        seen = np.zeros(len(known) + 1, dtype=np.int64)
        for batch in batches:
            for hashes, _ in term_counts(batch["text"]):
                seen[-1] += 1
                if len(known):
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    seen[at[known[at] == hashes]] += 1
            tidy()
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(seen[some])], names=["term", "n"])

    counted = docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(len(terms) + 1, dtype=np.int64)
    for r in counted:  # one row for each term at most
        found[r.term] = r.n
    return found[:-1], int(found[-1])


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, k: int = NEIGHBOURS, examples: tuple[int, int] = EXAMPLES
) -> ToxicityScorer:
    """Learn from ``labels`` (doc_id, toxic) of ``docs`` (doc_id, text).

    The index holds no more than ``examples`` toxic and other examples, each a different text, with
    every word that tells them apart; word statistics cover all documents. Without toxic or other examples every score is the share of toxic ones.
    """
    tables = scratch(docs.sparkSession, "toxicity")
    texts = labelled_texts(docs, labels, tables)
    found = labelled_examples(docs, texts, tables, examples)
    for_index = F.pmod(F.shiftright("h", 8), F.lit(CALIBRATION_PART)) != 0
    chosen = telling_terms(found.where(for_index), tables)
    hashes = np.sort(np.array(chosen, dtype=np.int64).view(np.uint64))
    df, n = document_frequencies(docs, hashes)
    idf = np.log(1 + n / np.maximum(1, df))

    known = set(chosen)

    def of(part: DataFrame) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """At most sum(examples) rows, of each only the chosen words."""

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                own = [[i for i, t in enumerate(ts) if t in known] for ts in batch["terms"]]
                batch["terms"] = [np.asarray(t)[i] for t, i in zip(batch["terms"], own, strict=True)]
                batch["counts"] = [np.asarray(c)[i] for c, i in zip(batch["counts"], own, strict=True)]
                yield batch

        rows = part.mapInPandas(cut, part.schema).orderBy("h", "doc_id").toPandas()
        return [
            (int(r.doc_id), int(r.toxic == 1), np.asarray(r.terms, dtype=np.int64).view(np.uint64), np.asarray(r.counts, dtype=np.int64))
            for r in rows.itertuples()
        ]

    counts = {bool(r.toxic): r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    taken = [min(counts.get(t, 0), m) for t, m in zip((True, False), examples, strict=True)]
    # How many labelled texts of its kind an example stands for.
    toxic_stands = counts.get(True, 0) / max(1, taken[0])
    other_stands = counts.get(False, 0) / max(1, taken[1])
    index = Index(hashes, idf, of(found.where(for_index)))
    scorer = ToxicityScorer(index, toxic_stands / max(other_stands, 1e-9) if other_stands else 1.0, k)
    scorer.calibrate(of(found.where(~for_index)), other_stands / max(toxic_stands, 1e-9) if toxic_stands else 1.0)
    return scorer


def score_toxicity(docs: DataFrame, scorer: ToxicityScorer) -> DataFrame:
    """All rows of ``docs`` with score (0 to 1), predicted (1 from 0.5 on), vote and evidence, from the text alone.

    ``evidence`` lists the nearest three examples. A text without a telling word, an empty or a null
    one has no neighbours: no vote, no evidence, and a score below 0.5, the share of toxic
    examples like it. Equal texts have equal results. Columns of the output's names are
    replaced, others pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.arrow_udf(RESULT)
    def score(column: pa.Array) -> pa.Array:
        scores, predicted, votes, evidence = zip(*shared.value.results(column), strict=True) if len(column) else ((), (), (), ())
        tidy()
        near = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        columns = [pa.array(v, t) for v, t in ((scores, pa.float64()), (predicted, pa.int32()), (votes, pa.float64()), (evidence, near))]
        return pa.StructArray.from_arrays(columns, names=OUTPUT)

    base = freed(docs, *OUTPUT)
    return base.withColumn("__mg_toxic", score(F.col("text"))).select(*base.columns, "__mg_toxic.*")


def to_learn_from(labels: DataFrame) -> DataFrame:
    """The labels whose crc32(doc_id as text) mod 5 is not 0."""
    return labels.where(remainder(F.col("doc_id"), 5) != 0).select("doc_id", "toxic")
