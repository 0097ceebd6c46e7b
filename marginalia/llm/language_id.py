"""Language identification with interpolated Kneser-Ney character models.

One model a language, over runs of four letters (lower-cased, anything else a space). The
counts come from all texts to learn from; the models of all languages share sorted hash
arrays of runs, each with one log probability a language. The probability of a letter only
needs runs with the same letter before it, so the arrays are cut by that letter into parts of
bounded size, and a text's sums over the parts add up. A text goes to the language of the
lowest cross-entropy per character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import freed, mixed, scratch, strings, tidy

ORDER = 4
UNKNOWN = "und"
#: Numbers in a part of the model (runs times languages), which is what a task holds of it at a time. A single letter is not cut.
CELLS = 1 << 22
#: Texts, those with the least hashes, that calibrate the scores; one in CALIBRATION_PART is set aside for it.
CALIBRATION = 20_000
CALIBRATION_PART = 16
SLICE = 1 << 19
SPACE_CODE = 32
OUTPUT = ("lang_pred", "score", "accepted", "cross_entropy", "runner_up")


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    every = (chr(c) for c in range(0x110000))
    return np.fromiter((ord(x.lower()[0]) if x.isalpha() else SPACE_CODE for x in every), dtype=np.uint32, count=0x110000)


def codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of texts, single spaces between words and one at either end, and where each text begins.

    A text without letters is empty.
    """
    points = [np.frombuffer(data[a:b].tobytes().decode().encode("utf-32-le"), dtype="<u4") for a, b in zip(offsets, offsets[1:], strict=False)]
    lengths = np.array([len(p) + 2 for p in points], dtype=np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    flat = np.full(int(starts[-1]), SPACE_CODE, dtype=np.uint32)
    for p, at in zip(points, starts, strict=False):
        flat[at + 1 : at + 1 + len(p)] = p
    flat = _letters()[flat]
    space = flat == SPACE_CODE
    first = np.zeros(len(flat), dtype=bool)
    first[starts[:-1]] = True
    keep = ~space | first
    keep[1:] |= space[1:] & ~space[:-1]
    owner = np.repeat(np.arange(len(points)), lengths)
    keep &= (np.bincount(owner[~space], minlength=len(points)) > 0)[owner]
    return flat[keep], np.concatenate(([0], np.cumsum(np.bincount(owner[keep], minlength=len(points)))))


def histories(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each letter the ORDER letters that end with it (rows: oldest first); before a text there are spaces."""
    n = len(flat)
    out = np.full((ORDER, n), SPACE_CODE, dtype=np.uint64)
    place = np.arange(n) - np.repeat(starts[:-1], np.diff(starts))
    for back in range(ORDER):
        row = ORDER - 1 - back
        out[row, back:] = flat[: n - back] if back else flat
        out[row, place < back] = SPACE_CODE
    return out


def keys(rows: np.ndarray) -> np.ndarray:
    """A hash of each column of letters."""
    with np.errstate(over="ignore"):
        h = np.full(rows.shape[1], len(rows), dtype=np.uint64)
        for row in rows:
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + row)
    return h


def slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1)
        yield i, j
        i = j


# ---------------------------------------------------------------- learning


def run_counts(texts: DataFrame) -> DataFrame:
    """(lang, run, n): how often each run of four letters occurs in all ``texts`` (text, lang) of a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch["text"])
            langs = np.array(batch["lang"].to_pylist(), dtype=object)
            for i, j in slices(data, offsets):
                flat, starts = codes(data, offsets[i : j + 1])
                grams = histories(flat, starts)
                owner = np.repeat(langs[i:j], np.diff(starts))
                for lang in sorted(set(langs[i:j])):
                    mine = grams[:, owner == lang]
                    _, first, n = np.unique(keys(mine), return_index=True, return_counts=True)
                    runs = mine[:, first].T.astype("<u4").tobytes().decode("utf-32-le")
                    runs = [runs[k : k + ORDER] for k in range(0, len(runs), ORDER)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(n), pa.string()), pa.array(runs, pa.string()), pa.array(n, pa.int64())],
                        names=["lang", "run", "n"],
                    )
            tidy()

    parts = texts.select("text", "lang").mapInArrow(count, "lang string, run string, n long")
    return parts.groupBy("lang", "run").agg(F.sum("n").alias("n"))


class Table:
    """Sorted hashes with a row of numbers each."""

    def __init__(self, hashes: np.ndarray, rows: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.rows = hashes[order], rows[order]
        self.bits = max(1, len(hashes).bit_length() + 1)
        tops = (self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.first = np.searchsorted(tops, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.first).max()) if len(hashes) else 0

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 where there is none: hashes are even, so their top bits say about where."""
        out = np.full(len(wanted), -1, dtype=np.int32)
        if not len(self.hashes):
            return out
        top = (wanted >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            hit = self.hashes[at] == wanted[left]
            out[left[hit]] = at[hit]
            on = ~hit & (at + 1 < end)
            left, at, end = left[on], at[on] + 1, end[on]
        return out


@dataclass
class Whole:
    """What a part of the models takes from all runs: the languages, discounts by order (single letters first), letters (lang, run, n)."""

    langs: list[str]
    off: np.ndarray
    letters: pd.DataFrame


def discounts(ones: np.ndarray, twos: np.ndarray) -> np.ndarray:
    return np.clip(ones / np.maximum(1, ones + 2 * twos), 0.1, 0.9)


class Model:
    """Interpolated Kneser-Ney models of several languages, or the part of them for letters after some letters."""

    def __init__(self, counts: pd.DataFrame, whole: Whole | None = None, after: tuple[int, int] | None = None):
        """``counts`` (lang, run, n): of every run of ORDER letters; of those of ``whole``, the ones whose last letter but one is in ``after``."""
        self.after = after
        self.langs = whole.langs if whole else sorted(set(counts["lang"]))
        size = len(self.langs)
        number = {x: i for i, x in enumerate(self.langs)}

        def arrays(counts: pd.DataFrame, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            text = "".join(counts["run"])
            rows = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").reshape(-1, order).T.astype(np.uint64)
            return rows, counts["lang"].map(number).to_numpy(dtype=np.int64), counts["n"].to_numpy(dtype=np.float64)

        #: By order, from single letters up: runs with their log probabilities, contexts with their weights.
        self.runs: list[Table] = []
        self.contexts: list[Table] = []
        levels = [arrays(counts, ORDER)]
        for _ in range(ORDER - 1):  # of each shorter run: the number of letters it is seen after
            rows, lang, _ = levels[-1]
            hashes = keys(rows[1:]) ^ mixed(lang.astype(np.uint64))
            _, first, kinds = np.unique(hashes, return_index=True, return_counts=True)
            levels.append((rows[1:, first], lang[first], kinds.astype(np.float64)))
        if whole:
            levels[-1] = arrays(whole.letters, 1)
        alphabet = len(np.unique(levels[-1][0])) + 1
        below = np.full((1, size), 1 / alphabet)
        for order, (rows, lang, n) in enumerate(reversed(levels)):
            off = whole.off[order] if whole else discounts(*(np.bincount(lang[n == c], minlength=size) for c in (1, 2)))
            context, run = keys(rows[:-1]), keys(rows)
            contexts, which = np.unique(context, return_inverse=True)
            total, kinds = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
            np.add.at(total, (which, lang), n)
            np.add.at(kinds, (which, lang), 1)
            weight = np.where(total > 0, off * kinds / np.maximum(total, 1), 1.0)
            runs, first, at = np.unique(run, return_index=True, return_inverse=True)
            own = np.zeros((len(runs), size))
            np.add.at(own, (at, lang), np.maximum(n - off[lang], 0))
            p = own / np.maximum(total[which[first]], 1)
            lower = self._probability(rows[1:, first]) if self.runs else below
            p += weight[which[first]] * lower
            self.runs.append(Table(runs, np.log(p).astype(np.float32)))
            self.contexts.append(Table(contexts, np.log(weight).astype(np.float32)))
        self.none = np.log(below[0]).astype(np.float32)

    def _probability(self, rows: np.ndarray) -> np.ndarray:
        return np.exp(self.log_probability(rows).astype(np.float64))

    def log_probability(self, rows: np.ndarray) -> np.ndarray:
        """Of the last letter of each run, given the others, in each language; for runs of any order learnt so far."""
        order = len(rows)
        if not order:
            return np.tile(self.none, (rows.shape[1], 1))
        table = self.runs[order - 1]
        at = table.find(keys(rows))
        out = table.rows[np.maximum(at, 0)] if len(table.rows) else np.zeros((rows.shape[1], len(self.none)), np.float32)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            rest = rows[:, missing]
            context = self.contexts[order - 1]
            at = context.find(keys(rest[:-1]))
            weight = np.where((at >= 0)[:, None], context.rows[np.maximum(at, 0)], 0)
            shorter = rest[1:] if order > 1 else np.zeros((0, len(missing)), np.uint64)
            out[missing] = weight + self.log_probability(shorter)
        return out

    def log_sums(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text in each language, over the letters of this part; and the number of all letters (with the spaces between)."""
        flat, starts = codes(data, offsets)
        n = np.diff(starts)
        out = np.zeros((len(n), len(self.langs)))
        if len(flat):
            grams, at = histories(flat, starts), starts
            if self.after:
                own = (grams[-2] >= self.after[0]) & (grams[-2] <= self.after[1])
                grams, at = grams[:, own], np.concatenate(([0], np.cumsum(own)))[starts]
            some = np.flatnonzero(np.diff(at))
            if len(some):
                out[some] = np.add.reduceat(self.log_probability(grams), at[:-1][some], axis=0, dtype=np.float64)
        return out, n

    def cross_entropies(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text in each language, per letter; and the number of letters (with the spaces between)."""
        out, n = self.log_sums(data, offsets)
        return -out / np.maximum(n, 1)[:, None], n


def summary(counts: DataFrame, tables) -> Whole:
    """``counts`` (lang, run, n) of runs of ORDER letters: of each shorter run, the letters it is seen after are counted in turn."""
    levels = [counts]
    for order in range(ORDER - 1, 0, -1):
        shorter = F.substring("run", 2, order).alias("run")
        levels.append(tables.save(levels[-1].groupBy("lang", shorter).agg(F.count("*").alias("n"))))
    few = [F.sum((F.col("n") == c).cast("long")).alias(name) for c, name in ((1, "ones"), (2, "twos"))]
    found = [x.groupBy("lang").agg(*few).orderBy("lang").collect() for x in reversed(levels)]  # a row for each language
    off = [discounts(*(np.array([r[c] for r in rows], dtype=np.int64) for c in ("ones", "twos"))) for rows in found]
    # At most the letters of each language.
    return Whole([r.lang for r in found[0]], np.array(off), levels[-1].toPandas())


def model_parts(counts: DataFrame, tables, cells: int = CELLS) -> list[Broadcast]:
    """Models of saved ``counts`` (lang, run, n), in parts of at most ``cells`` numbers (or one letter), made one after another."""
    whole = summary(counts, tables)
    before = F.substring("run", ORDER - 1, 1)
    # At most the letters of all languages; a table has as many rows as there are different runs at most.
    sizes = sorted((ord(r.letter), r.n) for r in counts.groupBy(before.alias("letter")).agg(F.count("*").alias("n")).collect())
    most = max(1, cells // max(1, len(whole.langs)))
    firsts: list[int] = []
    size = 0
    for letter, n in sizes:
        if not firsts or size + n > most:
            firsts.append(letter)
            size = 0
        size += n
    if len(firsts) < 2:
        return [counts.sparkSession.sparkContext.broadcast(Model(counts.toPandas(), whole)) for _ in firsts]
    parts = []
    for i, first in enumerate(firsts):
        last = firsts[i + 1] - 1 if i + 1 < len(firsts) else 0x10FFFF
        own = counts.where((before >= chr(first)) & ((before < chr(firsts[i + 1])) if i + 1 < len(firsts) else F.lit(True)))
        parts.append(counts.sparkSession.sparkContext.broadcast(Model(own.toPandas(), whole, (first if i else 0, last))))
    return parts


def _entropies(parts: list[Broadcast], column) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropies of each text in each language, and its number of letters; of several parts, one is held at a time."""
    data, offsets = strings(column)
    total: list[np.ndarray] = []
    for part in parts:
        model = part.value
        if len(parts) > 1 and getattr(part, "_path", None):
            vars(part).pop("_value", None)  # it is read again from its file
        found = [model.log_sums(data, offsets[i : j + 1]) for i, j in slices(data, offsets)]
        if not found:
            return np.zeros((0, len(model.langs))), np.zeros(0, dtype=np.int64)
        total = [t + f for (f, _), t in zip(found, total or [0] * len(found), strict=True)]
    n = np.concatenate([x for _, x in found])
    return -np.concatenate(total) / np.maximum(n, 1)[:, None], n


def _margin(entropies: np.ndarray, n: np.ndarray) -> np.ndarray:
    """log(1 + nats) by which the best language leads; a single language leads nobody."""
    if entropies.shape[1] < 2:
        return np.zeros(len(n))
    two = np.partition(entropies, 1, axis=1)
    return np.log1p((two[:, 1] - two[:, 0]) * n)


def logistic(x: np.ndarray, right: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (constant first) of a logistic fit to smoothed targets, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    good, bad = right.sum(), (~right).sum()
    y = np.where(right, (good + 1) / (good + 2), 1 / (bad + 2))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


class LanguageIdentifier:
    """Models with the calibration of their scores; made by :func:`fit_languages`."""

    def __init__(self, parts: list[Broadcast], langs: list[str], weights: np.ndarray, worst: dict[str, float]):
        self.parts, self.langs, self.weights, self.worst = parts, langs, weights, worst

    def predict(self, column) -> pa.StructArray:
        if not self.parts:
            n = len(column)
            return pa.StructArray.from_arrays(
                [pa.array(v, k) for v, k in zip(([UNKNOWN] * n, [0.0] * n, [False] * n, [None] * n, [None] * n), KINDS, strict=True)], names=OUTPUT
            )
        langs = np.array(self.langs, dtype=object)
        entropies, n = _entropies(self.parts, column)
        order = np.argsort(entropies, axis=1, kind="stable")
        best = entropies[np.arange(len(n)), order[:, 0]]
        z = self.weights[0] + self.weights[1] * _margin(entropies, n)
        score = np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
        known = langs[order[:, 0]]
        limit = np.array([self.worst.get(x, np.inf) for x in known])
        second = langs[order[:, 1]] if len(langs) > 1 else np.full(len(n), None)
        out = {
            "lang_pred": list(np.where(n > 0, known, UNKNOWN)),
            "score": score.tolist(),
            "accepted": ((n > 0) & (score >= 0.5) & (best <= limit)).tolist(),
            "cross_entropy": [float(b) if k else None for b, k in zip(best, n, strict=True)],
            "runner_up": [s if k else None for s, k in zip(second, n, strict=True)],
        }
        tidy()
        return pa.StructArray.from_arrays([pa.array(out[c], k) for c, k in zip(OUTPUT, KINDS, strict=True)], names=OUTPUT)


KINDS = (pa.string(), pa.float64(), pa.bool_(), pa.float64(), pa.string())


def fit_languages(texts: DataFrame, cells: int = CELLS, calibration: int = CALIBRATION) -> LanguageIdentifier:
    """Learn from all rows of ``texts`` (doc_id, text, lang) with a language.

    Rows whose hash falls in one of CALIBRATION_PART parts are not counted at first but calibrate: of these
    the ``calibration`` with the least hashes give the scores (a logistic fit of whether
    the best language is right to its lead in nats) and, by language, the cross-entropy four
    deviations above the mean of right texts, beyond which a prediction is not accepted.
    Then these rows are counted too, so that the models returned know all texts and all languages.
    """
    known = texts.where("lang is not null and text is not null").select("text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    aside = F.pmod(F.col("h"), F.lit(CALIBRATION_PART)) == 0
    tables = scratch(texts.sparkSession, "languages")
    counts = tables.save(run_counts(known.where(~aside)))
    parts = model_parts(counts, tables, cells)
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    every = counts.unionByName(run_counts(known.where(aside))).groupBy("lang", "run").agg(F.sum("n").alias("n"))
    every = tables.save(every)
    final = model_parts(every, tables, cells)
    if not final:
        return LanguageIdentifier([], [], np.zeros(2), {})
    all_langs = sorted(r.lang for r in every.select("lang").distinct().collect())
    if not parts:
        return LanguageIdentifier(final, all_langs, np.array([0.0, 1.0]), {})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entropies, n = _entropies(parts, batch["text"])
            yield pa.RecordBatch.from_arrays(
                [batch["h"], batch["lang"], pa.array(n), pa.array(list(entropies), pa.list_(pa.float64()))],
                names=["h", "lang", "n", "entropies"],
            )

    measured = known.where(aside).mapInArrow(measure, "h long, lang string, n long, entropies array<double>")
    rows = measured.where("n > 0").orderBy("h").limit(calibration).toPandas()
    if not len(rows):
        return LanguageIdentifier(final, all_langs, np.array([0.0, 1.0]), {})
    entropies, n = np.array(rows["entropies"].tolist()), rows["n"].to_numpy()
    best = np.array(langs, dtype=object)[entropies.argmin(axis=1)]
    right = best == rows["lang"].to_numpy()
    weights = logistic(_margin(entropies, n)[:, None], right)
    lowest = entropies.min(axis=1)
    worst = {x: float(lowest[own].mean() + 4 * lowest[own].std() + 1 / own.sum()) for x in set(best[right]) for own in [right & (best == x)]}
    return LanguageIdentifier(final, all_langs, weights, worst)


def identify_languages(docs: DataFrame, identifier: LanguageIdentifier, text: str | Column = "text") -> DataFrame:
    """All rows of ``docs`` with lang_pred, score, accepted, cross_entropy and runner_up, from the text alone.

    ``score`` is the calibrated chance that lang_pred is right. A null text, or one without
    letters, is ``und`` with score 0, not accepted. If nothing could be learnt, so is every text.
    Ties go to the language that sorts first. Columns of the output's names are replaced,
    others pass through; equal texts have equal results.
    """

    @F.arrow_udf("lang_pred string, score double, accepted boolean, cross_entropy double, runner_up string")
    def predict(column: pa.Array) -> pa.Array:
        return identifier.predict(column)

    base = freed(docs, *OUTPUT)
    source = F.col(text) if isinstance(text, str) else text
    return base.withColumn("__mg_lang", predict(source)).select(*base.columns, "__mg_lang.*")


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % of
