"""Pack tokenized documents into sequences of one length by bin completion.

Only lengths matter to packing, and there are no more lengths than tokens in a sequence. So
pieces are counted by length over the whole corpus, the packing is searched on those counts,
and pieces are dealt to the places found by their number within their length. The search is
the same work for any number of documents.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import GAP, partitions, scratch, span_hashes, strings, tidy

CAPACITY = 4096
END_ID = 1
#: Steps of the search after which the best packing so far is kept, and fillings tried in full before any is tried fewer times.
STEPS = 1_000_000
BRANCHES = 6
SLICE = 2 << 20
#: Words whose ids a Python worker keeps from one task to the next; beyond it, it starts anew.
KNOWN = 1 << 20
#: Parts words that are tokenized together.
PART = "\x01"
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


# ---------------------------------------------------------------- the search


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs: by total length, and with pieces over each threshold kept apart."""
    if not counts:
        return 0
    lengths = sorted(counts)
    count, total = [0], [0]
    for length in lengths:
        count.append(count[-1] + counts[length])
        total.append(total[-1] + counts[length] * length)
    half = bisect_right(lengths, capacity // 2)
    over = count[-1] - count[half]
    best = max(over, -(-total[-1] // capacity))
    for i, small in enumerate(lengths[:half]):
        top = bisect_right(lengths, capacity - small)
        room = (count[top] - count[half]) * capacity - (total[top] - total[half])
        best = max(best, over + max(0, -(-(total[half] - total[i] - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> tuple[Counter, int]:
    """{filling: times} of best-fit decreasing, and the steps it took; equal sequences are filled together."""
    open_: dict[int, Counter] = {}
    rooms: list[int] = []  # the keys of open_, ascending
    steps = 0

    def add(room: int, filling: tuple[int, ...], times: int) -> None:
        if room not in open_:
            open_[room] = Counter()
            insort(rooms, room)
        open_[room][filling] += times

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            steps += 1
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                for n, times in ((each, left // each), (left % each, 1)):
                    if n and times:
                        add(capacity - n * length, (length,) * n, times)
                break
            room = rooms[at]
            filling, times = next(iter(open_[room].items()))
            each = min(room // length, left)
            used = min(times, left // each)
            if used == times:
                del open_[room][filling]
            else:
                open_[room][filling] -= used
            if not open_[room]:
                del open_[room], rooms[at]
            add(room - each * length, filling + (length,) * each, used)
            left -= used * each
    done: Counter = Counter()
    for fillings_ in open_.values():
        done.update(fillings_)
    return done, steps


def _dominated(filling: tuple[int, ...], waste: int, unused: Callable[[int, int], bool]) -> bool:
    """Whether a piece that is left can stand in for some of the filling's pieces: then the filling need not be tried.

    ``unused(least, most)`` says if a piece of such a length is left. Of long fillings only single pieces and pairs are tested.
    """
    some = range(1, len(filling) + 1 if len(filling) <= 6 else 3)
    return any(unused(sum(part) + (k == 1), sum(part) + waste) for k in some for part in set(combinations(filling, k)))


def fillings(counts: dict[int, int], room: int) -> Iterator[tuple[int, ...] | None]:
    """All undominated ways to fill ``room``, each once, as they are asked for; None after a step that finds none.

    First come those that start with one in 64 of the lengths and go on by best fit, least waste first.
    """
    present = sorted(x for x, n in counts.items() if n and x <= room)
    if not present:
        yield ()
        return
    used: Counter = Counter()

    def largest(most: int) -> int:
        """Place of the greatest length up to ``most`` of which a piece is left, -1 without one."""
        at = bisect_right(present, most) - 1
        while at >= 0 and counts[present[at]] <= used[present[at]]:
            at -= 1
        return at

    def unused(least: int, most: int) -> bool:
        at = largest(most)
        return at >= 0 and present[at] >= least

    starts = []
    for first in [present[-1], *present[:: -max(1, len(present) // 64)]]:
        out, rest = [first], room - first
        used.clear()
        used[first] = 1
        while (at := largest(rest)) >= 0:
            out.append(present[at])
            used[present[at]] += 1
            rest -= present[at]
        filling = tuple(sorted(out, reverse=True))
        if not _dominated(filling, rest, unused):
            starts.append(filling)
    known = set(starts)
    yield from sorted(known, key=lambda f: (room - sum(f), len(f), [-x for x in f]))

    used.clear()
    chosen: list[int] = []
    rest, at = room, largest(room)
    while True:
        if at >= 0:  # one more piece, not longer than the last
            chosen.append(at)
            used[present[at]] += 1
            rest -= present[at]
            at = largest(min(rest, present[at]))
            yield None
            continue
        filling = tuple(present[i] for i in chosen)
        if filling not in known and not _dominated(filling, rest, unused):
            yield filling
        while at < 0 and chosen:  # a shorter piece in the last one's place; with none, one place further up
            last = present[chosen.pop()]
            used[last] -= 1
            rest += last
            at = largest(last - 1)
        if at < 0:
            return


def _completions(left: dict[int, int], capacity: int) -> Iterator[tuple[tuple[int, ...], int] | None]:
    """(sequence, times) for the largest piece: BRANCHES fillings as often as there are pieces, then these fewer times, then the next."""
    largest = max(left)
    found = fillings({**left, largest: left[largest] - 1}, capacity - largest)
    first: list[tuple[tuple[int, ...], int]] = []
    for filling in found:
        if filling is None:
            yield None
            continue
        whole = (largest, *filling)
        most = min(left[x] // n for x, n in Counter(whole).items())
        yield whole, most
        first.append((whole, most // 2))
        if len(first) >= BRANCHES:  # from now on each at once
            yield from _fewer(first)
            first.clear()
    yield from _fewer(first)


def _fewer(sequences: list[tuple[tuple[int, ...], int]]) -> Iterator[tuple[tuple[int, ...], int]]:
    """Half as often and so on down to once: any number of times is a sum of these."""
    for whole, times in sequences:
        while times:
            yield whole, times
            times //= 2


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> Counter:
    """{filling: times}: a packing of ``counts`` pieces by length, as short as the search finds.

    Branch and bound: the largest piece left is completed by each undominated filling in turn, a
    filling is used for as many equal sequences as there are pieces for and then for fewer. A branch
    is left when the sequences so far plus the bound for the rest, which is the waste it may
    still make, reach the incumbent. Best-fit decreasing is the first incumbent, and its way on
    from each node a new one. Fillings are made when the search comes back for them. It ends when
    an incumbent meets the bound, when all is tried, or after ``steps`` steps.
    """
    best, _ = best_fit(counts, capacity)
    bound = lower_bound(counts, capacity)
    if best.total() <= bound:
        return best
    stack = [(dict(counts), Counter(), _completions(counts, capacity))]
    while stack and steps > 0 and best.total() > bound:
        left, done, ways = stack[-1]
        way = next(ways, False)
        steps -= 1
        if way is False:
            stack.pop()
        if not way:
            continue
        whole, times = way
        need = Counter(whole)
        after = {x: m for x, n in left.items() if (m := n - times * need.get(x, 0))}
        now = done + Counter({whole: times})
        if now.total() + lower_bound(after, capacity) >= best.total():
            steps -= len(after)
            continue
        way_on, taken = best_fit(after, capacity)
        way_on, steps = now + way_on, steps - taken - len(after)
        if way_on.total() < best.total():
            best = way_on
        if after:
            stack.append((after, now, _completions(after, capacity)))
    return best


def places(packing: Counter) -> dict[str, np.ndarray]:
    """Runs of places by length: from number ``rank`` on, ``each`` to a sequence, from ``sequence`` and ``offset`` on."""
    rows, ranks, sequence = [], Counter(), 0
    for filling, times in sorted(packing.items(), reverse=True):
        offset = 0
        for length, each in sorted(Counter(filling).items(), reverse=True):
            rows.append((length, ranks[length], each, sequence, offset))
            ranks[length] += each * times
            offset += each * length
        sequence += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), table.T, strict=True))


# ---------------------------------------------------------------- tokens


def _units(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; a comma or full stop that ends a word after a letter stands alone.

    The tokenizer never joins two such units, so their ids can be found one by one.
    """
    inside = np.concatenate(([False], ~GAP[data], [False]))
    mark = np.zeros(len(data) + 2, dtype=bool)
    mark[1:-1] = ((data == 44) | (data == 46)) & ~inside[2:]
    mark[2:-1] &= _LETTER[data[:-1]]
    mark[1:2] = False
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | mark[1:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | mark[2:])) + 1
    return starts, ends


class Words:
    """Ids of texts, word by word: a word is tokenized when it is new."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        ids = self.tokenizer.encode(PART, add_special_tokens=False).ids
        self.part = ids[0] if len(ids) == 1 else None
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.first = np.zeros(0, dtype=np.int32)
        self.n = np.zeros(0, dtype=np.int32)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32) for e in found]

    def tokenized(self, words: list[str], together: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids one after another."""
        apart = [words[i : i + together] for i in range(0, len(words), together)]
        counts, flat = [], []
        for some, ids in zip(apart, self._ids([f" {PART} ".join(w) for w in apart]), strict=True):
            cuts = np.flatnonzero(ids == self.part) if self.part is not None else []
            if len(cuts) != len(some) - 1:  # the mark, or its id, is in a word
                each = self._ids(some)
                n, ids = np.array([len(x) for x in each], dtype=np.int64), np.concatenate(each)
            else:
                n = np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1
                ids = np.delete(ids, cuts)
            counts.append(n)
            flat.append(ids)
        return np.concatenate(counts), np.concatenate(flat)

    def learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Add words under sorted new keys."""
        n, flat = self.tokenized(words)
        first = len(self.ids) + np.cumsum(n) - n
        at = np.searchsorted(self.keys, keys)
        self.keys, self.first, self.n = (np.insert(a, at, b) for a, b in ((self.keys, keys), (self.first, first), (self.n, n)))
        self.ids = np.concatenate((self.ids, flat))

    def encode(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts of words, number of ids up to each word's end, ids) of UTF-8 bytes."""
        starts, ends = _units(data)
        hashes = span_hashes(data, starts, ends)
        keys, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > KNOWN:
            self.clear()
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = self.keys[at] != keys if len(self.keys) else np.ones(len(keys), dtype=bool)
        if new.any():
            raw = data.tobytes()
            self.learn(keys[new], [raw[starts[i] : ends[i]].decode() for i in where[new]])
        at = np.searchsorted(self.keys, keys)[inverse] if len(keys) else inverse
        n, first = self.n[at].astype(np.int64), self.first[at]
        upto = np.cumsum(n)
        ids = self.ids[np.repeat(first - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]
        return starts, upto, ids


_WORDS: dict[str, Words] = {}


def _words(path: str) -> Words:
    """This Python worker's words; they outlive a task, as Spark uses workers again."""
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's ids and the end id, cut at ``capacity``.

    A null or empty text is the end id alone. ``tokenizer_path`` must be there on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer_path)
        for batch in batches:
            data, offsets = strings(batch["text"])
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1)
                bounds = offsets[i : j + 1] - offsets[i]
                # Each text is given white space of its own, so that no word runs over its end.
                spread = np.full(int(bounds[-1]) + j - i, 32, dtype=np.uint8)
                keep = np.ones(len(spread), dtype=bool)
                keep[bounds[1:] + np.arange(j - i)] = False
                spread[keep] = data[offsets[i] : offsets[j]]
                starts, upto, ids = words.encode(spread)
                cuts = np.searchsorted(starts, bounds + np.arange(j - i + 1))
                ends = np.concatenate(([0], upto))[cuts]
                out: dict[str, list] = {c: [] for c in ("row", "piece", "start", "length", "ids_crc32", "ids")}
                for k in range(j - i):
                    own = np.append(ids[ends[k] : ends[k + 1]], np.uint32(END_ID)).astype("<u4")
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        for name, value in zip(out, (i + k, piece, start, len(part), zlib.crc32(part.tobytes()), part), strict=True):
                            if name != "ids" or keep_ids:
                                out[name].append(value)
                doc_ids = batch["doc_id"].take(pa.array(out["row"], pa.int64()))
                columns = [doc_ids, *[pa.array(out[c], t) for c, t in (("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()))]]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in out["ids"]], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
                i = j
            tidy()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False, steps: int = STEPS
) -> DataFrame:
    """One row for each piece of each row of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    Only documents longer than ``capacity`` are cut. Sequence ids are gapless from 0; within a
    sequence, longer pieces come first. Null and empty texts are a piece of one id. Rows that
    agree in doc_id and text give equal pieces, each with a place of its own. Other columns
    are not carried on. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    tables = scratch(spark, "packing")
    pieces = tables.save(tokenized_pieces(docs, tokenizer_path, capacity, keep_ids))
    bins = pieces.withColumn("bin", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(4 * partitions(spark))))
    counted = tables.save(bins.groupBy("length", "bin").agg(F.count("*").alias("rows")))
    by_length = counted.groupBy("length").agg(F.sum("rows").alias("rows")).collect()  # at most one row for each length
    place = places(bin_completion({r.length: r.rows for r in by_length}, capacity, steps))
    before = F.sum("rows").over(W.partitionBy("length").orderBy("bin")) - F.col("rows")
    counted = tables.save(counted.select("length", "bin", before.alias("before")))
    at = F.row_number().over(W.partitionBy("length", "bin").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = bins.withColumn("at", at).join(counted, ["length", "bin"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("at") - 1).drop("bin", "at", "before")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = place["length"] << np.int64(44) | place["rank"]
        for batch in batches:
            length, rank = (batch[c].to_numpy() for c in ("length", "rank"))
            run = np.searchsorted(keys, length << np.int64(44) | rank, side="right") - 1
            number, each = rank - place["rank"][run], place["each"][run]
            sequence = place["sequence"][run] + number // each
            offset = place["offset"][run] + number % each * length
            names = [c for c in batch.schema.names if c != "rank"]
            columns = [batch[c] for c in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    names = [c for c in ranked.columns if c != "rank"]
    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sequence_id long, offset long"
    order = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return ranked.mapInArrow(deal, schema).select(*order, *(["ids"] if keep_ids else []))
