"""SimHash near duplicates: BK-trees over shards of fingerprints that can hold neighbours.

1. A fingerprint's bit is set if more than half of the text's shingle hashes have it. Equal
   fingerprints are one from here on.
2. Two fingerprints that differ in at most two bits agree on one of any three blocks of bits. So each
   fingerprint goes to three shards, one for each block, named by the block and its bits in it. A shard
   of more than ``SHARD`` members is cut again in the same way, by three blocks of the bits it leaves
   open; when no more than log2(``SHARD``) bits are open, it can't hold more. So each pair within
   the radius meets in a shard, shards are bounded, and no fingerprint is in more than a fixed number.
3. Each shard is a BK-tree: children hang at the integer Hamming distance to their parent. A shard's
   tree travels whole to the task that searches it, and a search for each member follows only the
   edges whose distance is within the radius of its own distance to the node. The trees of a batch
   are built and searched together, level by level.
4. A shard yields one link from each member to the least it is connected with, not all pairs;
   links are contracted to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.byte_words import bytes_of, word_lists, word_table
from marginalia.llm.common import freed, scratch, tidy
from marginalia.llm.graph import components

RADIUS = 2
WIDTH = 3
SEED = 42
#: Fingerprints in a shard, and so in a tree, at most; a power of two.
SHARD = 512
#: Pairs of a query and a node that a search looks at together.
FRONTIER = 1 << 18
#: Shingles that are hashed together.
HASHES = 1 << 15
WORDS = word_table(" \t\n\x0b\x0c\r")
BITS = 64
#: The bits of each value of a byte, lowest first.
BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)

# ---------------------------------------------------------------- fingerprints


def simhash(text: bytes | None, width: int = WIDTH) -> int:
    """The fingerprint of a text as an unsigned number; of one without words, 0."""
    from xxhash import xxh64_intdigest

    ones, n = np.zeros(BITS, dtype=np.int64), 0

    def count(words: list[bytes], size: int) -> int:
        """Add the hashes of all runs of ``size`` words."""
        nonlocal ones
        for at in range(0, len(words) - size + 1, HASHES):
            some = words[at : at + HASHES + size - 1]
            joined = b" ".join(some)
            ends = np.cumsum(np.fromiter(map(len, some), dtype=np.int64, count=len(some)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            spans = zip(starts.tolist(), ends[size - 1 :].tolist(), strict=False)
            hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), dtype="<u8")
            octets = hashes.view(np.uint8).reshape(-1, 8)
            ones = ones + np.concatenate([np.bincount(octets[:, i], minlength=256) @ BITS_OF for i in range(8)])
        return max(0, len(words) - size + 1)

    before: list[bytes] = []
    for piece in word_lists(text, WORDS):
        words = before + piece
        n += count(words, width)
        before = words[max(0, len(words) - width + 1) :]
    if not n and before:
        n = count(before, len(before))
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]) if n else 0


def with_fingerprints(docs: DataFrame, name: str, width: int = WIDTH) -> DataFrame:
    """``docs`` (text) with a long ``name``, the fingerprint's 64 bits. A null text counts as empty."""

    @F.arrow_udf("long")
    def fingerprints(column):
        import pyarrow as pa

        found = np.fromiter((simhash(text, width) for text in bytes_of(column)), dtype=np.uint64, count=len(column))
        tidy()
        return pa.array(found.view(np.int64))

    return docs.withColumn(name, fingerprints("text"))


# ---------------------------------------------------------------- shards


def split(open_bits: int) -> list[int]:
    """Three masks that share out the set bits of ``open_bits``, in order."""
    bits = [i for i in range(BITS) if open_bits >> i & 1]
    cuts = [round(len(bits) * i / (RADIUS + 1)) for i in range(RADIUS + 2)]
    return [sum(1 << i for i in bits[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def spread(rows: DataFrame, fixed: list[int]) -> DataFrame:
    """(fp, mask): each member of shards that fix the bits of one of ``fixed``, in its three smaller shards."""
    every = (1 << BITS) - 1
    finer = {mask: [signed(mask | part) for part in split(every & ~mask)] for mask in fixed}
    masks: Column | None = None
    for mask, parts in finer.items():
        masks = F.when(F.col("mask") == signed(mask), F.array(*map(F.lit, parts))) if masks is None else masks.when(
            F.col("mask") == signed(mask), F.array(*map(F.lit, parts))
        )
    return rows.select("fp", F.explode(masks).alias("mask"))


def shards(fingerprints: DataFrame, tables, size: int = SHARD) -> DataFrame:
    """(fp, mask, value) for all shards: their members agree in the bits of ``mask``, which are ``value``.

    No shard has more than ``size`` members, as it is cut while it has and more than log2(size) bits
    are open. Each round counts the shards and goes on with the members of the large ones.
    """
    value = F.col("fp").bitwiseAND(F.col("mask"))
    every, fixed = (1 << BITS) - 1, [0]
    rows, done = fingerprints.select("fp", F.lit(0).cast("long").alias("mask")), None
    while True:
        rows = tables.save(spread(rows, fixed).withColumn("value", value))
        fixed = sorted({mask | part for mask in fixed for part in split(every & ~mask)})
        final = [mask for mask in fixed if 1 << (BITS - mask.bit_count()) <= size]
        fixed = [mask for mask in fixed if mask not in final]
        counts = rows.where(~F.col("mask").isin(list(map(signed, final)))).groupBy("mask", "value").agg(F.count("*").alias("n"))
        large = tables.save(counts.where(F.col("n") > size).select("mask", "value"))
        small = rows.join(large, ["mask", "value"], "left_anti").select("fp", "mask", "value")
        done = small if done is None else done.unionByName(small)
        if not large.limit(1).count():
            return done
        rows = rows.join(large, ["mask", "value"]).select("fp", "mask")


# ---------------------------------------------------------------- trees


def expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of ``count`` numbers from ``first``: which range each number is of, and the numbers."""
    owner = np.repeat(np.arange(len(first)), count)
    starts = np.cumsum(count) - count
    return owner, np.arange(len(owner)) - starts[owner] + first[owner]


class Forest:
    """One BK-tree for each tree number; ``tree`` ascends. The first member of a tree is its root."""

    def __init__(self, values: np.ndarray, tree: np.ndarray):
        self.values, n = values, len(values)
        self.root = np.searchsorted(tree, tree)  # the root of each member's tree
        parent, edge = np.full(n, -1), np.zeros(n, dtype=np.int64)
        rest = np.flatnonzero(self.root != np.arange(n))
        at = self.root[rest]
        while len(rest):
            # Of those that reach a node by the same distance, the first becomes its child there.
            distance = np.bitwise_count(values[rest] ^ values[at]).astype(np.int64)
            _, first, group = np.unique(at * (BITS + 1) + distance, return_index=True, return_inverse=True)
            child = rest[first][group]
            new = rest == child
            parent[rest[new]], edge[rest[new]] = at[new], distance[new]
            rest, at = rest[~new], child[~new]
        self.nodes = np.lexsort((edge, parent))
        self.edges = parent[self.nodes] * (BITS + 1) + edge[self.nodes]

    def neighbours(self, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) of members of one tree within the radius, query > node."""
        for begin in range(0, len(self.values), FRONTIER):
            query = np.arange(begin, min(begin + FRONTIER, len(self.values)))
            waiting = [(query, self.root[query])]
            while waiting:
                query, node = waiting.pop()
                if len(query) > FRONTIER:
                    half = len(query) // 2
                    waiting += [(query[:half], node[:half]), (query[half:], node[half:])]
                    continue
                distance = np.bitwise_count(self.values[query] ^ self.values[node]).astype(np.int64)
                found = (distance <= radius) & (query > node)
                yield query[found], node[found]
                low = np.searchsorted(self.edges, node * (BITS + 1) + np.maximum(distance - radius, 1))
                high = np.searchsorted(self.edges, node * (BITS + 1) + np.minimum(distance + radius, BITS), side="right")
                owner, places = expand(low, high - low)
                if len(owner):
                    waiting.append((query[owner], self.nodes[places]))

    def connected(self, radius: int = RADIUS) -> np.ndarray:
        """For each member, the first of those it is connected with by neighbours."""
        least = np.arange(len(self.values))
        pairs = [(a, b) for a, b in self.neighbours(radius) if len(a)]
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (least[:0], least[:0])
        while True:
            low = np.minimum(least[a], least[b])
            new = least.copy()
            np.minimum.at(new, least[a], low)
            np.minimum.at(new, least[b], low)
            new = new[new]
            if (new == least).all():
                return least
            least = new


def tree_links(sharded: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): for each shard of ``sharded`` (fp, mask, value), links that connect what its tree connects."""

    def run(batches):
        import pyarrow as pa

        def links(table) -> pa.RecordBatch:
            fp, mask, value = (table.column(i).to_numpy() for i in range(3))
            starts = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))))
            size = np.diff(np.append(starts, len(fp)))
            fp = fp[np.repeat(size > 1, size)]  # no tree of one
            tree = np.repeat(np.arange(len(size)), size)[np.repeat(size > 1, size)]
            least = Forest(fp.view(np.uint64), tree).connected(radius)
            some = least != np.arange(len(fp))
            return pa.RecordBatch.from_arrays([pa.array(fp[least[some]]), pa.array(fp[some])], names=["a", "b"])

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            if not len(table):
                continue
            # The last shard may go on in the next batch.
            mask, value = table.column(1).to_numpy(), table.column(2).to_numpy()
            last = len(table) - int(np.argmax(((mask != mask[-1]) | (value != value[-1]))[::-1]))
            last = 0 if last == len(table) and (mask == mask[-1]).all() and (value == value[-1]).all() else last
            if last:
                yield links(table.slice(0, last))
            rest = table.slice(last).combine_chunks()
        if rest is not None and len(rest):
            yield links(rest)
        tidy()

    sharded = sharded.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
    return sharded.mapInArrow(run, "a long, b long")


def fingerprint_components(fingerprints: DataFrame, tables, size: int = SHARD) -> DataFrame:
    """(node, root) for the fingerprints (fp, distinct) that have others within the radius."""
    return components(tree_links(shards(fingerprints, tables, size)), tables)


def simhash_duplicates(docs: DataFrame, width: int = WIDTH, size: int = SHARD) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) with fingerprint and component_id.

    Words are runs without white space, A-Z lower-cased; the fingerprint is of all runs of
    ``width`` words, repeats included, and of the whole sequence if there are fewer. A null or
    empty text, or one without words, has fingerprint 0, which is linked like any other.
    ``component_id`` is the least doc_id that links of at most two differing bits reach, null ids left
    aside; null if all are null. Rows with equal fingerprints are linked, so repeated rows
    agree. Columns of the output's names are replaced, others pass through.
    """
    tables = scratch(docs.sparkSession, "simhash")
    base = freed(docs, "fingerprint", "component_id", "__mg_fp")
    marked = tables.save(with_fingerprints(base, "__mg_fp", width))
    least = tables.save(marked.groupBy(F.col("__mg_fp").alias("fp")).agg(F.min("doc_id").alias("least")))
    roots = fingerprint_components(least.select("fp"), tables, size)
    placed = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = tables.save(placed)
    component = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    found = tables.save(placed.join(component, "root").select(F.col("fp").alias("__mg_fp"), "component_id"))
    digits = F.lower(F.lpad(F.hex("__mg_fp"), 16, "0"))
    return marked.join(found, "__mg_fp").withColumn("fingerprint", digits).select(*base.columns, "fingerprint", "component_id")
