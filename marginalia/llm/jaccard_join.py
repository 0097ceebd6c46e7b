"""Near duplicates by a grouped prefix join on five-word shingles.

A pair with Jaccard similarity of at least t shares a token in the first n - ceil(t n) + 1 tokens
of both sets, if all sets are sorted alike. Tokens are sorted rarest first, so a document whose
prefix holds only tokens of its own is out at once, and frequent passages are in few prefixes.

1. Tokens are counted over the whole corpus. They travel in sorted blocks of a few bytes a token,
   and only those that occur in two sets come back.
2. Sets that share a prefix token, over any number of steps, form a cluster; every link lies in
   one. Sets travel to their cluster once.
3. In a cluster, sets with the same prefix and size are one group. Pairs of groups are filtered by
   size and position, then members are verified, unless they are connected already.
4. Clusters too large for one task are cut into blocks. Each block is joined on its own, then a few
   members of each component with one another, and last all pairs of blocks of those sets that
   still share a prefix token with another component. So no task is unbounded, no link is
   lost, and a large group of near copies is connected without all its pairs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.llm.common import scratch, shingle_hashes, strings, text_words, tidy
from marginalia.llm.graph import components

#: Two sets are linked if 100 * intersection >= PERCENT * union.
PERCENT = 75
WIDTH = 5
#: Tokens that a task sends off at once, and that a counting task receives at about.
BATCH_TOKENS = 1_000_000
BUCKET_TOKENS = 1 << 20
TOKEN_BITS = 40
#: Sets, and tokens of sets, in one block of a cluster.
BLOCK_SETS = 512
BLOCK_TOKENS = 1_000_000
#: Members of a component that stand for it before the last, exact pass.
MEMBERS = 4
BLOB = "bucket int, part long, low binary, high binary, doc binary, df binary"


def _sets(column, width: int) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        for words in text_words(*strings(column)):
            yield np.unique(shingle_hashes(words, width))


def _key(tokens: np.ndarray) -> int:
    """A hash of a set; no tokens, no key."""
    with np.errstate(over="ignore"):
        spread = (tokens ^ (tokens >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return int((spread ^ (spread >> np.uint64(32))).sum(dtype=np.uint64).astype(np.int64))


def with_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs`` with ``__mg_set``: the number of shingles and a hash of all of them (null without any)."""

    @F.arrow_udf("n int, key long")
    def sizes(text: pa.Array) -> pa.Array:
        n, keys = [], []
        for tokens in _sets(text, width):
            n.append(len(tokens))
            keys.append(_key(tokens) if len(tokens) else None)
        tidy()
        return pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(keys, pa.int64())], names=["n", "key"])

    return docs.withColumn("__mg_set", sizes(F.col("text")))


def _send(docs: DataFrame, width: int, bucket_bits: int) -> DataFrame:
    """Blocks of tokens by bucket: in ``low`` and ``high`` the tokens, in ``doc`` the set's number in its part.

    One more row a part lists its sets: keys in ``low``, sizes in ``doc``. A part is a run of rows of one
    task, so ``docs`` must give a task the same rows in the same order when it runs again, as files do.
    """
    shift = np.uint64(64 - bucket_bits)

    def rows(part: int, tokens: list[np.ndarray], keys: list[int]) -> Iterator[dict]:
        n = np.array([len(t) for t in tokens], dtype=np.uint32)
        flat = np.concatenate(tokens)
        own = np.repeat(np.arange(len(tokens), dtype=np.uint16), n)
        order = np.argsort(flat)
        flat, own = flat[order], own[order]
        short = flat >> np.uint64(64 - bucket_bits - TOKEN_BITS)
        low, high = short.astype(np.uint32), (short >> np.uint64(32)).astype(np.uint8)
        bounds = np.searchsorted(flat >> shift, np.arange((1 << bucket_bits) + 1, dtype=np.uint64))
        for bucket in np.flatnonzero(bounds[1:] > bounds[:-1]):
            a, b = bounds[bucket], bounds[bucket + 1]
            yield {"bucket": int(bucket), "part": part, "low": low[a:b].tobytes(), "high": high[a:b].tobytes(), "doc": own[a:b].tobytes(), "df": None}
        spread = part % (1 << bucket_bits)
        yield {"bucket": spread, "part": part, "low": np.array(keys, dtype=np.int64).tobytes(), "high": None, "doc": n.tobytes(), "df": None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 24
        schema = pa.schema([("bucket", pa.int32()), ("part", pa.int64()), *[(c, pa.binary()) for c in ("low", "high", "doc", "df")]])
        held: dict[int, np.ndarray] = {}
        size = 0
        for batch in batches:
            for tokens in _sets(batch["text"], width):
                if not len(tokens):
                    continue
                key = _key(tokens)
                if key in held:  # the same set again
                    continue
                held[key] = tokens
                size += len(tokens)
                if size >= BATCH_TOKENS or len(held) == 1 << 16:
                    yield pa.RecordBatch.from_pylist(list(rows(part, list(held.values()), list(held))), schema)
                    held, size, part = {}, 0, part + 1
                    tidy()
        if held:
            yield pa.RecordBatch.from_pylist(list(rows(part, list(held.values()), list(held))), schema)
        held = {}
        tidy()

    return docs.select("text").mapInArrow(run, BLOB)


def _counted(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Of one bucket: each block back to its part, with the tokens that occur twice and their counts."""
    rows = table.to_pylist()
    blocks = [r for r in rows if r["high"] is not None]
    out = [r for r in rows if r["high"] is None]
    if blocks:
        tokens = [
            np.frombuffer(r["low"], np.uint32).astype(np.uint64) | (np.frombuffer(r["high"], np.uint8).astype(np.uint64) << np.uint64(32))
            for r in blocks
        ]
        _, inverse, counts = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        df, at = counts[inverse].astype(np.uint32), 0
        for r, t in zip(blocks, tokens, strict=True):
            own = df[at : at + len(t)]
            at += len(t)
            twice = own > 1
            if twice.any():
                for name, kind in (("low", np.uint32), ("high", np.uint8), ("doc", np.uint16)):
                    r[name] = np.frombuffer(r[name], kind)[twice].tobytes()
                out.append({**r, "df": own[twice].tobytes()})
        tidy()
    return pa.Table.from_pylist(out, table.schema)


def _assembled(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Of one part: each set whose prefix reaches a token that occurs elsewhere, its tokens rarest first."""
    rows = table.to_pylist()
    names = [r for r in rows if r["high"] is None]
    blocks = sorted((r for r in rows if r["high"] is not None), key=lambda r: r["bucket"])
    out: dict[str, list] = {"node": [], "n": [], "reach": [], "tokens": []}
    if blocks and names:
        keys, sizes = np.frombuffer(names[0]["low"], np.int64), np.frombuffer(names[0]["doc"], np.uint32)
        joined = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in blocks])
        bucket = np.concatenate([np.full(len(r["high"]), r["bucket"], dtype=np.uint64) for r in blocks])
        tokens = joined("low", np.uint32).astype(np.uint64) | (joined("high", np.uint8).astype(np.uint64) << np.uint64(32))
        tokens |= bucket << np.uint64(TOKEN_BITS)
        own, df = joined("doc", np.uint16), joined("df", np.uint32)
        order = np.lexsort((tokens, df, own))
        own, tokens = own[order], tokens[order].astype(np.int64)
        bounds = np.searchsorted(own, np.arange(len(keys) + 1))
        for i, (node, n) in enumerate(zip(keys, sizes, strict=True)):
            mine = tokens[bounds[i] : bounds[i + 1]]
            # Tokens that nothing else has come first; what they leave of the prefix is its reach.
            reach = int(n) - -(-PERCENT * int(n) // 100) + 1 - (int(n) - len(mine))
            if reach > 0:
                for name, value in zip(out, (int(node), int(n), reach, mine), strict=True):
                    out[name].append(value)
        tidy()
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
    return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds, strict=True)})


def _linked(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> bool:
    """Whether sets of sizes n_a and n_b, with a and b (sorted) the tokens that others have too, are alike enough."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (n_a + n_b - both)


def verified(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) that connect the sets of one block, or of two (``side`` 0 and 1: pairs across only).

    Sets arrive with the component they are known to be in. A pair is only tested while its two
    sides are not connected, so of a connected group there are as many links as sets, not pairs.
    """
    pdf = pdf.drop_duplicates("node").sort_values(["n", "node"], ignore_index=True)
    nodes, n, reach, side = (pdf[c].to_numpy() for c in ("node", "n", "reach", "side"))
    rarest = pdf["tokens"].tolist()
    tokens = [np.sort(t) for t in rarest]
    across = len(set(side)) > 1
    first: dict[int, int] = {}
    parent = list(range(len(pdf)))
    for i, component in enumerate(pdf["component"]):
        parent[i] = first.setdefault(component, i)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    # Groups of one prefix and size, and for each token the groups that have it, with its place in the prefix.
    groups: dict[tuple, list[int]] = defaultdict(list)
    for i, t in enumerate(rarest):
        groups[(n[i], len(tokens[i]), t[: reach[i]].tobytes())].append(i)
    lists: dict[int, list[tuple[int, int]]] = defaultdict(list)
    members, links = list(groups.values()), []

    def test(i: int, j: int) -> None:
        if root(i) != root(j) and not (across and side[i] == side[j]) and _linked(tokens[i], tokens[j], n[i], n[j]):
            parent[root(i)] = root(j)
            links.append((nodes[i], nodes[j]))

    for g, own in enumerate(members):  # ascending sizes
        for x in range(1, len(own)):
            for y in range(x):
                test(own[x], own[y])
        size, alone = int(n[own[0]]), int(n[own[0]]) - len(tokens[own[0]])
        shared: dict[int, int] = {}
        for place, token in enumerate(rarest[own[0]][: reach[own[0]]]):
            for other, other_place in lists[token]:
                if other not in shared:
                    small = int(n[members[other][0]])
                    if 100 * small >= PERCENT * size:
                        # Of the first shared token on, no more can be common than either side has left.
                        most = min(size - alone - place, small - other_place)
                        need = -(-PERCENT * (size + small) // (100 + PERCENT))
                        shared[other] = most >= need
            lists[token].append((g, alone + place))
        for other, possible in shared.items():
            if possible:
                for i in own:
                    for j in members[other]:
                        test(i, j)
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def _blocks(sets: DataFrame, clusters: DataFrame, tables) -> DataFrame:
    """``sets`` with their cluster, and how many blocks it takes and which is theirs."""
    placed = sets.join(clusters.select("node", F.col("root").alias("cluster")), "node")
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("sets"), F.sum(F.size("tokens")).alias("tokens"))
    parts = F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("tokens") / BLOCK_TOKENS)).cast("int")
    placed = placed.join(sizes.select("cluster", parts.alias("blocks")), "cluster")
    return tables.save(placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))


def _clusters(postings: DataFrame, tables) -> DataFrame:
    """(node, root) over sets that share a token of ``postings`` (token, node)."""
    least = postings.groupBy("token").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most")
    least = tables.save(least.select("token", "b"))
    return components(postings.join(least, "token").select(F.col("node").alias("a"), "b"), tables)


def near_duplicate_links(docs: DataFrame, total: int, tables, width: int = WIDTH) -> DataFrame:
    """Links (a, b) between set keys that connect all sets of ``docs`` (text) that similarity connects."""
    bucket_bits = min(64 - TOKEN_BITS, max(6, (total // BUCKET_TOKENS).bit_length()))
    counted = _send(docs, width, bucket_bits).groupBy("bucket").applyInArrow(_counted, BLOB)
    sets = counted.groupBy("part").applyInArrow(_assembled, "node long, n int, reach int, tokens array<long>")
    sets = tables.save(sets)
    postings = tables.save(
        sets.select("node", F.explode(F.slice("tokens", F.lit(1), F.col("reach"))).alias("token")).distinct()
    )
    schema = "a long, b long"
    names = ["node", "n", "reach", "tokens", "side", "component"]
    # Copies of a set in several parts have the same tokens in the same order.
    sets = tables.save(sets.dropDuplicates(["node"]))
    placed = _blocks(sets, _clusters(postings, tables), tables)
    first = placed.withColumn("side", F.lit(0)).withColumn("component", F.col("node"))
    links = tables.save(first.groupBy("cluster", "block").applyInPandas(lambda pdf: verified(pdf[names]), schema))
    large = placed.where("blocks > 1").select("node", "n", "reach", "tokens", "cluster")
    large = tables.save(large)
    if not large.limit(1).count():
        return links

    def labelled(links_: DataFrame) -> DataFrame:
        roots = components(links_.join(large.select(F.col("node").alias("a")), "a"), tables)
        known = large.join(roots, "node", "left")
        return known.withColumn("component", F.coalesce("root", "node")).drop("root")

    # A few members of each component of a large cluster.
    nth = F.row_number().over(W.partitionBy("component").orderBy(F.xxhash64("node")))
    few = labelled(links).withColumn("nth", nth).where(F.col("nth") <= MEMBERS)
    many = few.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("blocks"))
    few = few.join(many, "cluster").withColumn("block", F.pmod(F.xxhash64("component"), F.col("blocks")))
    few = few.withColumn("side", F.lit(0))
    more = few.groupBy("cluster", "block").applyInPandas(lambda pdf: verified(pdf[names]), schema)
    links = tables.save(links.unionByName(more))

    # Whatever still shares a prefix token with another component, block by block.
    known = tables.save(labelled(links))
    tokens = known.select("node", "component", F.explode(F.slice("tokens", F.lit(1), F.col("reach"))).alias("token"))
    open_ = tokens.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    tokens = tables.save(tokens.join(open_.select("token"), "token").select("token", "node"))
    again = _blocks(known.drop("cluster"), _clusters(tokens, tables), tables)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = again.withColumn("other", other)
    pairs = pairs.withColumn("lower", F.least("block", "other")).withColumn("upper", F.greatest("block", "other"))
    pairs = pairs.withColumn("side", (F.col("block") == F.col("upper")).cast("int") * (F.col("lower") != F.col("upper")).cast("int"))
    last = pairs.groupBy("cluster", "lower", "upper").applyInPandas(lambda pdf: verified(pdf[names]), schema)
    return tables.save(links.unionByName(last))


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, key, root) for each row of ``docs`` (doc_id, text).

    A set is the distinct five-word shingles of the text with A-Z lower-cased; the whole sequence
    of words if there are fewer. Rows without words have n_shingles 0, key null and their own doc_id
    as component_id. ``component_id`` is the least doc_id over links, null ids left aside; rows with
    equal sets are linked. ``root`` names the component even where ids repeat or are null.
    Repeated rows are each returned. Tokens are compared by 47 or more bits
    of a hash, whole sets by 64. ``docs`` should be a table scan (see ``_send``).
    """
    tables = scratch(docs.sparkSession, "near")
    texts = docs.select("doc_id", "text")
    base = tables.save(with_sets(texts, width).select("doc_id", "__mg_set.*"))
    total = base.agg(F.sum("n")).first()[0] or 0
    links = near_duplicate_links(texts, total, tables, width)
    roots = components(links, tables)
    nodes = base.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    nodes = nodes.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    nodes = tables.save(nodes)
    least = nodes.groupBy("root").agg(F.min("least").alias("component"))
    found = tables.save(nodes.join(least, "root").select("key", "component", "root"))
    return base.join(found, "key", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        "key",
        "root",
    )


def one_of_each(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row with the least doc_id stays.

    Of rows that share that doc_id, the one with the least text hash stays. Rows without words all stay.
    """
    tables = scratch(docs.sparkSession, "near")
    marks = near_duplicates(docs, width).where("key is not null")
    chosen = marks.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("keep"))
    place = ["__mg_key", "__mg_id", "__mg_none"]

    def placed(rows: DataFrame, key: str, doc_id: str) -> DataFrame:
        id_ = F.coalesce(F.col(doc_id).cast("long"), F.lit(0))
        return rows.withColumns(dict(zip(place, (F.col(key), id_, F.col(doc_id).isNull()), strict=True)))

    chosen = placed(chosen, "keep.key", "keep.doc_id").select(*place, F.lit(True).alias("__mg_keep"))
    chosen = tables.save(chosen)
    # Join and window agree in their keys, so texts cross the network once.
    rows = placed(with_sets(docs, width), "__mg_set.key", "doc_id").join(chosen, place, "left")
    nth = F.row_number().over(W.partitionBy(*place).orderBy(F.xxhash64("text")))
    kept = rows.where("__mg_key is null or __mg_keep").withColumn("__mg_nth", nth)
    return kept.where("__mg_key is null or __mg_nth = 1").select(*docs.columns)
