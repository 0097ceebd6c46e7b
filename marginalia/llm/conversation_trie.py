"""The prefix trie of conversations: adaptive radix trees over turn ids, joined where they meet.

1. A turn's id is the 16-byte digest of its role and text, so a conversation is a key of fixed-width
   big-endian ids. Turns get their places from one distributed sort, not per conversation.
2. A key is cut into segments of ``SEGMENT`` turns. A segment's path names all turns up to its end; equal
   paths are one unit, with how many conversations take it, the least of them, and how many go on.
3. Units are sorted by ranges. Every batch of sorted units becomes adaptive radix trees in memory: nodes
   have room for 4, 16, 48 or 256 children and grow as needed, bytes without a fork are kept as one
   compressed path, and only byte depths that are whole turns give nodes of the trie.
4. A node whose members are all in its batch is final there. The others are *open*: those on the paths of the
   batch's first and last unit, and those above segments that go on. Open nodes come as parts, which are
   added up by path; sums over their subtrees are found by doubling, so their depth costs rounds
   in its logarithm only.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.byte_words import numbered
from marginalia.llm.common import scratch, text_of

#: Bytes of a turn's id.
ID = 16
#: Turns in a segment.
SEGMENT = 128
#: Conversation ids that are joined at once for the hash of those that end at a node.
IDS = 4096
NONE_END = hashlib.sha256(b"").hexdigest()

# ---------------------------------------------------------------- turns


def binary_md5(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def turn_ids(conversations: DataFrame, tables) -> DataFrame:
    """(conv_id, at, id, n_bytes) of each turn: its place in its conversation, its id, UTF-8 bytes of its text.

    Turns are in order of turn (null first), then role and text. A null role or text is empty;
    rows without a conv_id belong to no conversation.
    """
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        text_of(F.col("role")).alias("role"),
        text_of(F.col("text")).alias("text"),
    )
    digest = binary_md5(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    keep = ["conv_id", digest.alias("id"), F.octet_length("text").cast("long").alias("n_bytes")]
    rows = tables.save(numbered(rows, order, "__mg_at", tables, keep))
    firsts = tables.save(rows.groupBy("conv_id").agg(F.min("__mg_at").alias("__mg_first")))
    at = F.col("__mg_at") - F.col("__mg_first")
    return tables.save(rows.join(firsts, "conv_id").select("conv_id", at.alias("at"), "id", "n_bytes"))


def shared_starts(turns: DataFrame, conversations: DataFrame, group: int = 5, kinds: int = 9) -> DataFrame:
    """``turns`` with the start of each conversation c replaced by that of c - c % group.

    Its first crc32(c) % kinds turns (all it has, if fewer; none if it is absent) come from there, and
    then its own turns after as many. ``conversations`` (conv_id) has every c once.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % kinds
    plan = conversations.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    lengths = turns.groupBy(F.col("conv_id").alias("base")).agg(F.count("*").alias("length"))
    plan = plan.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("length", F.lit(0))))
    own = turns.join(plan, "conv_id").where("at >= h")
    own = own.select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "id", "n_bytes")
    starts = turns.where(F.col("at") < kinds - 1).withColumnRenamed("conv_id", "base")
    starts = starts.join(plan.select("conv_id", "base", "taken"), "base").where("at < taken")
    return own.unionByName(starts.select("conv_id", "at", "id", "n_bytes"))


# ---------------------------------------------------------------- units


def units_of(turns: DataFrame, conversations: DataFrame, tables, segment: int = SEGMENT) -> DataFrame:
    """The distinct segments of all conversations.

    layer: the segment's number; above: path of the segments before; path: above and this one; key: its
    ids in a row; lengths: bytes of its turns' texts; n: conversations that take it; conv_id: the
    least; going_on: whether some have a segment after it; ends: hash of the ids of those that don't.
    """
    place = F.sort_array(F.collect_list(F.struct((F.col("at") % segment).alias("at"), "id", "n_bytes")))
    parts = turns.groupBy("conv_id", F.floor(F.col("at") / segment).alias("layer")).agg(place.alias("turns"))
    # Ids have one width, so joining their hex digits joins their bytes.
    key = F.unhex(F.array_join(F.transform("turns.id", lambda x: F.hex(x)), ""))
    parts = parts.select("conv_id", "layer", key.alias("key"), F.col("turns.n_bytes").alias("lengths"))
    turnless = conversations.select("conv_id").join(parts.where("layer = 0").select("conv_id"), "conv_id", "left_anti")
    empty = turnless.select(
        "conv_id", F.lit(0).cast("long").alias("layer"), F.lit(b"").alias("key"), F.array().cast("array<bigint>").alias("lengths")
    )
    parts = parts.unionByName(empty).withColumn("path", binary_md5(F.col("key")))
    parts = tables.save(parts)
    # Paths by doubling: after k rounds a path names the 2**k segments up to its own.
    long_ = parts.where("layer > 0").select("conv_id").distinct()
    paths = tables.save(parts.select("conv_id", "layer", "path").join(long_, "conv_id"))
    top, reach = paths.agg(F.max("layer")).first()[0] or 0, 1
    while reach <= top:
        before = paths.select("conv_id", (F.col("layer") + reach).alias("layer"), F.col("path").alias("before"))
        joined = paths.join(before, ["conv_id", "layer"], "left")
        path = F.when(F.col("before").isNull(), F.col("path")).otherwise(binary_md5(F.col("before"), F.col("path")))
        paths, reach = tables.save(joined.select("conv_id", "layer", path.alias("path"))), 2 * reach
    later = paths.where("layer > 0").select("conv_id", "layer", F.col("path").alias("whole"))
    above = paths.select("conv_id", (F.col("layer") + 1).alias("layer"), F.col("path").alias("above"))
    last = paths.groupBy("conv_id").agg(F.max("layer").alias("last"))
    parts = (
        parts.join(later.join(above, ["conv_id", "layer"]), ["conv_id", "layer"], "left")
        .join(last, "conv_id", "left")
        .select(
            "layer",
            F.coalesce("above", F.lit(b"")).alias("above"),
            F.coalesce("whole", "path").alias("path"),
            "key",
            "lengths",
            "conv_id",
            (F.coalesce("last", F.lit(0)) > F.col("layer")).alias("going_on"),
        )
    )
    parts = tables.save(parts)
    units = parts.groupBy("layer", "above", "path").agg(
        F.first("key").alias("key"),
        F.first("lengths").alias("lengths"),
        F.count("*").alias("n"),
        F.min("conv_id").alias("conv_id"),
        F.max("going_on").alias("going_on"),
    )
    ends = end_hashes(parts.where("not going_on").select("layer", "path", "conv_id"))
    return units.join(ends, ["layer", "path"], "left")


def end_hashes(ended: DataFrame) -> DataFrame:
    """(layer, path, ends): SHA-256 of the ascending decimal conv_ids of ``ended`` (layer, path, conv_id), comma-joined.

    Ids are joined in ranges of ``IDS``. A node's ranges are then hashed one after the other, in one
    task as SHA-256 goes over its input in order, but never held together.
    """
    block = F.floor(F.col("conv_id") / IDS).alias("block")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = ended.groupBy("layer", "path", block).agg(ids.alias("ids"))
    blocks = blocks.repartition("layer", "path").sortWithinPartitions("layer", "path", "block")

    def run(batches):
        import pyarrow as pa

        at, hashed = None, None

        def closed(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.string()))],
                names=["layer", "path", "ends"],
            )

        for batch in batches:
            rows = []
            for layer, path, ids in zip(*(batch.column(name).to_pylist() for name in ("layer", "path", "ids")), strict=True):
                if (layer, path) != at:
                    if at is not None:
                        rows.append((*at, hashed.hexdigest()))
                    at, hashed = (layer, path), hashlib.sha256()
                    hashed.update(ids.encode())
                else:
                    hashed.update(b"," + ids.encode())
            yield closed(rows)
        if at is not None:
            yield closed([(*at, hashed.hexdigest())])

    return blocks.mapInArrow(run, "layer long, path binary, ends string")


# ---------------------------------------------------------------- adaptive radix tree


class Small:
    """Children by sorted bytes, up to ``room`` of them: 4, then 16."""

    def __init__(self, room: int, items=()):
        self.room = room
        self.bytes = bytearray(byte for byte, _ in items)
        self.nodes = [node for _, node in items]

    def get(self, byte: int):
        at = bisect_left(self.bytes, byte)
        return self.nodes[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def put(self, byte: int, node) -> "Small | Indexed":
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.nodes[at] = node
            return self
        if len(self.nodes) == self.room:
            grown = Small(16, list(self)) if self.room == 4 else Indexed(list(self))
            return grown.put(byte, node)
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def __iter__(self):
        return iter(zip(self.bytes, self.nodes, strict=True))


class Indexed:
    """Up to 48 children behind an index of all bytes."""

    def __init__(self, items=()):
        self.index, self.nodes = bytearray(256), []
        for byte, node in items:
            self.put(byte, node)

    def get(self, byte: int):
        at = self.index[byte]
        return self.nodes[at - 1] if at else None

    def put(self, byte: int, node) -> "Indexed | Full":
        if self.index[byte]:
            self.nodes[self.index[byte] - 1] = node
            return self
        if len(self.nodes) == 48:
            return Full(list(self)).put(byte, node)
        self.nodes.append(node)
        self.index[byte] = len(self.nodes)
        return self

    def __iter__(self):
        return ((byte, self.nodes[at - 1]) for byte, at in enumerate(self.index) if at)


class Full:
    """A place for each of 256 bytes."""

    def __init__(self, items=()):
        self.nodes = [None] * 256
        for byte, node in items:
            self.nodes[byte] = node

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node) -> "Full":
        self.nodes[byte] = node
        return self

    def __iter__(self):
        return ((byte, node) for byte, node in enumerate(self.nodes) if node is not None)


class Node:
    """Bytes ``begin`` to ``end`` of unit ``unit``'s key lead here without a fork; ``value`` is the unit that ends here."""

    __slots__ = ("begin", "children", "end", "open", "total", "unit", "value")

    def __init__(self, unit: int, begin: int, end: int, value: int | None = None):
        self.unit, self.begin, self.end, self.value = unit, begin, end, value
        self.children: Small | Indexed | Full = Small(4)


class RadixTree:
    """An adaptive radix tree over ``keys``; the numbers of the keys are its values."""

    def __init__(self, keys: list[bytes]):
        self.keys = keys
        self.root = Node(0, 0, 0)

    def insert(self, unit: int) -> None:
        key, node, at = self.keys[unit], self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                node.children = node.children.put(key[at], Node(unit, at, len(key), unit))
                return
            path = self.keys[child.unit][at : child.end]
            if key.startswith(path, at):
                node, at = child, child.end
                continue
            # The paths part, or the key ends, inside the compressed path.
            same = next((i for i, (a, b) in enumerate(zip(path, key[at:], strict=False)) if a != b), len(key) - at)
            fork = Node(child.unit, at, at + same)
            child.begin = at + same
            fork.children = fork.children.put(path[same], child)
            node.children = node.children.put(key[at], fork)
            node, at = fork, at + same
        node.value = unit

    def top_down(self) -> list[tuple[Node, Node | None]]:
        """Every node with its parent, parents first."""
        out, waiting = [], [(self.root, None)]
        while waiting:
            node, parent = waiting.pop()
            out.append((node, parent))
            waiting += [(child, node) for _, child in node.children]
        return out


NODE = (
    "node binary, above binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, n_bytes long, ends string"
)


def trie_rows(units: list[dict], first: int, last: int, segment: int) -> Iterator[tuple]:
    """Rows (``NODE``) of the nodes that ``units`` of one layer and ``above`` make.

    ``first`` and ``last`` are the units on whose paths nodes are open, or -1. A row with a node name is a
    part of an open node: its sums leave out what is below other open nodes. Other rows are
    final, but for parent_conv_id where above names an open parent.
    """
    layer, above = units[0]["layer"], units[0]["above"]
    tree = RadixTree([u["key"] for u in units])
    for i in range(len(units)):
        tree.insert(i)
    order = tree.top_down()
    depths = {}  # of the whole turns on a node's path
    for node, _ in order:
        depths[node] = range(node.begin // ID + 1, node.end // ID + 1) if node.end else range(1)

    def name(unit: int, depth: int) -> bytes:
        if not depth:
            return above
        if depth == segment:
            return units[unit]["path"]
        return hashlib.md5(above + units[unit]["key"][: depth * ID]).digest()

    state: dict[Node, tuple] = {}
    for node, _ in reversed(order):
        below = [state[child] for _, child in node.children]
        own = units[node.value] if node.value is not None else None
        n = sum(x[0] for x in below) + (own["n"] if own else 0)
        conv = min([x[1] for x in below] + ([own["conv_id"]] if own else []))
        is_open = not node.end or any(x[5] for x in below) or bool(own and own["going_on"]) or node.value in (first, last)
        # Of final nodes right below the nearest open node or turn: how many, and their sums.
        tops, leaves, saved = (sum(x[i] for x in below) for i in (2, 3, 4))
        node.open, node.total = is_open, (n, conv, tops, leaves, saved)
        if depths[node]:
            if is_open:
                tops = leaves = saved = 0
            else:
                leaves = leaves or 1
                lengths = units[node.unit]["lengths"]
                saved += (n - 1) * sum(lengths[d - 1] for d in depths[node])
                tops = 1
        state[node] = (n, conv, tops, leaves, saved, is_open)

    turn_above: dict[Node, tuple[int | None, bytes | None]] = {}  # the nearest turn: its conv_id if final, name if open
    for node, parent in order:
        above_conv, above_name = turn_above[parent] if parent else (None, None)
        n, conv, tops, leaves, saved = node.total
        own = units[node.value] if node.value is not None else None
        lengths = units[node.unit]["lengths"]
        below_saved = saved
        rest = sum(lengths[d - 1] for d in depths[node] if d) if depths[node] else 0
        for depth in depths[node]:
            at_end = depth == depths[node][-1]
            length = lengths[depth - 1] if depth else 0
            ends = own["ends"] if own and at_end and depth * ID == node.end else None
            whole_depth = layer * segment + depth
            if node.open:
                me = name(node.unit, depth)
                root_part = not depth and layer > 0
                yield (
                    me,
                    above_name,
                    whole_depth,
                    None if root_part else conv,
                    None,
                    0 if root_part else n,
                    tops if at_end else 0,
                    leaves if at_end else 0,
                    saved if at_end else 0,
                    None if root_part else length,
                    ends,
                )
                above_conv, above_name = None, me
            else:
                yield (
                    None,
                    above_name,
                    whole_depth,
                    conv,
                    above_conv,
                    n,
                    tops if at_end else 1,
                    leaves or 1,
                    below_saved + (n - 1) * rest,
                    length,
                    ends or NONE_END,
                )
                above_conv, above_name = conv, None
                rest -= length
        turn_above[node] = (above_conv, above_name)


def trie_parts(units: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Rows (``NODE``) of the radix trees of sorted batches of ``units``."""

    def run(batches):
        import pyarrow as pa

        schema = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
        kinds = [schema[x.split()[1]] for x in NODE.split(", ")]
        names = [x.split()[0] for x in NODE.split(", ")]
        for batch in batches:
            rows = batch.to_pylist()
            out, at = [], 0
            while at < len(rows):
                tree = (rows[at]["layer"], rows[at]["above"])
                to = next((i for i in range(at, len(rows)) if (rows[i]["layer"], rows[i]["above"]) != tree), len(rows))
                out += trie_rows(rows[at:to], 0 if not at else -1, to - at - 1 if to == len(rows) else -1, segment)
                at = to
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=names
            )

    order = ["layer", "above", "key"]
    return units.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, NODE)


def prefix_trie(turns: DataFrame, conversations: DataFrame, tables, segment: int = SEGMENT) -> DataFrame:
    """The trie of ``turns`` (conv_id, at, id, n_bytes; at from 0 without gaps) of all ``conversations`` (conv_id, once each).

    A row for each node, with its least member as conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, n_bytes of its last turn and ends_sha256. A node is known by conv_id and depth: it
    is the first depth turns of that conversation. Without conversations there is no node.
    """
    parts = tables.save(trie_parts(tables.save(units_of(turns, conversations, tables, segment)), segment))
    opened = parts.where("node is not null").groupBy("node", "depth").agg(
        F.max("above").alias("above"),
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("n_bytes").alias("n_bytes"),
        F.max("ends").alias("ends"),
    )
    opened = tables.save(opened)
    heads = opened.select(F.col("node").alias("above"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("head"))
    more = opened.where("above is not null").groupBy(F.col("above").alias("node"), (F.col("depth") - 1).alias("depth"))
    more = more.agg(F.count("*").alias("more"))
    children = F.col("n_children") + F.coalesce("more", F.lit(0))
    opened = (
        opened.join(more, ["node", "depth"], "left")
        .join(heads, ["above", "depth"], "left")
        .withColumn("n_children", children)
        .withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long"))
        .withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("n_bytes"))
    )
    opened = tables.save(opened.drop("more"))
    # Sums over subtrees: a round adds those of the nodes 1, 2, 4.. turns below.
    up = (F.col("depth") - 1).alias("up_depth")
    sums = tables.save(opened.select("node", "depth", "n_leaves", "saved_tokens", F.col("above").alias("up"), up))
    while sums.where("up is not null").limit(1).count():
        add = sums.where("up is not null").groupBy(F.col("up").alias("node"), F.col("up_depth").alias("depth"))
        add = add.agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        jump = sums.select(
            F.col("node").alias("up"), F.col("depth").alias("up_depth"), F.col("up").alias("next"), F.col("up_depth").alias("next_depth")
        )
        sums = tables.save(
            sums.join(add, ["node", "depth"], "left")
            .join(jump, ["up", "up_depth"], "left")
            .select(
                "node",
                "depth",
                (F.col("n_leaves") + F.coalesce("leaves", F.lit(0))).alias("n_leaves"),
                (F.col("saved_tokens") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"),
                F.col("next").alias("up"),
                F.col("next_depth").alias("up_depth"),
            )
        )
    opened = opened.drop("n_leaves", "saved_tokens").join(sums.drop("up", "up_depth"), ["node", "depth"])
    final = parts.where("node is null").join(heads, ["above", "depth"], "left")
    final = final.withColumn("head", F.coalesce("parent_conv_id", "head"))
    columns = [
        "conv_id",
        "depth",
        F.col("head").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        "n_bytes",
        F.coalesce("ends", F.lit(NONE_END)).alias("ends_sha256"),
    ]
    return final.select(*columns).unionByName(opened.select(*columns))


def conversation_trie(conversations: DataFrame, group: int | None = None, segment: int = SEGMENT) -> DataFrame:
    """The prefix trie of ``conversations`` (conv_id, turn, role, text), as ``prefix_trie`` says.

    With ``group``, every conversation first takes its start from the first of its group (``shared_starts``).
    Turns are ordered by turn (null first), then role and text, so ties and repeated rows have
    their places; a null role or text is empty, rows without conv_id are left out, as they are part of no
    conversation. Other columns play no part. No conversations give no nodes.
    """
    tables = scratch(conversations.sparkSession, "trie")
    turns = turn_ids(conversations, tables)
    ids = tables.save(turns.where("at = 0").select("conv_id"))
    if group:
        turns = tables.save(shared_starts(turns, ids, group))
    return prefix_trie(turns, ids, tables, segment)
