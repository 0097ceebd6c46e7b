import hashlib
import random
import zlib

from marginalia.llm.conversation_trie import ID, RadixTree, conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, group=None):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    if group:
        cut = {c: zlib.crc32(str(c).encode()) % 9 for c in convs}
        convs = {c: convs.get(c - c % group, [])[: cut[c]] + turns[cut[c] :] for c, turns in convs.items()}
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(path))
        children = sum(len(p) == len(path) + 1 for p in below)
        parent = min(nodes[path[:-1]]) if path else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members), len(path), parent, len(members), children, len(leaves), saved, sha))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def chats(seed, n, longest, kinds):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant"][: 1 + kinds // 3]), "é" * rng.randrange(kinds)) for c in range(n) for t in range(rng.randint(1, longest))]
    rng.shuffle(rows)
    return rows


def test_node_layouts_grow():
    rng = random.Random(1)
    keys = [bytes([rng.randrange(256) for _ in range(2)]) + bytes(14) for _ in range(3000)]
    keys = sorted({*keys, *[k + keys[i] for i, k in enumerate(keys[1:])], b""})
    tree = RadixTree(keys)
    for unit in rng.sample(range(len(keys)), len(keys)):
        tree.insert(unit)
    order = tree.top_down()
    kinds = {(type(n.children).__name__, getattr(n.children, "room", 0)) for n, _ in order}
    assert kinds == {("Small", 4), ("Small", 16), ("Indexed", 0), ("Full", 0)}
    assert sorted(n.value for n, _ in order if n.value is not None) == list(range(len(keys)))
    for node, parent in order:
        assert parent is None or node.begin == parent.end < node.end
        assert node.value is None or (len(keys[node.value]) == node.end and node.end % ID == 0)
        assert [b for b, _ in node.children] == sorted(b for b, _ in node.children)
        assert all(keys[c.unit][c.begin] == b for b, c in node.children)


def test_matches_the_model(spark):
    rows = chats(1, 60, 9, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(conversation_trie(df, group=5)) == brute(rows, 5)


def test_segments_and_small_batches(spark):
    """Many layers, and batches of three units, so that most nodes are open."""
    one = [(100, t, "user", str(t % 3)) for t in range(45)]
    rows = chats(2, 25, 14, 2) + one + [(101, *r[1:]) for r in one] + [(102, *r[1:]) for r in one[:30]] + [(103, *r[1:]) for r in one[:4]]
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert result(conversation_trie(spark.createDataFrame(rows, SCHEMA), segment=4)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 2, "user", "b"), (1, 2, "user", "a"), (1, 2, "user", "a"),
        (2, None, "", ""), (2, 0, "user", "a"), (None, 0, "user", "lost"), (None, None, None, None),
        (3, 7, "user", "x" * 200_000), (4, 7, "userx", "x" * 199_999), (-6, 0, "user", "a"), (-7, 5, "user", "a"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("at", "id", "depth", "n_convs", "node", "key", "layer"):
        df = df.withColumn(name, df.role)
    assert result(conversation_trie(df)) == brute(rows)
    assert conversation_trie(spark.createDataFrame([], SCHEMA), group=5).collect() == []


def test_turnless_conversations(spark):
    """Conversations whose base is absent and whose own turns are all replaced."""
    rows = [(c, 0, "user", "hello") for c in range(1, 60) if c % 5]
    got = result(conversation_trie(spark.createDataFrame(rows, SCHEMA), group=5))
    assert got == brute(rows, 5)
    assert any(r[1] == 0 and r[-1] != hashlib.sha256(b"").hexdigest() for r in got)
