import hashlib
import random
import zlib

from regulith.llm import prefix_trie
from regulith.llm.queries import op13_prefix_trie

from .helpers import oracle, rows, save

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, told string, row_id int"


def brute(table):
    """Every node from all prefixes of all rebuilt conversations."""
    own = {}
    for c, turn, role, text, *_ in table:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    convs = {c: own.get(c - c % 100, [])[: zlib.crc32(str(c).encode()) % 6] + v[zlib.crc32(str(c).encode()) % 6 :] for c, v in own.items()}
    nodes = {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            nodes.setdefault(tuple(convs[c][:d]), []).append(c)
    out = []
    for prefix, members in nodes.items():
        inside = [q for q in nodes if q[: len(prefix)] == prefix]
        children = [q for q in inside if len(q) == len(prefix) + 1]
        leaves = [q for q in inside if not any(r[: len(q)] == q and len(r) > len(q) for r in inside)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in inside if q)
        ended = ",".join(str(c) for c in members if len(convs[c]) == len(prefix))
        out.append((min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members), len(children), len(leaves), saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed=1):
    rng = random.Random(seed)
    out = []
    for c in [*range(0, 40), *range(95, 130), 200, 305, 100_000]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 8])):
            out.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "", "long text 😀"]), "x", 1))
    out += [(7, None, "user", None, "x", 1), (7, None, None, "first", "x", 1), (8, 1, "user", "tie", "x", 1), (8, 1, "system", "tie", "x", 1), (8, 1, "system", "tie", "x", 1), (None, 1, "user", "nobody", "x", 1)]
    for c in range(400, 440):  # exact copies of one conversation
        out += [(c, t, "user", f"same {t}", "x", 1) for t in range(9)]
    rng.shuffle(out)
    return out


def test_as_brute_force_and_sql(spark, tmp_path):
    table = conversations()
    save(spark, tmp_path, "conversations", table, SCHEMA)
    got = rows(op13_prefix_trie(spark, str(tmp_path)), *COLUMNS)
    assert got == brute(table)
    assert got == oracle(tmp_path, prefix_trie.SQL, COLUMNS, "conversations")


def test_a_long_conversation_and_a_long_text(spark, tmp_path):
    table = [(100, t, "user", str(t) + "w " * (t & 1) * 100_000 * (t < 4), "", 1) for t in range(3000)] + [(101, 0, "user", "x", "", 1), (102, 0, "user", "x", "", 1)]
    save(spark, tmp_path, "conversations", table, SCHEMA)
    got = rows(op13_prefix_trie(spark, str(tmp_path)), *COLUMNS)
    assert got == oracle(tmp_path, prefix_trie.SQL, COLUMNS, "conversations") and len(got) > 2990


def test_empty_and_single(spark, tmp_path):
    save(spark, tmp_path, "conversations", [], SCHEMA)
    assert op13_prefix_trie(spark, str(tmp_path)).collect() == []
    save(spark, tmp_path, "conversations", [(6, 0, "user", "x", "", 1)], SCHEMA)
    assert rows(op13_prefix_trie(spark, str(tmp_path)), *COLUMNS) == brute([(6, 0, "user", "x")])


def test_pieces_meet_in_order(spark, monkeypatch):
    members = spark.range(30_000).selectExpr("id % 3 as depth", "id % 3 as conv_id", "id * 7 as member").repartition(13)
    got = {r["depth"]: r["ends_sha256"] for r in prefix_trie.ends(members).collect()}
    assert got == {k: hashlib.sha256(",".join(str(i * 7) for i in range(30_000) if i % 3 == k).encode()).hexdigest() for k in range(3)}


def test_nodes_with_their_turns(spark):
    turns = spark.createDataFrame([(1, 1, "user", "hello"), (1, 2, "assistant", "hi"), (2, 1, "user", "hello")], "conv_id long, pos long, role string, text string")
    convs = spark.createDataFrame([(1, 2), (2, 1)], "conv_id long, n_turns long")
    nodes = prefix_trie.with_turns(prefix_trie.trie(convs, turns), turns)
    assert rows(nodes, "conv_id", "depth", "role", "text", "n_convs") == sorted([(1, 0, None, None, 2), (1, 1, "user", "hello", 2), (1, 2, "assistant", "hi", 1)], key=repr)
